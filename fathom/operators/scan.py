"""Many patterns over many texts: one pass of an automaton for the literals that patterns need, regular expressions only where one is met.

A pattern that matches holds one of some literals, which its parsed form tells: of pieces that follow each other the one with the longest, of
alternatives all. Texts are searched once for all literals of all rules (pyahocorasick, ASCII case folded), so the work grows
with the texts and what is found in them, not with the number of rules; where a literal is met, what the pattern has after it must follow, and a
rule's own expression is then tried on the texts that hold both. Patterns without a literal of LEAST characters (or one less, if it is known what follows), or that only Java can read, are tried on every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.storage import small, stored

LEAST = 3
#: A literal of so many characters is looked for even if nothing is known to follow it.
LONG = 12
#: Rules are a table of settings and come to the driver: so many at most.
MOST_RULES = 100_000
_UPPER = re.compile("[A-Z]+")


def _folded(t: str) -> str:
    return t.lower() if t.isascii() else _UPPER.sub(lambda m: m[0].lower(), t)


def _followed(nodes, at: int, first: str, state) -> re.Pattern | None:
    """What must follow a literal that ends before nodes[at], as far as Python and Java read it alike; None if no further literal is told.

    A repeat without a bound must stop at the literal's first character, so that all tries in a text together pass it once.
    """

    def alike(op, value) -> bool:
        name = str(op)
        if name in ("LITERAL", "NOT_LITERAL"):
            return True
        if name == "IN":  # Java reads a bracket inside brackets in another way
            return all(str(o) in ("NEGATE", "CATEGORY") or str(o) == "LITERAL" and v != 91 or str(o) == "RANGE" and 91 not in v for o, v in value)
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = value
            if not all(alike(o, v) for o, v in body):
                return False
            one = re._compiler.compile(re._parser.SubPattern(state, list(body)))
            return high <= 64 or len(body) == 1 and str(body[0][0]) in ("LITERAL", "NOT_LITERAL", "IN") and not one.match(first) and not one.match(first.swapcase())
        return False

    end = at
    while end < len(nodes) and alike(*nodes[end]):
        end += 1
    told = any(str(op) == "LITERAL" for op, _ in nodes[at:end])
    return re._compiler.compile(re._parser.SubPattern(state, list(nodes[at:end]))) if told else None


def _needed(nodes, state=None) -> dict[str, list[re.Pattern | None]] | None:
    """Literals of which every match of the parsed nodes holds one, each with what may follow it there (one of them does; None: anything); None if there is no such set.

    state: of the whole pattern, if its flags hold for nodes. Of several sets one that tells what follows, or a long literal, goes first."""
    best, best_rank = None, (False, 0, False)
    run = ""
    nodes = list(nodes)

    def offer(found: dict[str, list[re.Pattern | None]] | None) -> None:
        nonlocal best, best_rank
        if found:
            least = min(map(len, found))
            told = all(len(x) >= LONG or None not in tails for x, tails in found.items())
            rank = (told and least >= LEAST, least, told)
            if best is None or rank > best_rank:
                best, best_rank = found, rank

    for i, (op, value) in enumerate([*nodes, (None, None)]):
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        offer({run: [_followed(nodes, i, run[0], state) if state else None]} if run else None)
        run = ""
        if name == "SUBPATTERN":
            offer(_needed(value[-1], None if value[1] or value[2] else state))
        elif name == "ATOMIC_GROUP":
            offer(_needed(value))
        elif name == "BRANCH":
            parts = [_needed(b, state) for b in value[1]]
            if all(p is not None for p in parts):
                both: dict[str, list[re.Pattern | None]] = {}
                for p in parts:
                    for x, tails in p.items():
                        both.setdefault(x, []).extend(tails)
                offer(both)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            offer(_needed(value[2], None if name == "POSSESSIVE_REPEAT" else state))
    return best


@lru_cache(10_000)
def _followed_literals(pattern: str) -> dict[str, list[re.Pattern | None]]:
    """The folded literals of a pattern and what may follow each, or none if it must be tried everywhere. Those of which that is known may be a character shorter."""
    if re.search(r"\\[QEGRXphHkvVNz]|\(\?[a-zA-Z]*[uxU]", pattern) or "&&" in pattern:
        return {}  # read in another way by Java
    try:
        parsed = re._parser.parse(pattern, re.ASCII)
        found = _needed(parsed, parsed.state)
    except (re.error, OverflowError, RecursionError, ValueError):
        return {}
    folded: dict[str, list[re.Pattern | None]] = {}
    for x, tails in (found or {}).items():
        folded.setdefault(_folded(x), []).extend(tails)
    return folded if all(len(x) >= (LEAST if None in tails else LEAST - 1) for x, tails in folded.items()) else {}


def needed_literals(pattern: str) -> list[str]:
    """The folded literals of a pattern, or none if it must be tried everywhere, as far as literals of LEAST characters tell."""
    found = sorted(_followed_literals(pattern))
    return found if found and min(map(len, found)) >= LEAST else []


def matches(texts: DataFrame, rules: DataFrame, text_col: str = "text", rule_col: str = "rule_id", pattern_col: str = "pattern") -> DataFrame:
    """Rows of texts with all columns of those rules whose pattern (of RLIKE) the text holds. Null texts and patterns match nothing. rules must not have the columns of texts."""
    rules = stored(rules.where(F.col(pattern_col).isNotNull()).withColumn("_rule", F.monotonically_increasing_id()), "rules")
    listed = rules.select("_rule", pattern_col).limit(MOST_RULES + 1).collect()
    if len(listed) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    of: dict[str, list[tuple[int, str]]] = {}
    always: list[int] = []
    for rule, pattern in listed:
        literals = _followed_literals(pattern)
        always += [] if literals else [rule]
        for x in literals:
            of.setdefault(x, []).append((rule, pattern))
    shared = texts.sparkSession.sparkContext.broadcast((of, sorted(always)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, always = shared.value
        follow: dict[str, list[tuple[int, list[re.Pattern | None]]]] = {}
        automaton = ahocorasick.Automaton()
        for literal in of:
            automaton.add_word(literal, literal)
        if of:
            automaton.make_automaton()
        for b in batches:
            found = []
            for t in b.column("_text").to_pylist():
                met: set[int] = set()
                for end, x in automaton.iter(_folded(t)) if of and t is not None else ():
                    if x not in follow:
                        follow[x] = [(r, _followed_literals(pattern)[x]) for r, pattern in of[x]]
                    for r, tails in follow[x]:
                        if r not in met and any(f is None or f.match(t, end + 1) for f in tails):
                            met.add(r)
                found.append([] if t is None else sorted({*always, *met}))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int64()))], names=[*b.schema.names, "_rules"])

    rows = texts.withColumn("_text", F.col(text_col))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    tried = rows.mapInArrow(search, f"{schema}, _rules array<long>").where("size(_rules) > 0").withColumn("_rule", F.explode("_rules")).drop("_rules")
    return tried.join(small(rules), "_rule").where(F.expr(f"_text RLIKE `{pattern_col}`")).drop("_text", "_rule")


def unreferenced(files: DataFrame, kinds: str = r"\.(py|js|ts|sh|md)$") -> DataFrame:
    """(path) of the files of these kinds whose name without folder and ending no other file's text holds as a word."""
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    asked = files.where(F.col("path").rlike(kinds)).select("path", name.alias("name"))
    words = files.select(F.col("path").alias("in"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0)))).alias("name"))
    # Of each word the least and the greatest file that holds it: one of them is another one than the file itself, if there is any.
    held = words.join(small(stored(asked.select("name").distinct(), "names")), "name", "left_semi").groupBy("name").agg(F.min("in").alias("low"), F.max("in").alias("high"))
    return asked.join(held, "name", "left").where("low IS NULL OR (low = path AND high = path)").select("path")


def missing_files(files: DataFrame, required: DataFrame) -> DataFrame:
    """Rows of required (rule_id, repo, pattern) for which a repository (repo, path) has no file whose path matches. A repository without files misses all."""
    met = matches(files.select("repo", "path"), required.select("rule_id", F.col("repo").alias("_repo"), "pattern"), "path").where("repo = _repo")
    return required.join(met.select("rule_id", "repo").distinct(), ["rule_id", "repo"], "left_anti")
