"""Scalar functions of the knowledge store and task engine, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def age_days(created: str | Column, as_of: Column) -> Column:
    """Whole periods of 24 hours from created to as_of, 0 at least."""
    return F.greatest(F.floor((F.unix_micros(as_of) - F.unix_micros(col(created))) / DAY_US), F.lit(0)).cast("long")


def age_label(seconds: Column) -> Column:
    """Minutes below an hour, hours below a day, else days; empty if unknown."""
    s = F.greatest(seconds, F.lit(0))
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    return F.when(seconds.isNull(), "").when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def project_id(raw: str | Column, most: int = 128) -> Column:
    """Trimmed and cut; blank is null."""
    return F.left(F.nullif(F.trim(col(raw)), F.lit("")), F.lit(most))


def normalized_tags(tags: Column, synonyms: dict[str, str], banned: list[str], tiers: dict[str, int] | None = None, most: int = 5) -> Column:
    """Trimmed, lower-cased, renamed, unique in order, without banned ones; the `most` of the best tiers."""
    names = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    ranks = F.create_map(*[F.lit(x) for kv in (tiers or {"": 9}).items() for x in kv])
    clean = F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    kept = F.array_except(F.array_distinct(F.transform(clean, lambda t: F.coalesce(names[t], t))), F.array(*[F.lit(b) for b in banned]).cast("array<string>"))
    ranked = F.array_sort(F.transform(kept, lambda t, i: F.struct(F.coalesce(ranks[t], F.lit(9)).alias("tier"), i.alias("at"), t.alias("tag"))))
    return F.slice(F.transform(ranked, lambda s: s["tag"]), 1, most)


def token_estimate(text: str | Column, per_token: int = 3) -> Column:
    return F.ceil(F.length(col(text)) / per_token).cast("long")


def preview(what: Column, text: Column, most: int = 80) -> Column:
    short = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)
    return F.coalesce(F.nullif(what, F.lit("")), short)


def failed_gate(notes: str | Column) -> Column:
    """Which gate a validator's notes blame: names first, then phrases, first rule that holds."""
    n = F.lower(col(notes))
    rules = [
        ("BRANCH_EVIDENCE", ["branch_evidence", "gate 1"]), ("LEARNING_BLOCK", ["learning_block", "gate 2"]), ("TEST_EVIDENCE", ["test_evidence", "gate 3"]), ("PR_URL", ["pr_url", "gate 4"]),
        ("BRANCH_EVIDENCE", ["no branch", "branch evidence", "missing branch"]), ("LEARNING_BLOCK", ["no learning", "missing learning"]), ("TEST_EVIDENCE", ["no test", "test evidence", "test output"]), ("PR_URL", ["no pr", "pr url", "pull request", "not merged"]),
    ]
    out = F
    for gate, phrases in rules:
        out = out.when(reduce(lambda a, b: a | b, [n.contains(p) for p in phrases]), gate)
    return out.otherwise("UNKNOWN")


def hygiene_gaps(description: Column, details: Column, test_strategy: Column, success_criteria: Column, doc_refs: Column) -> Column:
    """Names of the fields that are blank or empty, in a fixed order."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    gaps = [("missing_description", blank(description)), ("missing_details", blank(details)), ("missing_test_strategy", blank(test_strategy)), ("missing_success_criteria", empty(success_criteria)), ("missing_doc_refs", empty(doc_refs))]
    return F.array_compact(F.array(*[F.when(test, name) for name, test in gaps]))


def lane(owner: Column, text: Column, code: list[str], non_code: list[str]) -> Column:
    """non-code or code by the owner; without an owner by words of the text."""
    who = F.lower(F.trim(F.coalesce(owner, F.lit(""))))
    telling = reduce(lambda a, b: a | b, [F.lower(text).contains(w) for w in ("research", "report", "analysis", "spec", "strategy", "audit")])
    return F.when(who.isin(non_code), "non-code").when(who.isin(code) | (who != ""), "code").when(telling, "non-code").otherwise("code")


def domain_tags(text: Column, hints: dict[str, list[str]]) -> Column:
    """Tags of which any hint is a part of the text."""
    t = F.lower(text)
    return F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [t.contains(h) for h in words]), tag) for tag, words in hints.items()]))


def scrubbed(text: str | Column, patterns: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(text, names of the patterns that hit): (name, regex, replacement) in order, each on the text that the one before left."""
    now, names = col(text), []
    for name, regex, replacement in patterns:
        names.append(F.when(now.rlike(regex), name))
        now = F.regexp_replace(now, regex, replacement)
    return now, F.array_compact(F.array(*names))


def pr_url(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"https?://[^\s)]+/pull/[0-9]+", 0), F.lit(""))


def pr_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"/pull/([0-9]+)", 1), F.lit("")).cast("int")


def branch_name(text: Column) -> Column:
    said = F.regexp_extract(text, r"(?i)(?:branch:\s*|checkout -b\s+)([A-Za-z0-9._/-]+)", 1)
    named = F.regexp_extract(text, r"\b(?:feat|fix|chore|docs|refactor|test)/[A-Za-z0-9._-]+", 0)
    return F.coalesce(F.nullif(said, F.lit("")), F.nullif(named, F.lit("")))


def commit_shas(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[0-9a-f]{7,40}\b"), F.lit(0)))


def json_merge(old: Column, patch: Column) -> Column:
    """Top-level merge of two JSON objects; the patch's keys win. Values keep their types, keys are sorted; what isn't an object counts as empty."""
    kind = "map<string,variant>"
    a, b = (F.coalesce(F.from_json(c, kind), F.from_json(F.lit("{}"), kind)) for c in (old, patch))
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    return F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.when(F.map_contains_key(b, k), b[k]).otherwise(a[k]))))


def semver(version: Column) -> Column:
    """(major, minor, patch), null if it isn't one."""
    part = lambda i: F.regexp_extract(version, r"^v?(\d+)\.(\d+)\.(\d+)(?:[-+].*)?$", i).cast("int")
    return F.when(version.rlike(r"^v?\d+\.\d+\.\d+([-+].*)?$"), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def phase_number(raw: Column) -> Column:
    """A finite decimal, else null."""
    return raw.try_cast("decimal(12,3)")


def phase_label(raw: Column) -> Column:
    """A phase's number as text, a whole one without decimals (72.0 is 72); null if it isn't a finite number."""
    return F.regexp_replace(phase_number(raw).cast("string"), r"\.?0+$", "")


def normal_cdf(z: Column) -> Column:
    """By a rational approximation of the complementary error function (Abramowitz and Stegun 7.1.26; fixed values)."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = reduce(lambda acc, c: t * (F.lit(c) + acc), [-1.453152027, 1.421413741, -0.284496736, 0.254829592], t * 1.061405429)
    tail = poly * F.exp(-x * x)
    return 1 - F.when(x >= 0, tail).otherwise(2 - tail) / 2


def learning_block(text: Column) -> Column:
    """The fields of a LEARNING block: what (or its heading), why, when, category, tags."""
    block = F.regexp_extract(text, r"(?s)(?:^|\n)#*\s*LEARNING:?\s*(.*)", 1)
    field = lambda name: F.nullif(F.trim(F.regexp_extract(block, rf"(?m)^\W*{name}\W*:\s*(.+)$", 1)), F.lit(""))
    first = F.nullif(F.trim(F.regexp_extract(block, r"^([^\n]*)", 1)), F.lit(""))
    tags = F.filter(F.transform(F.split(F.coalesce(field("TAGS"), F.lit("")), ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    return F.when(F.trim(block) != "", F.struct(F.coalesce(field("WHAT"), first).alias("what"), field("WHY").alias("why"), field("WHEN").alias("when"), F.coalesce(F.lower(field("CATEGORY")), F.lit("pattern")).alias("category"), tags.alias("tags")))


# Chatty openings, each up to the end of its sentence. No two of them can begin at one place.
PREAMBLES = [
    r"here\s+(?:is|are)\s+(?:a\s+)?(?:comprehensive|detailed|brief|quick)?\s*(?:overview|summary|breakdown|look|analysis|guide|explanation)[^.:]{0,120}[.:]",
    r"based\s+on\s+(?:my\s+)?(?:research|analysis|findings|the\s+(?:available\s+)?(?:information|data|sources))[^.:,]{0,100}[.:,]",
    r"i\s+found\s+(?:that\s+)?(?:the\s+following|several|some|a\s+few)[^.:]{0,120}[.:]",
    r"sure[,!.]?\s*(?:here\s+(?:is|are))?[^.:]{0,100}[.:]",
    r"let\s+me\s+(?:provide|explain|break\s+down|summarize)[^.:]{0,120}[.:]",
    r"certainly[,!.]?",
    r"absolutely[,!.]?",
    r"the\s+following\s+(?:is|provides|summarizes|outlines)\s+[^.:]{0,120}[.:]",
    r"to\s+(?:answer|address|respond\s+to)\s+(?:your|this|the)\s+(?:question|query|request)[^.:,]{0,100}[.:,]",
    r"(?:great|good)\s+question[.!,]",
    r"of\s+course[,!.]?",
    r"i'?d\s+be\s+happy\s+to\s+(?:help|explain|provide|assist)[^.:,]{0,100}[.:,]",
    r"as\s+an?\s+(?:ai|artificial\s+intelligence)\s+(?:assistant|model|language\s+model)[^.:,]{0,100}[.:,]",
]
PREAMBLE = rf"(?i)^\s*(?:(?:{'|'.join(PREAMBLES)})\s*)+"


def stripped_preamble(text: Column) -> Column:
    """Without leading chatty phrases, however many, and without white space around the rest."""
    return F.regexp_replace(F.regexp_replace(text, PREAMBLE, ""), r"^\s+|\s+$", "")


def complexity_score(files: Column, loc: Column, tests: Column, depth: Column, migration: Column, api: Column, security: Column) -> Column:
    """0 to 100 from seven capped features (fixed weights 20, 15, 10, 15, 15, 10, 15)."""
    part = lambda c, cap, weight: F.least(c, F.lit(cap)) / cap * weight
    total = part(files, 20, 20) + part(loc, 500, 15) + part(tests, 10, 10) + part(depth, 10, 15) + F.when(migration, 15).otherwise(0) + F.when(api, 10).otherwise(0) + part(security, 10, 15)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(total))).cast("int")
