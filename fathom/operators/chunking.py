"""Cutting files into chunks, and keeping the index of chunks up to date."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import text as words
from fathom.functions.condensed import _bound as bound
from fathom.operators import scan

MOST_CHARS = 4000
CHUNK = "path string, label string, start_line int, end_line int, text string"


def paragraphs(files: DataFrame) -> DataFrame:
    """Blocks of lines between blank lines, of (path, text)."""
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    from pyspark.sql import Window

    order = Window.partitionBy("path").orderBy("at")
    block = F.sum(F.when(F.trim("line") == "", 1).otherwise(0)).over(order)
    rows = lines.withColumn("block", block).where(F.trim("line") != "")
    merged = rows.groupBy("path", "block").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    return merged.select("path", F.concat(F.lit("paragraph "), (F.col("first") + 1).cast("string")).alias("label"), (F.col("first") + 1).cast("int").alias("start_line"), (F.col("last") + 1).cast("int").alias("end_line"), F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias("text"))


HEADING = r"^#{1,6}\s+(.+?)\s*#*\s*$"


def sections(files: DataFrame, heading: str = HEADING) -> DataFrame:
    """Markdown sections: a heading and the lines up to the next one; lines before the first are `preamble`. heading: what starts one; its group 1 is the label."""
    from pyspark.sql import Window

    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    order = Window.partitionBy("path").orderBy("at")
    head = F.regexp_extract("line", heading, 1)
    rows = lines.withColumn("head", head).withColumn("part", F.sum(F.when(F.col("head") != "", 1).otherwise(0)).over(order))
    merged = rows.groupBy("path", "part").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max("head").alias("head"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda s: s["line"]), "\n")
    return merged.select("path", F.when(F.col("head") == "", "preamble").otherwise(F.col("head")).alias("label"), (F.col("first") + 1).cast("int").alias("start_line"), (F.col("last") + 1).cast("int").alias("end_line"), text.alias("text")).where(F.trim("text") != "")


def statements(files: DataFrame) -> DataFrame:
    """SQL statements between semicolons at a line's end, with the lines that they take."""
    from pyspark.sql import Window

    parts = files.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s).+?(?:;[ \t]*(?:\r?\n|\z)|\z)"), F.lit(0))).alias("at", "raw"))
    breaks = F.length("raw") - F.length(F.replace("raw", F.lit("\n"), F.lit("")))
    before = F.sum(breaks).over(Window.partitionBy("path").orderBy("at")) - breaks
    lead = F.regexp_extract("raw", r"^\s*", 0)
    text = F.regexp_replace(F.regexp_replace("raw", r";[ \t]*(?:\r?\n)?$", ""), r"^\s+|\s+$", "")
    skipped = F.length(lead) - F.length(F.replace(lead, F.lit("\n"), F.lit("")))
    rows = parts.select("path", "at", (before + skipped + 1).cast("int").alias("start_line"), text.alias("text")).where("text <> ''")
    name = F.regexp_extract("text", r"(?is)^\s*(?:--[^\n]*\n\s*)*(create|alter|insert|update|delete|select|drop|with)\b[^;]*?\b(?:table|index|view|into|from|update)\s+(?:if\s+(?:not\s+)?exists\s+)?([A-Za-z_][\w.]*)", 2)
    label = F.when(name != "", name).otherwise(F.concat(F.lit("statement "), (F.col("at") + 1).cast("string")))
    last = F.col("start_line") + F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return rows.select("path", label.alias("label"), "start_line", last.cast("int").alias("end_line"), "text")


SCRIPT = r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?\s+|class\s+|(?:const|let|var)\s+(?=[\w$]+\s*=\s*(?:async\s*)?(?:\(|function\b|[\w$]+\s*=>)))([\w$]+)"


def script_symbols(files: DataFrame) -> DataFrame:
    """JavaScript and TypeScript: top-level functions, classes and arrow functions, each up to the next; lines before the first are `preamble`."""
    return sections(files, SCRIPT)


# Which extensions are cut in which way; all others by paragraphs.
BY_EXTENSION = {"python": ["py"], "script": ["js", "ts", "jsx", "tsx", "cjs", "mjs"], "sql": ["sql"], "markdown": ["md", "mdx", "markdown"]}


def chunked(files: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """Chunks of (path, text), cut by what the extension says and split where longer than `most`. Blank and null texts have none."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    rows = files.where(F.trim("text") != "").select("path", "text", extension.alias("_ext"))
    of = lambda kind: rows.where(F.col("_ext").isin(BY_EXTENSION[kind])).drop("_ext")
    others = rows.where(~F.col("_ext").isin([e for some in BY_EXTENSION.values() for e in some])).drop("_ext")
    out = python_symbols(of("python")).drop("dependencies")
    for some in (script_symbols(of("script")), statements(of("sql")), sections(of("markdown")), paragraphs(others)):
        out = out.unionByName(some)
    return split_oversized(out, most)


def python_symbols(files: DataFrame) -> DataFrame:
    """Top-level functions and classes and their methods, with up to 20 names each that they call: CHUNK and dependencies. A file that doesn't parse is one chunk."""

    def cut(frames):
        for frame in frames:
            out = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                lines = (text or "").split("\n")
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError):
                    out.append((path, "file", 1, len(lines), text, []))
                    continue
                found = [(n, n.name) for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
                found += [(m, f"{n.name}.{m.name}") for n in tree.body if isinstance(n, ast.ClassDef) for m in n.body if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef)]
                for node, label in found:
                    calls = {c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name | ast.Attribute)}
                    out.append((path, label, node.lineno, node.end_lineno, "\n".join(lines[node.lineno - 1 : node.end_lineno]), sorted(calls)[:20]))
            yield pd.DataFrame(out, columns=["path", "label", "start_line", "end_line", "text", "dependencies"])

    return files.select("path", "text").mapInPandas(cut, f"{CHUNK}, dependencies array<string>")


def split_oversized(chunks: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """Chunks of more than `most` characters in parts that end at line ends, labelled (part n). A single longer line stays whole."""
    from pyspark.sql import Window

    long = chunks.where(F.length("text") > most)
    lines = long.select("path", "label", "start_line", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    order = Window.partitionBy("path", "label", "start_line").orderBy("at")
    ends = F.sum(F.length("line") + 1).over(order)
    rows = lines.withColumn("part", F.floor((ends - F.length("line") - 1) / most))
    merged = rows.groupBy("path", "label", "start_line", "part").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    nth = F.row_number().over(Window.partitionBy("path", "label", "start_line").orderBy("part"))
    base = F.coalesce("start_line", F.lit(1))
    cut = merged.select("path", F.concat("label", F.lit(" (part "), nth.cast("string"), F.lit(")")).alias("label"), (base + F.col("first")).cast("int").alias("start_line"), (base + F.col("last")).cast("int").alias("end_line"), F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias("text"))
    return chunks.where(F.length("text") <= most).select("path", "label", "start_line", "end_line", "text").unionByName(cut)


def refreshed(index: DataFrame, states: DataFrame, chunks: DataFrame) -> DataFrame:
    """The index after a run: chunks of new and changed files replace theirs, chunks of vanished files go."""
    touched = states.where("state <> 'same'").select("path").distinct()
    return index.join(touched, "path", "left_anti").unionByName(chunks, allowMissingColumns=True)


def described(chunks: DataFrame, most: int = 240) -> DataFrame:
    """Adds description: label, type, up to five names that it depends on, and its file's stem, cut to length."""
    stem = F.regexp_extract("path", r"([^/\\]+?)(?:\.[^.]*)?$", 1)
    kind = F.when(F.col("label").rlike(r"^[A-Z]\w*$"), "class").when(F.col("label").contains("."), "method").otherwise("function")
    names = F.array_join(F.transform(F.slice("dependencies", 1, 5), lambda n: F.left(n, F.lit(20))), ",")
    return chunks.withColumn("description", F.left(F.concat_ws("|", "label", F.concat(F.lit("type:"), kind), F.when(F.size("dependencies") > 0, F.concat(F.lit("deps:"), names)), F.concat(F.lit("touches:"), stem)), F.lit(most)))


def findings(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (rule_id, domain, severity, path, dedup_key) of rules (rule_id, domain, severity, pattern) against files (path, text)."""
    hits = scan.matches(files.select("path", "text"), rules)
    return hits.select("rule_id", "domain", "severity", "path", F.concat_ws(":", "rule_id", F.sha1(F.col("path").cast("binary"))).alias("dedup_key"))


def new_findings(found: DataFrame, known: DataFrame) -> DataFrame:
    """One row for each key of findings that no open or ticketed one of known (dedup_key, status) has."""
    return found.dropDuplicates(["dedup_key"]).join(known.where(F.col("status").isin("open", "ticketed")).select("dedup_key"), "dedup_key", "left_anti").select(*found.columns)


def grammar_stripped(files: DataFrame) -> DataFrame:
    """Texts of (path, text), path distinct, with words and phrases that say nothing taken out of their lines.

    Fenced code and lines that are a tag stay as they are. From the first line `---` outside a fence to the next one (or the end), lines are
    front matter: only their plain or quoted values change. Null stays null. Each text is worked off in its row, in time that grows with its lines: fences cut
    it into segments that are code or not.
    """
    field = r"(?s)^(\s*[\p{L}\p{N}_-]+\s*:\s*)(.*)$"

    def in_front(line: Column) -> Column:
        key, value = F.regexp_extract(line, field, 1), F.regexp_extract(line, field, 2)
        quote, inner = F.regexp_extract(words.trimmed(value), r"^([\"'])(.*)\1$", 1), F.regexp_extract(words.trimmed(value), r"^([\"'])(.*)\1$", 2)
        clean = F.concat(key, F.when(value.rlike(r"^[\[{|>]"), value).when(quote != "", F.concat(quote, words.stripped_line(inner), quote)).otherwise(words.stripped_line(value)))
        return F.when(key == "", line).otherwise(clean)

    def of_lines(lines: Column) -> Column:
        mark = lambda x, i: F.when(x.rlike(r"^\s*(?:```|---\s*\z)"), F.struct(i.alias("at"), x.rlike(r"^\s*```").alias("fence")))
        return bound(F.filter(F.transform(lines, mark), lambda m: m.isNotNull()), lambda marks: of_marks(lines, marks))

    def of_marks(lines: Column, marks: Column) -> Column:
        seen = lambda odd, first: F.struct(odd.alias("odd"), first.alias("first"))
        step = lambda s, m: F.when(s["first"].isNotNull(), s).when(m["fence"], seen(~s["odd"], s["first"])).when(s["odd"], s).otherwise(seen(s["odd"], m["at"]))
        first = F.aggregate(marks, seen(F.lit(False), F.lit(None).cast("int")), step)["first"]
        return bound(first, lambda a: bound(F.get(F.filter(marks, lambda m: ~m["fence"] & (m["at"] > a)), F.lit(0))["at"], lambda b: of_front(lines, marks, a, b)))

    def of_front(lines: Column, marks: Column, first: Column, last: Column) -> Column:
        front = lambda at: F.coalesce((at > first) & (last.isNull() | (at < last)), F.lit(False))
        kept = lambda at: F.coalesce((at == first) | (at == last), F.lit(False))
        changed = lambda x, at: F.when(kept(at), x).when(front(at), in_front(x)).when(x.rlike(r"^\s*<[^>]+>\s*$"), x).otherwise(words.stripped_line(x))

        def of_fences(fences: Column) -> Column:
            def segment(j: Column) -> Column:
                start, end = F.coalesce(F.get(fences, j - 1) + 1, F.lit(0)), F.coalesce(F.get(fences, j), F.size(lines))
                # In code no front matter begins, but it may end there or go on.
                part = F.slice(lines, start + 1, end - start)
                part = F.when(j % 2 == 1, F.transform(part, lambda x, i: F.when(front(start + i), in_front(x)).otherwise(x))).otherwise(F.transform(part, lambda x, i: changed(x, start + i)))
                return F.concat(part, F.when(j < F.size(fences), F.array(F.get(lines, F.get(fences, j)))).otherwise(F.array().cast("array<string>")))

            return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(fences)), segment)), "\n")

        return bound(F.transform(F.filter(marks, lambda m: m["fence"] & ~front(m["at"])), lambda m: m["at"]), of_fences)

    return files.select("path", F.when(F.col("text").isNotNull(), bound(F.split("text", "\n"), of_lines)).alias("text"))
