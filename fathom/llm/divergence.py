"""Audit of how far sources diverge: L1 distances of the word distributions of all sources of a language, and each source's marked terms.

Terms are runs of letters (all that isn't ASCII but no letter), A-Z lower-cased. A language keeps the terms that occur in
`least_docs` of its documents. With c occurrences in a group and N of all kept terms there, V kept terms, a term's share is
p = 1 + floor(10^9 * (c + 5) / (N + 5 * V)), in exact integers. Part `pair` gives the sum of |p - q| over all kept terms for each
ordered pair of sources, part `term` the terms whose share is above the language's, the 50 farthest of each source.

Count columns are deduplicated: terms whose sparse vectors of counts by source are identical are one vector with a
multiplicity. Shares are computed once for each vector, and a pair of sources that both have a vector is evaluated once for it
and multiplied. What a vector that one source has adds beside a source without it depends on the count alone, so
it is summed up by (source, count) first; terms that neither has differ by a constant. Marked terms are ranked as
vectors, ties included, before the terms themselves are looked up and ranked.

Null text, language and source count as ''. A group without terms has all counts 0; without kept terms (V = 0) all values are 0.
Repeated rows count each. Ties are ordered by UTF-8 bytes. An empty table gives no rows. Columns other than text, lang and source are not
looked at. A table of groups (language, source) is broadcast up to a counted size, else joined by shuffles.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, small, stored, table

LEAST_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: A task sends its counts on when it holds so many.
_HELD = 400_000
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_GROUP = ["lang", "source"]


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term); summed up in tasks first. docs has text, lang and source without nulls."""

    def count(batches):
        held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def flush():
            for (lang, source), (n, of) in held.items():
                terms = list(n)
                for a in range(0, len(terms), 50_000):
                    some = terms[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([of[t] for t in some], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            held.clear()

        for rows in batches:
            for part, texts in chunks(rows, "text"):
                for text, lang, source in zip(texts, part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True):
                    found = Counter(_TERM.findall(text.encode().lower()))
                    n, of = held[lang, source]
                    n.update(found)
                    of.update(found.keys())
                if sum(len(n) for n, _ in held.values()) > _HELD:
                    yield from flush()
        yield from flush()

    parts = docs.select("text", *_GROUP).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy(*_GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * kept)) in exact integers; 0 where nothing is kept."""
    above = f"CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + {SMOOTHING} AS DECIMAL(19,0))"
    return F.expr(f"IF({kept} = 0, 0L, 1 + {above} DIV CAST({total} + {SMOOTHING} * {kept} AS DECIMAL(19,0)))")


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: see the module."""
    filled = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    docs = docs.select(filled(text_col, "text"), filled(lang_col, "lang"), filled(source_col, "source"))
    counts = stored(term_counts(docs), "counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"))
    terms = stored(terms.where(F.col("docs") >= least_docs).drop("docs"), "terms")
    vectors = stored(terms.groupBy("lang", "vector").agg(F.count("*").alias("times"), F.first("total").alias("total")).withColumn("id", F.monotonically_increasing_id()), "vectors")
    cells = vectors.select("lang", "id", "times", "total", F.inline("vector"))

    langs = vectors.groupBy("lang").agg(F.sum("times").alias("kept"), F.sum(F.col("times") * F.col("total")).alias("all"))
    sizes = cells.groupBy(*_GROUP).agg(F.sum(F.col("times") * F.col("n")).alias("size"), F.sum("times").alias("own"))
    none = {"size": 0, "own": 0, "kept": 0, "all": 0}
    groups = docs.select(*_GROUP).distinct().join(sizes, _GROUP, "left").join(langs, "lang", "left").na.fill(none)
    groups = small(stored(groups.withColumn("zero", share("0", "size", "kept")), "groups"))

    shares = cells.join(groups, _GROUP).select(*_GROUP, "id", "times", "n", share("n", "size", "kept").alias("p"), share("total", "all", "kept").alias("q"), "zero")
    shares = stored(shares, "shares")

    # Pairs, as (low, high): what vectors of one source alone, of both, and of neither add.
    other = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("zero_2"), F.col("own").alias("own_2"))
    pair = [F.least("source", "other").alias("low"), F.greatest("source", "other").alias("high")]
    columns = shares.groupBy(*_GROUP, "n", "p").agg(F.sum("times").alias("times"))
    alone = columns.join(other, "lang").where("source <> other").select("lang", *pair, F.expr("times * abs(p - zero_2)").alias("value"))
    cell = F.struct("source", "p", "zero")
    both = shares.groupBy("lang", "id", "times").agg(F.collect_list(cell).alias("cells")).where("size(cells) > 1")
    both = both.select("lang", "times", "cells", F.explode("cells").alias("x")).select("lang", "times", "x", F.explode("cells").alias("y")).where("x.source < y.source")
    both = both.select("lang", F.col("x.source").alias("low"), F.col("y.source").alias("high"), F.expr("times * (abs(x.p - y.p) - abs(x.p - y.zero) - abs(y.p - x.zero) + abs(x.zero - y.zero))").alias("value"))
    neither = groups.join(other, "lang").where("source < other").select("lang", *pair, F.expr("(kept - own - own_2) * abs(zero - zero_2)").alias("value"))
    summed = [x.groupBy("lang", "low", "high").agg(F.sum("value").alias("value")) for x in (alone, both, neither)]
    pairs = stored(summed[0].unionByName(summed[1]).unionByName(summed[2]).groupBy("lang", "low", "high").agg(F.sum("value").alias("value")), "pairs")
    turned = F.inline(F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")), F.struct(F.col("high").alias("source"), F.col("low").alias("item"))))
    ordered = Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "value", turned).withColumn("rank", F.row_number().over(ordered)).withColumn("part", F.lit("pair"))

    marked = shares.where("p > q").select(*_GROUP, "id", (F.col("p") - F.col("q")).alias("value"))
    first = marked.withColumn("place", F.rank().over(Window.partitionBy(*_GROUP).orderBy(F.desc("value")))).where(F.col("place") <= top)
    first = stored(first.join(vectors.select("id", "vector"), "id").select(*_GROUP, "vector", "value"), "first")
    found = terms.select("lang", "vector", F.col("term").alias("item")).join(small(first), ["lang", "vector"])
    found = found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    out = [*_GROUP, "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return pairs.select(*out).unionByName(found.select(*out))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c, 0)::HUGEINT AS c FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
totals AS (SELECT lang, term, sum(c)::HUGEINT AS t FROM cells GROUP BY lang, term),
shares AS (
  SELECT lang, source, term, c, 1 + {SCALE} * (c + {SMOOTHING}) // (sum(c) OVER g + {SMOOTHING} * count(*) OVER g)::HUGEINT AS p FROM cells WINDOW g AS (PARTITION BY lang, source)),
langs AS (SELECT lang, term, 1 + {SCALE} * (t + {SMOOTHING}) // (sum(t) OVER g + {SMOOTHING} * count(*) OVER g)::HUGEINT AS q FROM totals WINDOW g AS (PARTITION BY lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares JOIN langs USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM ranked QUALIFY part = 'pair' OR rank <= {TOP}
"""
