"""Running budgets over conversations, batches of pending rows, cycles of a graph, finished logs of writes, and many patterns over all texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import graph, running, scan, store
from fathom.storage import small, stored

from .base import query, table
from .search import _TRI

_TOOL = "^[AEIOUÉÈÊ]"


def _turns(spark, d):
    """Lines of assistant turns that begin with a vowel are tool blocks."""
    lines = F.split("text", "\n")
    bare = F.when(F.col("role") == "assistant", F.array_join(F.filter(lines, lambda x: ~x.rlike(_TOOL)), "\n")).otherwise(F.col("text"))
    cost = lambda c: F.ceil(F.length(c) / 4).cast("long")
    return table(spark, d, "conversations").select("conv_id", "turn", cost(F.col("text")).alias("full"), cost(bare).alias("bare"))


@query(
    f"""WITH RECURSIVE t AS (SELECT conv_id, turn, CAST(ceil(length(text) / 4) AS BIGINT) AS full_,
  CAST(ceil(length(CASE WHEN role = 'assistant' THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '{_TOOL}')), chr(10)) ELSE text END) / 4) AS BIGINT) AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations),
r AS (SELECT conv_id, turn, n, full_ AS cost, false AS stripped, full_ AS spent FROM t WHERE n = 1 AND full_ <= 400
  UNION ALL SELECT t.conv_id, t.turn, t.n, CASE WHEN spent > 200 THEN bare ELSE full_ END, spent > 200, spent + CASE WHEN spent > 200 THEN bare ELSE full_ END
  FROM r JOIN t ON t.conv_id = r.conv_id AND t.n = r.n + 1 WHERE spent + CASE WHEN spent > 200 THEN bare ELSE full_ END <= 400)
SELECT conv_id, turn, cost, stripped, spent FROM r"""
)
def tool_prune(spark, d):
    return running.pruned_turns(_turns(spark, d), 400).select("conv_id", "turn", "cost", "stripped", "spent")


@query(
    """WITH a AS (SELECT conv_id, turn, 'R: ' || substr(text, 1, 200) AS work FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3 ), w AS (SELECT conv_id, string_agg(work, '|' ORDER BY turn) AS completed_work FROM a WHERE trim(substr(work, 4)) <> '' GROUP BY 1),
u AS (SELECT conv_id, substr(min_by(text, turn), 1, 500) AS original_intent FROM conversations WHERE role = 'user' GROUP BY 1) SELECT conv_id, coalesce(original_intent, 'Unknown intent') AS original_intent, coalesce(completed_work, '') AS completed_work, 'Continue R-phase execution' AS next_actions FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN u USING (conv_id) LEFT JOIN w USING (conv_id)"""
)
def compaction_fallback(spark, d):
    rows = running.compaction_fallback(table(spark, d, "conversations"), "R")
    return rows.select("conv_id", "original_intent", F.array_join("completed_work", "|").alias("completed_work"), F.array_join("next_actions", "|").alias("next_actions"))


@query(
    """WITH p AS (SELECT doc_id AS id, CAST(ceil(length(text) / 3) AS BIGINT) AS tokens FROM documents WHERE doc_id % 4 > 0), s AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 25 AS r, (sum(tokens) OVER (ORDER BY id) - tokens) // 10000 AS t FROM p)
SELECT id, tokens, CAST(dense_rank() OVER (ORDER BY r, t, tokens > 10000) - 1 AS INTEGER) AS batch FROM s"""
)
def pending_batches(spark, d):
    """Rows to be embedded, cut into batches of 50 rows and 20,000 tokens at most."""
    rows = table(spark, d, "documents").where("doc_id % 4 > 0").select(F.col("doc_id").alias("id"), F.ceil(F.length("text") / 3).cast("long").alias("tokens"))
    return running.batches(rows, 50, 20_000)


_EDGES = "pairs AS (SELECT DISTINCT l_partkey AS k, 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL), e AS (SELECT p AS src, s AS dst FROM pairs UNION SELECT s, p FROM pairs WHERE k % 3 = 0)"


@query(f"WITH RECURSIVE {_EDGES}, nodes AS (SELECT src AS id FROM e UNION SELECT dst FROM e), reach(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM reach r JOIN e ON r.b = e.src), c AS (SELECT x.a AS id, max(x.b) AS top FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1) SELECT id, greatest(id, coalesce(top, id)) AS comp FROM nodes LEFT JOIN c USING (id)")
def strong_components(spark, d):
    """Strongly connected components of parts and suppliers; every third part has edges back.

    Parts are even numbers and suppliers odd ones on the way, if their keys can be doubled; the name that a component goes by is found at the end, among those of its nodes.
    """
    pairs = table(spark, d, "lineitem").where("l_partkey IS NOT NULL AND l_suppkey IS NOT NULL").withColumn("back", F.col("l_partkey") % 3 == 0)
    high = f"NOT BETWEEN {-(2**62)} AND {2**62 - 1}"
    if not pairs.where(f"l_partkey {high} OR l_suppkey {high}").isEmpty():
        return graph.strong_components(pairs.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), "back"), "back")
    two = F.lit(2).cast("long")
    edges = pairs.select((F.col("l_partkey") * two).alias("src"), (F.col("l_suppkey") * two + 1).alias("dst"), "back")
    comps = stored(graph.strong_components(edges, "back"), "components")
    name = lambda c: F.concat(F.when(F.col(c).bitwiseAND(1) == 0, "p").otherwise("s"), F.shiftright(c, 1))
    tops = small(stored(comps.where("id <> comp").groupBy("comp").agg(F.max(name("id")).alias("top")), "tops"))
    return comps.join(tops, "comp", "left").select(name("id").alias("id"), F.greatest(name("comp"), "top").alias("comp"))


@query(
    f"""WITH RECURSIVE s AS (SELECT p_partkey AS id, p_brand AS project, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, {_TRI.format(c="(p_name || ' ' || p_partkey % 40)")} AS t FROM part),
near AS (SELECT y.id, list(x.id) AS earlier FROM s x JOIN s y ON x.project = y.project AND x.id < y.id AND len(list_intersect(x.t, y.t)) >= 0.6 * len(list_distinct(list_concat(x.t, y.t))) GROUP BY y.id),
rows_ AS (SELECT s.*, coalesce(earlier, []) AS earlier FROM s LEFT JOIN near USING (id)),
r(project, n, kept) AS (SELECT DISTINCT project, 0::BIGINT, []::BIGINT[] FROM s UNION ALL SELECT r.project, p.n, CASE WHEN len(list_intersect(p.earlier, r.kept)) > 0 THEN r.kept ELSE list_append(r.kept, p.id) END FROM r JOIN rows_ p ON p.project = r.project AND p.n = r.n + 1),
kept AS (SELECT unnest(kept) AS id FROM r QUALIFY row_number() OVER (PARTITION BY project ORDER BY n DESC) = 1),
best AS (SELECT y.id, x.id AS other_id, len(list_intersect(x.t, y.t)) / CAST(len(list_distinct(list_concat(x.t, y.t))) AS DOUBLE) AS similarity FROM (SELECT id, unnest(earlier) AS e FROM rows_ WHERE id NOT IN (SELECT id FROM kept)) y0 JOIN s y USING (id) JOIN s x ON x.id = y0.e WHERE x.id IN (SELECT id FROM kept) QUALIFY row_number() OVER (PARTITION BY y.id ORDER BY similarity DESC, x.id) = 1)
SELECT id, CASE WHEN other_id IS NULL THEN 'ADD' ELSE 'SKIP' END AS op, other_id, round(similarity, 4) AS similarity FROM s LEFT JOIN best USING (id)"""
)
def memory_writes(spark, d):
    """A finished log of writes, worked off as the stream does it: a duplicate of a row that was kept before in its project is skipped."""
    name = F.concat_ws(" ", "p_name", (F.col("p_partkey") % 40).cast("string"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("project"), name.alias("text"))
    return store.write_log(rows, 0.6)


_PHRASE = r"list_slice(regexp_extract_all(text, '[A-Za-z]+'), {a}, {b})"


@query(rf"""WITH rules AS (SELECT item_id AS rule_id, array_to_string({_PHRASE.format(a=1, b=3)}, '\W+') AS pattern FROM benchmark UNION ALL SELECT item_id + 1000000, '(?i)' || array_to_string({_PHRASE.format(a=2, b=3)}, '[^a-z]+') || '|' || array_to_string({_PHRASE.format(a=6, b=8)}, ' ') FROM benchmark)
SELECT doc_id, rule_id FROM documents JOIN rules ON regexp_matches(text, pattern)""")
def phrase_findings(spark, d):
    """Two rules for each benchmark item, from words of its text, over all documents."""
    words = lambda a, n: F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), a, n)
    items = table(spark, d, "benchmark")
    first = items.select(F.col("item_id").alias("rule_id"), F.array_join(words(1, 3), r"\W+").alias("pattern"))
    second = items.select((F.col("item_id") + 1_000_000).alias("rule_id"), F.concat(F.lit("(?i)"), F.array_join(words(2, 2), "[^a-z]+"), F.lit("|"), F.array_join(words(6, 3), " ")).alias("pattern"))
    return scan.matches(table(spark, d, "documents").select("doc_id", "text"), first.unionByName(second)).select("doc_id", "rule_id")


@query(r"""WITH files AS (SELECT 'd' || doc_id % 9 || '/' || regexp_extract(text, '[A-Za-z]{3,}') || '.md' AS path, text FROM documents), asked AS (SELECT DISTINCT path, regexp_extract(path, '/([^/]*)\.md$', 1) AS name FROM files),
words AS (SELECT DISTINCT path AS src, unnest(regexp_extract_all(text, '[\p{L}\p{N}_-]+')) AS name FROM files) SELECT DISTINCT path FROM asked a WHERE NOT EXISTS (SELECT 1 FROM words w WHERE w.name = a.name AND w.src <> a.path)""")
def unreferenced_files(spark, d):
    """Files, named by the first word of their text, whose name no other file has as a word."""
    path = F.concat(F.lit("d"), (F.col("doc_id") % 9).cast("string"), F.lit("/"), F.regexp_extract("text", "[A-Za-z]{3,}", 0), F.lit(".md"))
    return scan.unreferenced(table(spark, d, "documents").select(path.alias("path"), "text")).distinct()
