"""Searches that take every row whose id is divisible by 50 as a query, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import scalars, text
from fathom.operators import retrieval, vectors
from fathom.storage import in_blocks

from .base import query, table
from .search import _COSINE, _TERMS, _TRI, _VECTORS, _tokens
from .views import AS_OF_S, MEMORY, as_of, memory

_QUESTIONS = rf"""questions AS MATERIALIZED (SELECT doc_id AS query_id, list_slice({_tokens("text")}, 1, 6) AS words FROM documents WHERE doc_id % 50 = 0)"""
_BM25 = rf"""{_QUESTIONS}, asked AS MATERIALIZED (SELECT DISTINCT query_id, unnest(words) AS term FROM questions),
parts AS MATERIALIZED (SELECT doc_id AS id, {_tokens("text")} AS body FROM documents), sized AS MATERIALIZED (SELECT id, body, len(list_distinct(body)) AS dl FROM parts), stats AS MATERIALIZED (SELECT count(*) AS n, greatest(1.0, avg(dl)) AS avgdl FROM sized),
hits AS MATERIALIZED (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, dl, unnest(body) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY 1),
bm25 AS MATERIALIZED (SELECT query_id, id, count(*) AS terms, round(sum(tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.6::DOUBLE + 0.6::DOUBLE * greatest(dl, 1) / avgdl)) * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)), 6) AS score FROM hits JOIN df USING (term) JOIN asked USING (term), stats GROUP BY 1, 2)"""


def _questions(spark, d):
    """The first six words of every text whose id is divisible by 50."""
    return table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(text.tokens(F.col("text")), 1, 6), " ").alias("query"))


def _lexical(spark, d, k, **limits):
    """The k best rows of every question by words, of all or within limits (see retrieval.bm25_best)."""
    return retrieval.bm25_best(memory(spark, d), limits.pop("asked", _questions(spark, d)), k, **limits)


@query(f"WITH {_BM25} SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, score FROM bm25 QUALIFY rank <= 10")
def bm25_rows(spark, d):
    return _lexical(spark, d, 10).select("query_id", "id", "rank", "score")


_NEAR = f"pairs AS MATERIALIZED (SELECT y.id AS query_id, x.id, round({_COSINE}, 6) AS score FROM vectors x JOIN vectors y ON y.id % 50 = 0 AND x.id <> y.id)"
_TWENTY = "(SELECT query_id, id, CAST(rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS INTEGER) AS {name} FROM (SELECT * FROM {rows} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20))"
_FUSED = f"{_BM25}, {_VECTORS}, {_NEAR}, fused AS (SELECT query_id, id, rank_bm25, rank_vector, 1.0::DOUBLE / (60 + coalesce(rank_bm25, 21)) + 1.0::DOUBLE / (60 + coalesce(rank_vector, 21)) AS rrf FROM {_TWENTY.format(name='rank_bm25', rows='bm25')} FULL JOIN {_TWENTY.format(name='rank_vector', rows='pairs')} USING (query_id, id))"


def _near(spark, d, k):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.search(vectors.built(v), asked, k)


def _fused(spark, d):
    return retrieval.fused_per_query(_lexical(spark, d, 20).drop("rank"), _near(spark, d, 20).select("query_id", "id", F.col("similarity").alias("score")))


@query(f"WITH {_FUSED} SELECT query_id, id, rank_bm25, rank_vector, round(rrf, 6) AS rrf_score FROM fused")
def hybrid_rows(spark, d):
    return _fused(spark, d).withColumn("rrf_score", F.round("rrf_score", 6))


@query(f"WITH {MEMORY}, {_FUSED}, s AS (SELECT query_id, id, source, round(least(rrf * 300, 10.0::DOUBLE) + {_TERMS}, 2) AS score FROM fused JOIN memory m USING (id)) SELECT query_id, id, source, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10")
def memory_search_rows(spark, d):
    """The first rung of the store's search, for all queries."""
    rows = _fused(spark, d).join(memory(spark, d), "id")
    score = retrieval.composite(retrieval.fused_relevance(F.col("rrf_score")), F.col("source"), F.col("applied_count"), scalars.age_days("created_at", as_of()))
    return retrieval.best_per_query(rows.select("query_id", "id", "source", score.alias("score")), 10).drop("rank")


@query(f"WITH {MEMORY}, {_BM25}, best AS (SELECT * FROM bm25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 40), s AS (SELECT query_id, id, b.score AS text_rank, round(b.score * 10 + {_TERMS}, 2) AS score FROM best b JOIN memory USING (id)) SELECT query_id, id, 1 AS rank_bm25, text_rank, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10")
def lexical_search_rows(spark, d):
    """The lexical rung alone, for all queries: no vectors, a constant rank, text_rank times 10 as relevance."""
    best = _lexical(spark, d, 40).drop("rank").withColumnRenamed("score", "text_rank").join(memory(spark, d), "id")
    score = retrieval.composite(F.col("text_rank") * 10, F.col("source"), F.col("applied_count"), scalars.age_days("created_at", as_of()))
    return retrieval.best_per_query(best.select("query_id", "id", F.lit(1).alias("rank_bm25"), "text_rank", score.alias("score")), 10).drop("rank")


@query(f"WITH {MEMORY}, {_VECTORS}, {_NEAR}, ok AS (SELECT * FROM memory WHERE invalid_s IS NULL AND (project_id IS NULL OR project_id <> '__test__') AND coalesce(source, 'agent') NOT IN ('task_event', 'rpetd_phase')), best AS (SELECT query_id, p.id, p.score AS similarity, source, applied_count, created_s FROM pairs p JOIN ok USING (id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p.score DESC, p.id) <= 40), s AS (SELECT query_id, id, round(similarity, 4) AS similarity, round(similarity * 10 + {_TERMS}, 2) AS score FROM best) SELECT query_id, id, similarity, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10")
def semantic_search(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    rows = retrieval.searchable(memory(spark, d))
    near = vectors.search(vectors.built(v.join(rows.select("id"), "id", "left_semi")), asked, 40).drop("rank")
    return retrieval.semantic_search(near, rows, as_of())


_HIGH = "('lesson-learned', 'best-practice', 'auto_learning', 'web_search_result', 'session-learning', 'distilled')"


@query(f"WITH {MEMORY}, {_BM25}, own AS (SELECT m.id AS query_id, project_id AS own FROM memory m WHERE id % 50 = 0), s AS (SELECT query_id, id, round(b.score * 10 + {_TERMS}, 2) AS score, b.score AS text_rank FROM bm25 b JOIN memory m USING (id) JOIN own USING (query_id) WHERE source IN {_HIGH} AND (own IS NULL OR project_id IS NULL OR project_id <> own)), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY text_rank DESC, id) <= 20) SELECT query_id, id, score FROM best")
def cross_project_search(spark, d):
    """Of other projects than the query's own, the rows of valued sources, by lexical rank, with the composite score."""
    m = memory(spark, d)
    own = m.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("project_id").alias("grp"))
    asked = _questions(spark, d).join(own, "query_id")
    rows = _lexical(spark, d, 20, asked=asked, among=F.expr(f"source IN {_HIGH}"), group=F.col("project_id"), relation="other").drop("rank").withColumnRenamed("score", "text_rank").join(m, "id")
    score = retrieval.composite(F.col("text_rank") * 10, F.col("source"), F.col("applied_count"), scalars.age_days("created_at", as_of()))
    return rows.select("query_id", "id", score.alias("score"))


@query(f"WITH {_FUSED}, placed AS (SELECT query_id, f.id, CASE WHEN rank_bm25 IS NOT NULL THEN rrf * (1 - 0.05::DOUBLE * least(1.0::DOUBLE, (f.id % 100) / 99.0::DOUBLE)) END AS decayed FROM fused f JOIN documents ON doc_id = f.id WHERE lang IN ('en', 'de')) SELECT query_id, id, round(coalesce(decayed, 0), 4) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY decayed IS NULL, round(decayed, 9) DESC, id) AS INTEGER) AS place FROM placed")
def code_search(spark, d):
    """Fused search within a folder, with decay by the place in the file; rows without a score come last."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang").where("lang IN ('en', 'de')")
    rows = _fused(spark, d).join(docs, "id")
    decayed = F.when(F.col("rank_bm25").isNotNull(), F.col("rrf_score") * (1 - retrieval.POSITION_DECAY * F.least(F.lit(1.0), (F.col("id") % 100) / 99.0)))
    return retrieval.in_order(rows.withColumn("decayed", decayed), "decayed").select("query_id", "id", F.round(F.coalesce("decayed", F.lit(0.0)), 4).alias("score"), "place")


@query(f"WITH {_VECTORS}, near AS (SELECT y.id AS query_id, x.id, round({_COSINE}, 6) AS similarity FROM vectors x JOIN vectors y ON y.id % 50 = 0 AND x.id < y.id AND x.label = y.label), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS place FROM near), b AS (SELECT query_id, id AS existing_id, similarity FROM top WHERE place = 1) SELECT v.id AS query_id, CASE WHEN similarity >= 0.95 THEN 'NOOP' ELSE 'ADD' END AS op, CASE WHEN similarity >= 0.95 THEN existing_id END AS existing_id, CASE WHEN similarity >= 0.95 THEN round(similarity, 4) END AS similarity FROM vectors v LEFT JOIN b ON b.query_id = v.id WHERE v.id % 50 = 0")
def write_ops(spark, d):
    """What a write does: nothing if an earlier row of its project is as near as 0.95, else it is added."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    asked = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("project"))
    near = vectors.search(vectors.built(v, group=F.col("label")), asked, 3, group=F.col("project"), earlier=True)
    return retrieval.write_ops(asked.select("query_id"), near, 0.95)


@query(f"WITH s AS (SELECT item_id AS id, text, {_TRI.format(c='text')} AS t, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS w FROM benchmark), p AS (SELECT y.id AS query_id, x.id, round(len(list_intersect(x.t, y.t)) / CAST(len(list_distinct(list_concat(x.t, y.t))) AS DOUBLE), 6) AS trigram, round(len(list_intersect(x.w, y.w)) / CAST(len(list_distinct(list_concat(x.w, y.w))) AS DOUBLE), 6) AS words FROM s x JOIN s y ON y.id % 50 = 0 AND x.id <> y.id) SELECT query_id, id, trigram, words, trigram >= 0.6 OR words >= 0.85 AS duplicate FROM p")
def text_dedup(spark, d):
    """Trigrams, and words where these say nothing, of a write against what is there."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), text.trigrams(F.col("text")).alias("t"), text.white_tokens(F.col("text")).alias("w"))
    asked = b.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("t").alias("qt"), F.col("w").alias("qw"))
    both = [F.round(text.jaccard(F.col("t"), F.col("qt")), 6).alias("trigram"), F.round(text.jaccard(F.col("w"), F.col("qw")), 6).alias("words")]
    rows = in_blocks(asked, lambda block: b.crossJoin(block).where("query_id <> id").select("query_id", "id", *both))
    return rows.withColumn("duplicate", (F.col("trigram") >= 0.6) | (F.col("words") >= 0.85))


@query(f"WITH {_VECTORS}, {_NEAR}, best AS (SELECT query_id, id, score FROM pairs WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 3) SELECT query_id, count(*) AS n, round(avg(CASE WHEN id % 3 = 0 THEN 0 ELSE id % 7 END), 2) AS mean_sessions FROM best GROUP BY 1")
def similar_completions(spark, d):
    """Of each query the mean number of sessions (none counts as 0) of the three nearest completions at 0.6 or more."""
    best = retrieval.best_per_query(_near(spark, d, 20).drop("rank").where("similarity >= 0.6"), 3, "similarity")
    sessions = F.when(F.col("id") % 3 > 0, F.col("id") % 7)
    return best.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(sessions, F.lit(0))), 2).alias("mean_sessions"))


_SKILL = "coalesce(source, 'agent')"


@query(f"""WITH {MEMORY}, {_BM25}, {_VECTORS}, {_NEAR}, m AS (SELECT id, {_SKILL} AS skill, created_s FROM memory), scope AS MATERIALIZED (SELECT y.id AS query_id, x.id FROM m x JOIN m y ON y.id % 50 = 0 AND x.skill = y.skill WHERE x.created_s > {AS_OF_S} - 90 * 86400),
b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM bm25 JOIN scope USING (query_id, id) QUALIFY place <= 10),
v AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM pairs JOIN scope USING (query_id, id) QUALIFY place <= 10) WHERE score >= 0.6),
f AS (SELECT query_id, id, coalesce(1.0::DOUBLE / (60 + b.place), 0) + coalesce(1.0::DOUBLE / (60 + v.place), 0) AS rrf FROM b FULL JOIN v USING (query_id, id)) SELECT query_id, id, round(rrf, 6) AS rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS INTEGER) AS place FROM f QUALIFY place <= 3""")
def similar_invocations(spark, d):
    """Past invocations of the query's own skill in the last 90 days, by words and by vector."""
    past = memory(spark, d).select("id", F.coalesce("source", F.lit("agent")).alias("skill"), F.col("created_s").alias("at_s"))
    asked = past.where("id % 50 = 0").select(F.col("id").alias("query_id"), "skill")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(past, "id")
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"), F.col("skill").alias("q_skill"))
    recent = v.where(F.col("at_s") > AS_OF_S - 90 * 86_400)
    near = vectors.search(vectors.built(recent, group=F.col("skill")), q, 10, group=F.col("q_skill"))
    skill = F.coalesce("source", F.lit("agent"))
    words = _lexical(spark, d, 10, asked=_questions(spark, d).join(asked.withColumnRenamed("skill", "grp"), "query_id"), among=F.col("created_s") > AS_OF_S - 90 * 86_400, group=skill, relation="same").drop("rank")
    found = retrieval.similar_invocations(words, near.select("query_id", "id", F.col("similarity").alias("score")), past, asked, AS_OF_S)
    return found.withColumn("rrf_score", F.round("rrf_score", 6))
