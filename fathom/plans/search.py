"""Retrieval: lexical, vector and fused search, similarity, near-duplicates, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import scalars, text
from fathom.operators import evaluate, retrieval, similarity, vectors

from .base import query, table
from .views import AS_OF_S, MEMORY, as_of, memory

QUERIES = [(1, "the disgusting token of retition"), (2, "de la elle password"), (3, "der die und zu einkeit")]
_VALUES = ", ".join(f"({i}, '{q}')" for i, q in QUERIES)


def _tokens(c: str) -> str:
    spaced = rf"replace(regexp_replace(regexp_replace({c}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '_', ' ')"
    return rf"list_filter(regexp_extract_all(lower({spaced}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: NOT regexp_full_match(t, '[0-9]+'))"


_BM25 = rf"""asked AS (SELECT query_id, unnest(list_distinct({_tokens("query")})) AS term FROM (VALUES {_VALUES}) v(query_id, query)),
parts AS (SELECT doc_id AS id, {_tokens("text")} AS body, {_tokens("source")} AS label FROM documents),
sized AS (SELECT *, len(list_distinct(body)) AS dl FROM parts), stats AS (SELECT count(*) AS n, greatest(1.0, avg(dl)) AS avgdl FROM sized),
words AS (SELECT id, dl, unnest(body) AS term, 1 AS in_body FROM sized UNION ALL SELECT id, dl, unnest(label), 0 FROM sized),
hits AS (SELECT id, dl, term, count(*) AS tf, sum(in_body) AS in_body, max(1 - in_body) AS labelled FROM words WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) FILTER (WHERE in_body > 0) AS df FROM hits GROUP BY 1),
weighed AS (SELECT h.*, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) AS idf, tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.6::DOUBLE + 0.6::DOUBLE * greatest(dl, 1) / avgdl)) * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) AS plain FROM hits h JOIN df USING (term), stats),
bm25 AS (SELECT query_id, id, sum(CASE WHEN labelled = 1 THEN least(plain * 1.5::DOUBLE, 3.0::DOUBLE * idf) ELSE plain END) AS score FROM weighed JOIN asked USING (term) GROUP BY 1, 2)"""


def _asked(spark):
    return spark.createDataFrame(QUERIES, "query_id int, query string")


def _docs(spark, d):
    return table(spark, d, "documents").withColumnRenamed("doc_id", "id")


@query(f"WITH {_BM25} SELECT query_id, id, round(score, 6) AS score FROM bm25")
def bm25_search(spark, d):
    return retrieval.bm25(_docs(spark, d), _asked(spark), label_col="source").select("query_id", "id", F.round("score", 6).alias("score"))


_COSINE = "list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v)))"
_VECTORS = "vectors AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_LEGS = f"""{_BM25}, {_VECTORS}, lex AS (SELECT id, round(score, 6) AS score FROM bm25 WHERE query_id = 1 ORDER BY score DESC, id LIMIT 20), vec AS (SELECT x.id, round({_COSINE}, 6) AS score FROM vectors x, vectors y WHERE y.id = 0 ORDER BY 2 DESC, 1 LIMIT 20),
fused AS (SELECT id, rank_bm25, rank_vector, 1.0::DOUBLE / (60 + coalesce(rank_bm25, 21)) + 1.0::DOUBLE / (60 + coalesce(rank_vector, 21)) AS rrf_score FROM (SELECT id, CAST(rank() OVER (ORDER BY score DESC) AS INTEGER) AS rank_bm25 FROM lex) FULL JOIN (SELECT id, CAST(rank() OVER (ORDER BY score DESC) AS INTEGER) AS rank_vector FROM vec) USING (id))"""


def _legs(spark, d):
    lex = retrieval.bm25(_docs(spark, d), _asked(spark).where("query_id = 1"), label_col="source").select("id", F.round("score", 6).alias("score"))
    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    first = v.where("id = 0").select(F.col("embedding").alias("q"))
    vec = v.crossJoin(F.broadcast(first)).select("id", F.round(text.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))  # one query vector
    return lex, vec


@query(f"WITH {_LEGS} SELECT id, rank_bm25, rank_vector, round(rrf_score, 6) AS rrf_score FROM fused")
def hybrid_rrf(spark, d):
    return retrieval.fused(*_legs(spark, d)).withColumn("rrf_score", F.round("rrf_score", 6))


_BONUS = "CASE coalesce(source, 'agent') WHEN 'lesson-learned' THEN 4 WHEN 'best-practice' THEN 4 WHEN 'auto_learning' THEN 3 WHEN 'web_search_result' THEN 3 WHEN 'session-learning' THEN 3 WHEN 'distilled' THEN 2 WHEN 'rpetd_phase' THEN 1 ELSE 0 END"
_TERMS = f"{_BONUS} + least(ln(1 + applied_count), 3.0::DOUBLE) - least(0.5::DOUBLE * (greatest(floor(({AS_OF_S} - created_s) / 86400), 0) / 30.0::DOUBLE), 3.0::DOUBLE)"


@query(f"WITH {MEMORY}, {_LEGS} SELECT m.id, source, round(least(rrf_score * 300, 10.0::DOUBLE) + {_TERMS}, 2) AS score FROM fused JOIN memory m USING (id) ORDER BY score DESC, id LIMIT 10")
def memory_search_fused(spark, d):
    found = retrieval.fused(*_legs(spark, d))
    rows = memory(spark, d).join(F.broadcast(found), "id")  # at most 40 rows
    score = retrieval.composite(retrieval.fused_relevance(F.col("rrf_score")), F.col("source"), F.col("applied_count"), scalars.age_days("created_at", as_of()))
    return rows.select("id", "source", score.alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query(f"WITH {MEMORY} SELECT id, round(0.0::DOUBLE + {_TERMS}, 2) AS score FROM memory")
def composite_scores(spark, d):
    score = retrieval.composite(F.lit(0.0), F.col("source"), F.col("applied_count"), scalars.age_days("created_at", as_of()))
    return memory(spark, d).select("id", score.alias("score"))


@query(f"WITH {MEMORY}, s AS (SELECT id, CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'token') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'pathetic') THEN 1 ELSE 0 END AS hits, source, applied_count, created_s FROM memory) SELECT id, CAST(hits AS INTEGER) AS hits, round(hits + {_TERMS}, 2) AS score FROM s WHERE hits > 0 ORDER BY score DESC, id LIMIT 20")
def like_search(spark, d):
    m = memory(spark, d).withColumn("hits", text.term_hits(F.col("text"), ["the", "token", "pathetic"])).where("hits > 0")
    score = retrieval.composite(F.col("hits"), F.col("source"), F.col("applied_count"), scalars.age_days("created_at", as_of()))
    return m.select("id", "hits", score.alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query("SELECT item_id, CAST(2 * (CASE WHEN contains(lower(left(text, 40)), 'the') THEN 1 ELSE 0 END) + CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + 2 * (CASE WHEN contains(lower(left(text, 40)), 'ing') THEN 1 ELSE 0 END) + CASE WHEN contains(lower(text), 'ing') THEN 1 ELSE 0 END AS INTEGER) AS score FROM benchmark WHERE contains(lower(text), 'the') OR contains(lower(text), 'ing')")
def knowledge_like_search(spark, d):
    b = table(spark, d, "benchmark")
    score = 2 * text.term_hits(F.left("text", F.lit(40)), ["the", "ing"]) + text.term_hits(F.col("text"), ["the", "ing"])
    return b.select("item_id", score.cast("int").alias("score")).where("score > 0")


@query(f"WITH {_VECTORS} SELECT query_id, id, CAST(rank AS INTEGER) AS rank, similarity FROM (SELECT y.id AS query_id, x.id, row_number() OVER (PARTITION BY y.id ORDER BY round({_COSINE}, 6) DESC, x.id) AS rank, round({_COSINE}, 6) AS similarity FROM vectors x JOIN vectors y ON y.id % 50 = 0 AND x.id <> y.id) WHERE rank <= 3")
def vector_knn(spark, d):
    return _knn(spark, d, 3)


_KNN = f"WITH {_VECTORS} SELECT query_id, id, CAST(rank AS INTEGER) AS rank, similarity FROM (SELECT y.id AS query_id, x.id, row_number() OVER (PARTITION BY y.id ORDER BY round({_COSINE}, 6) DESC, x.id) AS rank, round({_COSINE}, 6) AS similarity FROM vectors x JOIN vectors y ON y.id % 50 = 0 AND x.id <> y.id) WHERE rank <= 10"


@query(_KNN)
def vector_index_knn(spark, d):
    """The ten nearest rows of every row whose id is divisible by 50, from an index of 16 cells that is read in rounds."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.search(vectors.built(v, cells=16), asked, 10)


def _knn(spark, d, k):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.search(vectors.built(v), asked, k)


@query(f"WITH {_VECTORS}, r AS (SELECT y.id AS query_id, x.id, row_number() OVER (PARTITION BY y.id ORDER BY round({_COSINE}, 6) DESC, x.id) AS rank, x.label = y.label AS good FROM vectors x JOIN vectors y ON y.id % 50 = 0 AND x.id <> y.id), e AS (SELECT query_id, min(id) AS id FROM r WHERE good GROUP BY 1) SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr FROM e JOIN r USING (query_id, id)")
def known_item_mrr(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "label")
    return evaluate.reciprocal_rank(_knn(spark, d, 10), evaluate.known_items(v, q), 10)


@query(f"WITH {_VECTORS}, r AS (SELECT y.id AS query_id, x.id, row_number() OVER (PARTITION BY y.id ORDER BY round({_COSINE}, 6) DESC, x.id) AS rank FROM vectors x JOIN vectors y ON y.id % 50 = 0 AND x.id <> y.id), f AS (SELECT id, count(*) AS n FROM r WHERE rank = 1 GROUP BY 1) SELECT sum(n)::BIGINT AS answered, count(*) AS distinct_top1, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS largest_share FROM f")
def top1_concentration(spark, d):
    return evaluate.top1_concentration(_knn(spark, d, 1))


@query(f"WITH {_VECTORS} SELECT x.id, round({_COSINE}, 6) AS similarity FROM vectors x, vectors y WHERE y.id = 7 AND x.id <> 7 AND {_COSINE} >= 0.2 ORDER BY 2 DESC, 1 LIMIT 3")
def semantic_cache_lookup(spark, d):
    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    q = v.where("id = 7").select(F.col("embedding").alias("q"))
    rows = v.where("id <> 7").crossJoin(F.broadcast(q)).select("id", text.cosine(F.col("embedding"), F.col("q")).alias("similarity"))  # one query vector
    return rows.where("similarity >= 0.2").select("id", F.round("similarity", 6).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(3)


@query(f"WITH {_VECTORS} SELECT query_id, id, CAST(rank AS INTEGER) AS rank, similarity FROM (SELECT y.id AS query_id, x.id, row_number() OVER (PARTITION BY y.id ORDER BY round({_COSINE}, 6) DESC, x.id) AS rank, round({_COSINE}, 6) AS similarity FROM vectors x JOIN vectors y ON y.id % 50 = 0 AND x.id <> y.id) WHERE rank <= 3 AND similarity >= 0.2")
def semantic_cache_rows(spark, d):
    return _knn(spark, d, 3).where("similarity >= 0.2")


_WHITE = r"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\s+'), lambda t: t <> ''))"
_WORDS = "list_distinct(list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 3))"
_JACCARD = "CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END"
_ASK = "The threat of and the ing token with disgusting stha"


@query(f"WITH s AS (SELECT doc_id, {_WHITE.format(c='text')} AS a, {_WHITE.format(c=repr(_ASK))} AS b FROM documents) SELECT doc_id, round({_JACCARD}, 6) AS similarity FROM s")
def jaccard_tokens(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.white_tokens(F.col("text")).alias("tokens"))  # once a row, not at each use
    return rows.select("doc_id", F.round(text.jaccard(F.col("tokens"), text.white_tokens(F.lit(_ASK))), 6).alias("similarity"))


@query(f"WITH s AS (SELECT doc_id, {_WORDS.format(c='text')} AS a, {_WORDS.format(c=repr(_ASK))} AS b FROM documents) SELECT doc_id, round({_JACCARD}, 6) AS similarity FROM s")
def jaccard_words(spark, d):
    rows = _sets(spark, d).withColumnRenamed("id", "doc_id")  # words once a row, not at each use
    return rows.select("doc_id", F.round(text.jaccard(F.col("tokens"), text.word_set(F.lit(_ASK))), 6).alias("similarity"))


_TRI = r"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"WITH s AS (SELECT item_id, {_TRI.format(c='text')} AS a, {_TRI.format(c=repr(_ASK))} AS b FROM benchmark) SELECT item_id, round({_JACCARD}, 6) AS similarity FROM s")
def trigram_similarity(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.round(text.jaccard(text.trigrams(F.col("text")), text.trigrams(F.lit(_ASK))), 6).alias("similarity"))


_NEAR = f"""toks AS (SELECT doc_id AS id, {_WORDS.format(c='text')} AS t FROM documents), w AS (SELECT id, len(t) AS n, unnest(t) AS g FROM toks), c AS (SELECT x.id AS a, y.id AS b, count(*) AS c, any_value(x.n + y.n) AS total FROM w x JOIN w y ON x.g = y.g AND x.id < y.id AND least(x.n, y.n) >= 0.7 * greatest(x.n, y.n) GROUP BY 1, 2), near AS (SELECT a, b, c / CAST(total - c AS DOUBLE) AS similarity FROM c WHERE c >= 0.7 * (total - c))"""


@query(f"WITH {_NEAR} SELECT a, b, round(similarity, 6) AS similarity FROM near")
def similar_pairs(spark, d):
    return similarity.similar_pairs(_sets(spark, d), 0.7).withColumn("similarity", F.round("similarity", 6))


def _sets(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.word_set(F.col("text")).alias("tokens"))


@query()
def distill_clusters(spark, d):
    m = memory(spark, d)
    return similarity.merged_clusters(m, similarity.leaders(m.select("id"), _sets(spark, d), 0.7)).where("n > 1").select("leader", "n", "applied_count", F.array_join("ids", ",").alias("ids"))


@query(f"WITH {_NEAR}, hit AS (SELECT CASE WHEN a % 2 = 0 THEN a ELSE b END AS id FROM near WHERE a % 2 <> b % 2) SELECT id FROM toks WHERE id % 2 = 0 AND id NOT IN (SELECT id FROM hit)")
def novelty_filter(spark, d):
    s = _sets(spark, d)
    return similarity.novel(s.where("id % 2 = 0"), s.where("id % 2 = 1"), 0.7).select("id")


@query(rf"SELECT doc_id, len({_tokens('text')}) AS n FROM documents")
def identifier_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n"))


@query(
    f"""WITH {_VECTORS} SELECT query_id, id, CAST(rank AS INTEGER) AS rank, similarity, similarity >= 0.6 AS used, age_days FROM (SELECT y.id AS query_id, x.id, x.id % 200 AS age_days, row_number() OVER (PARTITION BY y.id ORDER BY round({_COSINE}, 6) DESC, x.id) AS rank, round({_COSINE}, 6) AS similarity
  FROM vectors x JOIN vectors y ON y.id % 50 = 0 AND x.id <> y.id WHERE x.id % 200 <= 90) WHERE rank <= 3"""
)
def recent_neighbours(spark, d):
    """The three nearest rows of the last 90 days, and whether they are alike enough to be used, of every row whose id is divisible by 50; rows are id modulo 200 days old."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    near = vectors.search(vectors.built(v.where("id % 200 <= 90")), asked, 3)
    return near.withColumn("used", F.col("similarity") >= 0.6).withColumn("age_days", F.col("id") % 200)
