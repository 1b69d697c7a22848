"""Bundles for agents, reranked searches, patches, hub files, backfill runs and condensed output."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import condensed, scalars
from fathom.operators import backfill, calibration, graph, hydration, retrieval, similarity, store, vectors
from fathom.operators import tasks as task_ops
from fathom.storage import new_path

from .aggregates import _SCORED
from .asked import _BM25, _NEAR, _lexical, _questions
from .base import SQL, query, table
from .relations import _supply
from .search import _COSINE, _TERMS, _VECTORS
from .search import _NEAR as _PAIRS
from .views import AS_OF_S, EVENTS, MEMORY, as_of, events, memory, tasks

_WHITE = r"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\s+'), lambda t: t <> ''))"


@query(
    f"""WITH {EVENTS}, {_VECTORS}, agents AS (SELECT DISTINCT agent_id, CAST(substr(agent_id, 6) AS BIGINT) AS n FROM log WHERE id % 3 = 0),
near AS (SELECT agent_id, x.id, row_number() OVER (PARTITION BY agent_id ORDER BY round({_COSINE}, 6) DESC, x.id) AS place FROM agents JOIN vectors y ON y.id = n % 37 * 10 JOIN vectors x ON x.id % 10 > 0 QUALIFY place <= 5),
board AS (SELECT a.agent_id, l.id, row_number() OVER (PARTITION BY a.agent_id ORDER BY at_s DESC, l.id DESC) AS place FROM agents a JOIN log l ON recipient IS NULL OR recipient = a.agent_id QUALIFY place <= 5),
last AS (SELECT agent_id, max_by(l.id, {{'t': at_s, 'i': l.id}}) AS id FROM log l WHERE agent_id IN (SELECT agent_id FROM agents) GROUP BY 1),
alerts AS (SELECT id, row_number() OVER (ORDER BY at_s DESC, id DESC) AS place FROM log WHERE severity = 'critical' AND at_s >= (SELECT max(at_s) FROM log) - 86400 QUALIFY place <= 3)
SELECT agent_id, 'memory' AS section, place::INT AS place, id FROM near UNION ALL SELECT agent_id, 'blackboard', place, id FROM board UNION ALL SELECT agent_id, 'recent_activity', 1, id FROM last UNION ALL SELECT agent_id, 'security', place, id FROM agents, alerts"""
)
def hydration_bundle(spark, d):
    """The bundle of every agent of every third event; an agent's role is one of the vectors whose id is divisible by 10, the others are memories."""
    log = events(spark, d)
    n = F.substring("agent_id", 6, 20).cast("long")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    agents = log.where("id % 3 = 0").select("agent_id").distinct().withColumn("n", n % 37 * 10)
    agents = agents.join(v.select(F.col("id").alias("n"), F.col("embedding").alias("role")), "n", "left").drop("n")
    return hydration.bundle(agents, v.where("id % 10 > 0"), log)


@query(
    f"""WITH {MEMORY}, {_BM25}, {_VECTORS}, {_NEAR}, ok AS (SELECT * FROM memory WHERE invalid_s IS NULL AND (project_id IS NULL OR project_id <> '__test__') AND coalesce(source, 'agent') NOT IN ('task_event', 'rpetd_phase')),
v AS (SELECT query_id, p.id, round(p.score * 10 + {_TERMS}, 2) AS score, 'vector+rerank' AS engine FROM (SELECT * FROM pairs JOIN ok USING (id) WHERE query_id % 150 > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pairs.score DESC, id) <= 40) p),
t AS (SELECT query_id, id, round(b.score * 10 + {_TERMS}, 2) AS score, 'text_fallback' AS engine FROM bm25 b JOIN ok USING (id) WHERE query_id NOT IN (SELECT query_id FROM v) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY b.score DESC, id) <= 40),
w AS (SELECT v.* FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20),
r AS (SELECT query_id, w.id, w.score, len(list_intersect({_WHITE.format(c="array_to_string(words, ' ')")}, {_WHITE.format(c="substr(text, 1, 500)")})) / CAST(greatest(len({_WHITE.format(c="array_to_string(words, ' ')")}), 1) AS DOUBLE) AS relevance FROM w JOIN memory m ON m.id = w.id JOIN questions USING (query_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, score DESC, id) <= 10 AS chosen FROM r),
f AS (SELECT query_id, id, score AS score_composite, CASE WHEN chosen THEN round(relevance, 4) END AS rerank_score, CASE WHEN chosen THEN round(score + 4 * relevance, 2) ELSE score END AS score, 'vector+rerank' AS engine FROM c
  UNION ALL SELECT query_id, id, score, NULL, score, engine FROM t)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10"""
)
def semantic_reranked(spark, d):
    """Semantic search with reranking; every third query has no vector and falls back to words."""
    rows = retrieval.searchable(memory(spark, d))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = v.where("id % 50 = 0 AND id % 150 > 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    days = scalars.age_days("created_at", as_of())
    scored = lambda found, relevance: found.join(rows, "id").select("query_id", "id", retrieval.composite(relevance, F.col("source"), F.col("applied_count"), days).alias("score"))
    near = scored(vectors.search(vectors.built(v.join(rows.select("id"), "id", "left_semi")), asked, 40), F.col("similarity") * 10)
    first = retrieval.reranked_per_query(near, _questions(spark, d), rows.select("id", "text"))
    shown = F.expr("invalid_s IS NULL AND (project_id IS NULL OR project_id <> '__test__')") & ~F.coalesce("source", F.lit("agent")).isin("task_event", "rpetd_phase")
    words = _lexical(spark, d, 40, asked=_questions(spark, d).join(near.select("query_id").distinct(), "query_id", "left_anti"), among=shown)
    second = retrieval.best_per_query(scored(words.drop("rank").withColumnRenamed("score", "text_rank"), F.col("text_rank") * 10), 10)
    second = second.select("query_id", "id", F.col("score").alias("score_composite"), F.lit(None).cast("double").alias("rerank_score"), "score", "rank", F.lit("text_fallback").alias("engine"))
    return first.withColumn("engine", F.lit("vector+rerank")).unionByName(second)


_FIELDS = {"status": ["open", "ticketed", "closed"], "severity": None}


@query(
    f"""WITH {EVENTS}, p AS (SELECT id // 2 AS key, at_s, id, CASE WHEN id % 3 = 0 THEN 'severity' WHEN id % 3 = 1 THEN 'status' ELSE 'owner' END AS field, CASE WHEN id % 3 = 0 THEN CASE WHEN k > 5 THEN event_type END WHEN k % 4 = 0 THEN 'unknown' ELSE status END AS value FROM log),
last AS (SELECT * FROM p WHERE (field = 'status' AND value IN ('open', 'ticketed', 'closed')) OR field = 'severity' QUALIFY row_number() OVER (PARTITION BY key, field ORDER BY at_s DESC, id DESC) = 1)
SELECT l.id, CASE WHEN s.key IS NULL THEN l.status ELSE s.value END AS status, CASE WHEN v.key IS NULL THEN l.severity ELSE v.value END AS severity FROM log l LEFT JOIN (SELECT * FROM last WHERE field = 'status') s ON s.key = l.id LEFT JOIN (SELECT * FROM last WHERE field = 'severity') v ON v.key = l.id"""
)
def status_patches(spark, d):
    """Findings after patches: every event changes a field of the finding with half its id; some values and one field are not allowed."""
    log = events(spark, d)
    n = F.col("id")
    field = F.when(n % 3 == 0, "severity").when(n % 3 == 1, "status").otherwise("owner")
    value = F.when(n % 3 == 0, F.when(F.col("k") > 5, F.col("event_type"))).when(F.col("k") % 4 == 0, "unknown").otherwise(F.col("status"))
    patches = log.select(F.floor(n / 2).alias("id"), field.alias("field"), value.alias("value"), F.col("at_s").alias("at"), n.alias("seq"))
    return store.patched(log.select("id", "status", "severity"), patches, _FIELDS)


@query("WITH RECURSIVE " + SQL["pagerank_rounds"].removeprefix("WITH RECURSIVE ").rsplit(" SELECT ", 1)[0] + ", f AS (SELECT substr(id, 1, 3) AS file, round(sum(rank), 6) AS pagerank FROM r WHERE i = 12 GROUP BY 1) SELECT file, pagerank FROM f ORDER BY pagerank DESC, file LIMIT 20")
def hub_files(spark, d):
    """The 20 files with most PageRank after twelve rounds; the first three characters of a node name its file."""
    ranks = graph.pagerank(*_supply(spark, d), rounds=12, tolerance=0)
    return graph.hubs(ranks, ranks.select("id", F.substring("id", 1, 3).alias("file")))


@query("SELECT 1 AS run, count(*) AS texts, count(DISTINCT text) AS different, 0::BIGINT AS from_store, count(DISTINCT text) AS embedded FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 2, count(*), count(DISTINCT text), (SELECT count(DISTINCT text) FROM documents WHERE doc_id % 2 = 0), count(DISTINCT text) - (SELECT count(DISTINCT text) FROM documents WHERE doc_id % 2 = 0) FROM documents")
def embedding_reuse(spark, d):
    """What two runs of embedding find in the store of vectors: first every second document, then all."""
    docs, path = table(spark, d, "documents").select("doc_id", "text"), new_path(spark, "vectors")
    runs = [backfill.with_vectors(rows, path)[1] for rows in (docs.where("doc_id % 2 = 0"), docs)]
    return spark.createDataFrame([(i + 1, *r.values()) for i, r in enumerate(runs)], "run int, texts long, different long, from_store long, embedded long")


@query("SELECT doc_id AS id, CAST(ceil(length(text) / 3) AS BIGINT) AS tokens FROM documents WHERE doc_id % 4 > 0")
def resumed_backfill(spark, d):
    """A backfill of all pending rows that stops at its budget twice and is resumed."""
    rows = table(spark, d, "documents").where("doc_id % 4 > 0").select(F.col("doc_id").alias("id"), F.ceil(F.length("text") / 3).cast("long").alias("tokens"), "text")
    path, total = new_path(spark, "backfill"), rows.agg(F.sum("tokens")).first()[0] or 1
    embed = lambda wave: wave.withColumn("digest", F.col("id").cast("string")).join(backfill.hashed_vectors(wave.select(F.col("id").cast("string").alias("digest"), "text")), "digest").select("id", "tokens", "vector")
    for budget in (max(1, total // 2), max(1, total // 3), total):
        backfill.run(rows, embed, path, budget, most_rows=500, most_tokens=400_000, wave=1, together=128)
    return backfill.results(spark, path).select("id", "tokens")


_LINE = "CASE WHEN k % 3 = 0 THEN 'tick' WHEN event_type = 'error' THEN 'an ERROR in ' || k ELSE event_type || ' ' || k END"


@query(
    f"WITH {EVENTS}, l AS (SELECT id, {_LINE} AS line, lag({_LINE}) OVER (PARTITION BY id // 700 ORDER BY id) AS before FROM log)"
    + """, g AS (SELECT id // 700 AS log, id, line, sum(CASE WHEN line IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY id // 700 ORDER BY id) AS g FROM l), d AS (SELECT log, g, any_value(line) || CASE WHEN count(*) > 1 THEN ' (×' || count(*) || ')' ELSE '' END AS line, count(*) AS c FROM g GROUP BY log, g),
n AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY g) AS p, count(*) OVER (PARTITION BY log) AS kinds, sum(c) OVER (PARTITION BY log) AS lines FROM d),
m AS (SELECT log, count(*) AS gone FROM n WHERE kinds > 200 AND p > 40 AND p <= kinds - 40 AND NOT regexp_matches(line, '(?i)error|fail|warning|panic|exception') GROUP BY log),
o AS (SELECT log, p, line FROM n WHERE kinds <= 200 OR p <= 40 OR p > kinds - 40 OR regexp_matches(line, '(?i)error|fail|warning|panic|exception') UNION ALL SELECT DISTINCT log, kinds - 40 + 0.5, '… ' || coalesce(gone, 0) || ' lines elided (raw available) …' FROM n LEFT JOIN m USING (log) WHERE kinds > 200),
r AS (SELECT log, string_agg(line, chr(10) ORDER BY p) AS t FROM o GROUP BY log), raw AS (SELECT id // 700 AS log, string_agg(line, chr(10) ORDER BY id) AS t, count(*) AS n FROM l GROUP BY 1)
SELECT log, CASE WHEN n < 30 OR length(r.t) >= length(raw.t) THEN raw.t ELSE r.t || chr(10) || '… output compressed (raw available) …' || chr(10) END AS output FROM raw JOIN r USING (log)"""
)
def elided_logs(spark, d):
    """Logs of 700 events each, shortened."""
    line = F.when(F.col("k") % 3 == 0, "tick").when(F.col("event_type") == "error", F.concat(F.lit("an ERROR in "), F.col("k").cast("string"))).otherwise(F.concat_ws(" ", "event_type", F.col("k").cast("string")))
    logs = events(spark, d).groupBy(F.floor(F.col("id") / 700).alias("log")).agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("lines"))
    text = logs.select("log", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))
    return text.select("log", condensed.elided_log(F.col("text")).alias("output"))


@query(
    f"""WITH {EVENTS}, l AS (SELECT agent_id, id, CASE WHEN k = 7 AND id % 5 = 0 THEN 'plain line' WHEN k % 10 = 0 THEN '{{"Other":' || id || '}}' ELSE '{{"Names":"c' || id || '","Image":"' || event_type || '","Status":"up ' || k || '"}}' END AS line, CASE WHEN k % 10 > 0 THEN 'c' || id || '  ' || event_type || '  up ' || k END AS told, k = 7 AND id % 5 = 0 AS broken FROM log)
SELECT agent_id, CASE WHEN bool_or(broken) OR count(told) = 0 THEN string_agg(line, chr(10) ORDER BY id) ELSE 'docker ps: ' || count(told) || CASE WHEN count(told) = 1 THEN ' container' ELSE ' containers' END || chr(10) || string_agg(told, chr(10) ORDER BY id) || chr(10) || count(told) || ' containers — raw: docker ps --format json' || chr(10) END AS output FROM l GROUP BY agent_id"""
)
def container_lists(spark, d):
    k, n = F.col("k"), F.col("id").cast("string")
    line = F.when((k == 7) & (F.col("id") % 5 == 0), "plain line").when(k % 10 == 0, F.concat(F.lit('{"Other":'), n, F.lit("}"))).otherwise(F.concat(F.lit('{"Names":"c'), n, F.lit('","Image":"'), "event_type", F.lit('","Status":"up '), k.cast("string"), F.lit('"}')))
    logs = events(spark, d).groupBy("agent_id").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("lines"))
    return logs.select("agent_id", condensed.container_list(F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("output"))


def _json(c: str) -> str:
    """A string as ASCII JSON in SQL, for signs of the basic plane."""
    return rf"""'"' || array_to_string(list_transform(string_split({c}, ''), lambda x: CASE WHEN x = chr(10) THEN '\n' WHEN x = chr(9) THEN '\t' WHEN x = chr(13) THEN '\r' WHEN x = '"' THEN '\"' WHEN x = '\' THEN '\\' WHEN unicode(x) >= 127 OR unicode(x) < 32 THEN '\u' || lower(lpad(hex(unicode(x)), 4, '0')) ELSE x END), '') || '"'"""


@query(f"""SELECT doc_id, sha256('{{"active_constraints": [], "completed_work": [' || {_json("source")} || ', ' || {_json("lang")} || '], "current_state": null, "next_actions": [' || {_json("lang")} || '], "original_intent": ' || {_json("text")} || ', "relevant_files": ["f' || doc_id || '.md"], "task_id": "T' || doc_id || '"}}') AS version FROM documents""")
def context_versions(spark, d):
    n = F.col("doc_id").cast("string")
    version = condensed.context_version(F.concat(F.lit("T"), n), F.col("text"), F.array("source", "lang"), F.lit(None).cast("string"), F.array().cast("array<string>"), F.array(F.concat(F.lit("f"), n, F.lit(".md"))), F.array("lang"))
    return table(spark, d, "documents").select("doc_id", version.alias("version"))


_DOMAINS = ["security", "database", "testing", "caching", "frontend", "unmapped"]


@query(
    f"""WITH {_BM25}, q AS (SELECT query_id, array_to_string(words, ' ') AS query FROM questions), v AS (SELECT (['{"','".join(_DOMAINS)}'])[doc_id % 6 + 1] AS domain, unnest(regexp_extract_all(text, '\\w+')[1:40]) AS word, doc_id AS place FROM documents WHERE doc_id % 97 = 1),
p AS (SELECT domain, min(place) AS place FROM v GROUP BY 1), w AS (SELECT DISTINCT domain, lower(word) AS word FROM (SELECT domain, word FROM v UNION ALL SELECT domain, domain FROM p)),
o AS (SELECT query_id, domain, count(*) AS overlap FROM (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[A-Za-z0-9_]{{3,}}')) AS word FROM q) JOIN w USING (word) GROUP BY 1, 2),
d AS (SELECT query_id, domain, overlap FROM o JOIN p USING (domain) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, coalesce(list_position(['database', 'api', 'security', 'frontend', 'backend', 'infrastructure'], domain), 99), place) = 1),
t AS (SELECT query_id, coalesce(domain, 'unknown') AS domain, coalesce(overlap, 0) AS overlap, query, CASE WHEN domain IN ('database', 'caching') THEN 'cross-domain' WHEN domain = 'security' THEN 'constraint-removal' ELSE 'lateral' END AS third FROM q LEFT JOIN d USING (query_id)),
u AS (SELECT *, unnest([{{'type': 'inversion', 'query': query || ' failures common mistakes'}}, {{'type': 'anti-pattern', 'query': query || ' anti-patterns worst practices'}}, {{'type': third, 'query': CASE third WHEN 'lateral' THEN 'natural systems analogy ' || query WHEN 'cross-domain' THEN 'alternative approaches ' || query || ' tradeoffs' ELSE 'unlimited resources approach ' || query END}}]) AS x FROM t)
SELECT query_id, domain, overlap, x.type AS type, array_to_string(string_split(x.query, ' ')[1:8], ' ') AS variant FROM u"""
)
def query_variants(spark, d):
    """The domain of every question by its words, and three other questions. The vocabulary comes from every 97th document."""
    docs = table(spark, d, "documents").where("doc_id % 97 = 1")
    domain = F.element_at(F.array(*map(F.lit, _DOMAINS)), (F.col("doc_id") % 6 + 1).cast("int"))
    vocabulary = docs.select(domain.alias("domain"), F.explode(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)), 1, 40)).alias("keyword"), F.col("doc_id").alias("place"))
    asked = _questions(spark, d)
    found = retrieval.detected_domains(asked, vocabulary, condensed.FIRST_DOMAINS).join(asked, "query_id")
    rows = found.select("query_id", "domain", "overlap", F.explode(condensed.query_variants(F.col("query"), F.col("domain"))).alias("v"))
    return rows.select("query_id", "domain", "overlap", F.col("v.type").alias("type"), F.col("v.query").alias("variant"))


@query(
    f"""WITH RECURSIVE {_VECTORS}, f AS (SELECT vec_id AS id, embedding, list_transform(range(8), lambda j: CAST((vec_id * (j + 3) + label * j) % (5 + j) AS DOUBLE)) AS x, CAST(label % 3 = 0 AS DOUBLE) AS y FROM embeddings),
near AS (SELECT y.id AS query_id, x.id, round({_COSINE}, 6) AS similarity, row_number() OVER (PARTITION BY y.id ORDER BY round({_COSINE}, 6) DESC, x.id) AS rank FROM vectors x JOIN vectors y ON y.id % 50 = 0 AND x.id <> y.id AND x.id % 3 > 0 QUALIFY rank <= 20),
s AS (SELECT query_id, count(*) AS n, avg(similarity) AS mean, list(f.x ORDER BY rank) AS x, list(f.y ORDER BY rank) AS y FROM near JOIN f USING (id) GROUP BY query_id),
m AS (SELECT s.*, t.x AS target, list_transform(range(1, 9), lambda j: CASE list_max(list_transform(s.x, lambda r: r[j])) WHEN 0 THEN 1.0::DOUBLE ELSE list_max(list_transform(s.x, lambda r: r[j])) END) AS most FROM s JOIN f t ON t.id = s.query_id),
z AS (SELECT query_id, n, mean, y, list_transform(x, lambda r: list_transform(range(1, 9), lambda j: r[j] / most[j])) AS x, list_transform(range(1, 9), lambda j: target[j] / most[j]) AS target FROM m),
r AS (SELECT query_id, 0 AS step, list_transform(range(8), lambda j: 0.0::DOUBLE) AS w FROM z
  UNION ALL SELECT query_id, step + 1, list_transform(range(1, 9), lambda j: w[j] - 0.05::DOUBLE * (list_sum(list_transform(range(1, n + 1), lambda i: x[i][j] * (1 / (1 + exp(-list_dot_product(x[i], w))) - y[i]))) / n + 0.01::DOUBLE / n * w[j])) FROM r JOIN z USING (query_id) WHERE step < 50),
p AS (SELECT query_id, n, mean, 1 / (1 + exp(-list_dot_product(target, w))) AS p FROM r JOIN z USING (query_id) WHERE step = 50),
q AS (SELECT p.*, CAST(query_id * 7 % 101 AS INTEGER) AS raw, mean < 0.26 AS cold FROM p),
c AS (SELECT *, CASE WHEN cold THEN CASE WHEN raw <= 30 THEN 31 WHEN raw <= 60 THEN 61 ELSE raw END WHEN p > 0.7 THEN greatest(raw - 5, 0) WHEN p < 0.3 THEN least(raw + 10, 100) ELSE raw END AS score FROM q)
SELECT query_id, score::INT AS calibrated_score, CASE WHEN cold THEN 0 ELSE round(p, 8) END AS confidence, n::INT AS neighbour_count, cold AS cold_start, (score - raw)::INT AS adjustment FROM c"""
)
def calibrated_tasks(spark, d):
    """Scores of the tasks whose id is divisible by 50, calibrated by the 20 completions (ids not divisible by 3) nearest to each."""
    j = F.sequence(F.lit(0), F.lit(7))
    x = F.transform(j, lambda i: ((F.col("vec_id") * (i + 3) + F.col("label") * i) % (5 + i)).cast("double"))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", x.alias("features"), (F.col("label") % 3 == 0).alias("passed"))
    tasks = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"), "features", (F.col("id") * 7 % 101).cast("int").alias("raw_score"))
    done = rows.where("id % 3 > 0")
    near = vectors.search(vectors.built(done), tasks, calibration.NEIGHBOURS)
    out = calibration.calibrated_scores(tasks, done, near, [30, 60, 100], least_similarity=0.26)
    return out.withColumn("confidence", F.round("confidence", 8))


@query(
    f"""WITH RECURSIVE {MEMORY}, {_PAIRS}, e AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM memory WHERE source IS DISTINCT FROM 'distilled' AND id % 9 > 0),
ew AS (SELECT e.*, coalesce((SELECT list(a) FROM near WHERE b = e.id AND a IN (SELECT id FROM e)), []) AS earlier FROM e),
r(n, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT ew.n, CASE WHEN len(list_intersect(ew.earlier, r.kept)) > 0 THEN r.kept ELSE list_append(r.kept, ew.id) END FROM r JOIN ew ON ew.n = r.n + 1),
k AS (SELECT unnest(kept) AS id FROM r WHERE n = (SELECT max(n) FROM r)), l AS (SELECT ew.*, coalesce((SELECT min(x) FROM (SELECT unnest(list_intersect(ew.earlier, (SELECT list(id) FROM k))) AS x)), ew.id) AS leader FROM ew),
g AS (SELECT l.*, count(*) OVER (PARTITION BY leader) AS c, row_number() OVER (PARTITION BY leader ORDER BY length(text) DESC, id) AS p FROM l QUALIFY c > 1),
cite AS (SELECT leader, string_agg(task_id || '@' || at_, ',' ORDER BY at_, task_id) AS citations FROM (SELECT leader, id % 13 AS task_id, min(id % 50) AS at_ FROM g GROUP BY 1, 2) GROUP BY leader)
SELECT leader, any_value(c)::BIGINT AS n, string_agg(id, ',' ORDER BY id) AS ids, sum(applied_count)::BIGINT AS applied_count, coalesce(array_to_string(list_sort(list(DISTINCT source)), ','), '') AS sources, any_value(citations) AS citations, max(CASE WHEN p = 1 THEN id END) AS kept,
  substr(max(CASE WHEN p = 1 THEN text END) || chr(10) || '---' || chr(10) || string_agg(CASE WHEN p > 1 THEN '[merged from ' || coalesce(source, '') || ']: ' || substr(text, 1, 200) END, chr(10) ORDER BY p), 1, 4000) AS text FROM g JOIN cite USING (leader) GROUP BY leader"""
)
def distill_merge(spark, d):
    """Groups of alike memories merged; every ninth row is structured, and each is cited once."""
    cite = F.array(F.struct((F.col("id") % 13).alias("task_id"), (F.col("id") % 50).alias("at")))
    rows = memory(spark, d).withColumn("structured", F.col("id") % 9 == 0).withColumn("citations", cite)
    out = similarity.distilled(rows)
    citations = F.array_join(F.transform("citations", lambda c: F.concat_ws("@", c["task_id"].cast("string"), c["at"].cast("string"))), ",")
    return out.select("leader", "n", F.array_join("ids", ",").alias("ids"), "applied_count", F.array_join("sources", ",").alias("sources"), citations.alias("citations"), "kept", "text")


@query(
    f"""WITH {_SCORED}, g AS (SELECT s.*, b.id IS NULL AS met, status = 'pending' AND id % 7 = 0 AS cooling FROM scored s LEFT JOIN blocked b USING (id)),
own AS (SELECT assigned_to, id, score, CASE WHEN status = 'failed' THEN 'retry' ELSE 'next' END AS kind FROM g WHERE (status = 'pending' AND met AND NOT cooling) OR status = 'failed' QUALIFY row_number() OVER (PARTITION BY assigned_to ORDER BY status = 'failed', score DESC, created_s, id) = 1),
v AS (SELECT 'validator' AS assigned_to, id, score, 'validate' AS kind FROM g WHERE status = 'validation' ORDER BY score DESC, created_s, id LIMIT 1), c AS (SELECT assigned_to, count(*) FILTER (WHERE cooling) AS cooling FROM g GROUP BY 1),
a AS (SELECT DISTINCT assigned_to FROM g UNION SELECT 'validator' UNION SELECT 'idle')
SELECT a.assigned_to AS agent, coalesce(o.kind, v.kind, 'empty') AS kind, coalesce(o.id, v.id) AS id, coalesce(o.score, v.score) AS score, coalesce(cooling, 0) AS cooling FROM a LEFT JOIN own o USING (assigned_to) LEFT JOIN v ON v.assigned_to = a.assigned_to LEFT JOIN c ON c.assigned_to = a.assigned_to"""
)
def queue_heads(spark, d):
    """What every agent, the validator and one without tasks are told; every seventh pending task cools down."""
    rows = tasks(spark, d).withColumn("gate_fail_s", F.when(F.col("id") % 7 == 0, AS_OF_S - 60))
    agents = rows.select(F.col("assigned_to").alias("agent")).distinct().union(spark.createDataFrame([("validator",), ("idle",)], "agent string"))
    return task_ops.queue_heads(rows, agents, AS_OF_S)
