"""Reports and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import scalars
from fathom.operators import analytics, store
from fathom.operators import tasks as task_ops

from .base import query, table
from .views import AS_OF_S, EVENTS, MEMORY, TASKS, events, memory, tasks


@query(f"WITH {TASKS} SELECT status, count(*) AS n FROM tasks GROUP BY status")
def count_by_status(spark, d):
    return tasks(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {MEMORY} SELECT source, count(*) AS n FROM memory GROUP BY source")
def count_by_source(spark, d):
    return memory(spark, d).groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {MEMORY}, t AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM memory) GROUP BY 1) SELECT tag, n, (SELECT count(*) FROM t) AS distinct_tags FROM t ORDER BY n DESC, tag LIMIT 20")
def tag_histogram(spark, d):
    return analytics.tag_histogram(memory(spark, d), 20)


@query(f"WITH {MEMORY} SELECT count(*) AS n FROM memory WHERE project_id = 'fr' AND source <> 'agent'")
def memory_count(spark, d):
    return memory(spark, d).where("project_id = 'fr' AND source <> 'agent'").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT agent_id, count(*) AS total, count(*) FILTER (WHERE outcome = 'pass') AS passed, count(*) FILTER (WHERE outcome = 'fail') AS failed, round(avg(value) FILTER (WHERE value IS NOT NULL), 1) AS avg_minutes, round(CAST(count(*) FILTER (WHERE outcome = 'pass') AS DOUBLE) / count(*), 3) AS pass_rate FROM log GROUP BY agent_id")
def agent_summary(spark, d):
    return analytics.agent_summary(events(spark, d))


@query(f"WITH {EVENTS} SELECT gate_failed, count(*) AS n FROM log WHERE gate_failed IS NOT NULL GROUP BY 1 ORDER BY n DESC, gate_failed LIMIT 5")
def common_failures(spark, d):
    return events(spark, d).where("gate_failed IS NOT NULL").groupBy("gate_failed").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gate_failed").limit(5)


@query(f"WITH {EVENTS} SELECT id, gate_failed, round(({AS_OF_S} - at_s) / 3600.0::DOUBLE, 1) AS hours_ago FROM log WHERE outcome = 'fail' ORDER BY at_s DESC, id DESC LIMIT 3")
def recent_failures(spark, d):
    return events(spark, d).where("outcome = 'fail'").orderBy(F.desc("at_s"), F.desc("id")).limit(3).select("id", "gate_failed", F.round((AS_OF_S - F.col("at_s")) / 3600, 1).alias("hours_ago"))


@query(f"WITH {EVENTS} SELECT agent_id, count(*) AS n, CAST(round(avg(value)) AS INTEGER) AS avg_time, CAST(round(avg(k)) AS INTEGER) AS avg_tokens, round(CAST(sum(CASE WHEN outcome = 'fail' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 3) AS error_rate, round(CAST(sum(CASE WHEN outcome = 'pass' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 3) AS pass_rate FROM log GROUP BY agent_id")
def agent_metrics(spark, d):
    return analytics.agent_metrics(events(spark, d))


@query(f"WITH {MEMORY} SELECT count(*) AS total, count(embedding_model) AS embedded, round(100.0::DOUBLE * count(embedding_model) / greatest(count(*), 1), 1) AS pct FROM memory")
def embedding_coverage(spark, d):
    return analytics.coverage(memory(spark, d), "embedding_model")


@query(f"WITH {MEMORY} SELECT coalesce(source, '-') AS source, count(*) AS n, count(*) >= 50 AS due FROM memory WHERE source IS NULL OR source <> 'distilled' GROUP BY 1")
def distill_status(spark, d):
    return memory(spark, d).where("source IS NULL OR source <> 'distilled'").groupBy(F.coalesce("source", F.lit("-")).alias("source")).agg(F.count("*").alias("n"), (F.count("*") >= 50).alias("due"))


@query(f"WITH {MEMORY} SELECT coalesce(agent_id, 'unknown') AS agent, count(*) AS n FROM memory GROUP BY 1")
def memory_per_agent(spark, d):
    return memory(spark, d).groupBy(F.coalesce("agent_id", F.lit("unknown")).alias("agent")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "agent")


@query(f"WITH {TASKS}, u AS (SELECT 'type' AS dimension, type AS key, status FROM tasks UNION ALL SELECT 'status', status, status FROM tasks UNION ALL SELECT 'assigned_to', assigned_to, status FROM tasks UNION ALL SELECT 'sprint', coalesce(sprint, '-'), status FROM tasks UNION ALL SELECT 'project_id', coalesce(project_id, '-'), status FROM tasks) SELECT dimension, key, count(*) AS n, count(*) FILTER (WHERE status = 'done') AS done FROM u GROUP BY 1, 2")
def task_stats(spark, d):
    return task_ops.stats(tasks(spark, d))


_SCORED = f"""{TASKS}, pressure AS (SELECT dep AS id, count(*) AS n FROM (SELECT unnest(dependencies) AS dep FROM tasks) GROUP BY 1),
scored AS (SELECT t.*, round((CASE WHEN priority = 'critical' THEN least(5, importance + 1) ELSE importance END) * 0.4::DOUBLE + (CASE WHEN floor((due_s - {AS_OF_S}) / 86400) <= 0 THEN 5 WHEN floor((due_s - {AS_OF_S}) / 86400) <= 1 THEN least(5, urgency + 2) WHEN floor((due_s - {AS_OF_S}) / 86400) <= 3 THEN least(5, urgency + 1) ELSE urgency END) * 0.3::DOUBLE + least(5, coalesce(p.n, 0)) * 0.3::DOUBLE, 2) AS score, coalesce(p.n, 0) AS dependents FROM tasks t LEFT JOIN pressure p USING (id)),
blocked AS (SELECT w.id, count(*) AS blocking FROM (SELECT id, unnest(dependencies) AS dep FROM tasks) w JOIN tasks x ON x.id = w.dep WHERE x.status <> 'done' GROUP BY 1)"""


@query(f"WITH {_SCORED} SELECT s.status, c.n, c.complete_ratio, CAST(place AS INTEGER) AS place, s.id, s.score FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY score DESC, id) AS place FROM scored) s JOIN (SELECT status, count(*) AS n, round(avg(CASE WHEN rpetd_complete THEN 1.0::DOUBLE ELSE 0 END), 4) AS complete_ratio FROM tasks GROUP BY 1) c USING (status) WHERE place <= 5")
def board(spark, d):
    return task_ops.board(tasks(spark, d), AS_OF_S)


@query(f"WITH {_SCORED} SELECT id, score, dependents FROM scored")
def task_scores(spark, d):
    return task_ops.scored(tasks(spark, d), AS_OF_S).select("id", "score", "dependents")


@query(f"WITH {_SCORED} SELECT id, coalesce(blocking, 0) AS blocking, coalesce(blocking, 0) = 0 AS deps_met FROM tasks LEFT JOIN blocked USING (id)")
def deps_met(spark, d):
    return task_ops.with_deps_met(tasks(spark, d)).select("id", "blocking", "deps_met")


@query(f"WITH {_SCORED}, tiers AS (SELECT s.*, CASE WHEN status = 'pending' AND b.id IS NULL THEN 0 WHEN status = 'failed' THEN 1 END AS tier FROM scored s LEFT JOIN blocked b USING (id)) SELECT assigned_to, id, score, CASE WHEN tier = 0 THEN 'next' ELSE 'retry' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY assigned_to ORDER BY tier, score DESC, created_s, id) AS r FROM tiers WHERE tier IS NOT NULL) WHERE r = 1")
def next_task(spark, d):
    return task_ops.next_tasks(tasks(spark, d), AS_OF_S)


@query(f"WITH {TASKS} SELECT sprint, count(*) AS n, count(*) FILTER (WHERE status = 'done') AS done FROM tasks WHERE sprint IS NOT NULL GROUP BY sprint")
def sprint_stats(spark, d):
    return tasks(spark, d).where("sprint IS NOT NULL").groupBy("sprint").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "done").alias("done"))


@query(f"WITH {EVENTS} SELECT task_id, count(*) FILTER (WHERE event_type = 'signup') AS propose, count(*) FILTER (WHERE event_type = 'click') AS agree, count(*) FILTER (WHERE event_type = 'view') AS dissent, count(*) FILTER (WHERE event_type = 'error') AS block FROM log GROUP BY task_id")
def decision_tally(spark, d):
    kind = F.when(F.col("event_type") == "signup", "propose").when(F.col("event_type") == "click", "agree").when(F.col("event_type") == "view", "dissent").when(F.col("event_type") == "error", "block")
    return analytics.tally(events(spark, d).withColumn("kind", kind), "task_id", "kind", ["propose", "agree", "dissent", "block"])


@query(f"WITH {EVENTS} SELECT count(*) AS entries, count(*) FILTER (WHERE status = 'open') AS valid, sum(CASE WHEN outcome = 'pass' THEN 1 ELSE 0 END)::BIGINT AS hits, round(sum(CASE WHEN outcome = 'pass' THEN 1.0::DOUBLE ELSE 0 END) / count(*), 4) AS hit_rate, sum(CASE WHEN outcome = 'pass' THEN k ELSE 0 END)::BIGINT AS tokens_saved FROM log")
def cache_stats(spark, d):
    hit = F.col("outcome") == "pass"
    return events(spark, d).agg(F.count("*").alias("entries"), F.count_if(F.col("status") == "open").alias("valid"), F.sum(hit.cast("int")).alias("hits"), F.round(F.sum(hit.cast("double")) / F.count("*"), 4).alias("hit_rate"), F.sum(F.when(hit, F.col("k")).otherwise(0)).cast("long").alias("tokens_saved"))


@query(f"WITH {MEMORY} SELECT embedding_model AS model, count(*) AS n, CAST(sum(ceil(length(text) / 3)) AS BIGINT) AS tokens FROM memory WHERE embedding_model IS DISTINCT FROM 'model-1' GROUP BY 1")
def model_guard(spark, d):
    return analytics.other_models(memory(spark, d), "embedding_model", "model-1")


@query("SELECT source, CAST(sum(ceil(length(text) / 3)) AS BIGINT) AS tokens FROM documents GROUP BY source")
def token_census(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum(scalars.token_estimate("text")).alias("tokens"))


@query(f"WITH {MEMORY} SELECT id, CASE WHEN applied_count >= 10 THEN 'needs_review' ELSE 'rising' END AS kind, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS preview FROM memory WHERE applied_count >= 5 AND source <> 'best-practice'")
def promotion_candidates(spark, d):
    m = memory(spark, d).where("applied_count >= 5 AND source <> 'best-practice'")
    return m.select("id", F.when(F.col("applied_count") >= 10, "needs_review").otherwise("rising").alias("kind"), scalars.preview(F.lit(None).cast("string"), F.col("text")).alias("preview"))


@query(f"WITH {MEMORY} SELECT id, source FROM memory WHERE created_s < {AS_OF_S} - 86400 * CASE source WHEN 'task_event' THEN 30 WHEN 'rpetd_phase' THEN 90 WHEN 'web_search_result' THEN 180 END")
def retention(spark, d):
    return store.expired(memory(spark, d), AS_OF_S).select("id", "source")


@query(f"WITH {EVENTS} SELECT agent_id, count(*) FILTER (WHERE outcome = 'fail' AND (last IS NULL OR id > last)) AS failures, count(*) FILTER (WHERE outcome = 'fail' AND (last IS NULL OR id > last)) >= 3 AS open FROM log JOIN (SELECT agent_id, max(id) FILTER (WHERE outcome = 'pass') AS last FROM log GROUP BY 1) USING (agent_id) GROUP BY agent_id")
def circuit_breakers(spark, d):
    return task_ops.circuit_breakers(events(spark, d))


@query(f"WITH {EVENTS}, r AS (SELECT agent_id, id, k, row_number() OVER (PARTITION BY agent_id ORDER BY at_s DESC, id DESC) AS r FROM log) SELECT agent_id, round(avg(k) FILTER (WHERE r BETWEEN 2 AND 4), 4) AS rolling, max(k) FILTER (WHERE r = 1) AS current, coalesce(max(k) FILTER (WHERE r = 1) > avg(k) FILTER (WHERE r BETWEEN 2 AND 4) + 15, false) AS warn FROM r WHERE r <= 4 GROUP BY agent_id")
def score_drift(spark, d):
    return analytics.drift(events(spark, d), "agent_id", "k", ["at_s", "id"])


@query(f"WITH {EVENTS} SELECT agent_id, count(*) FILTER (WHERE id > coalesce(last, -1)) AS since FROM log JOIN (SELECT agent_id, max(id) FILTER (WHERE event_type = 'signup') AS last FROM log GROUP BY 1) USING (agent_id) GROUP BY agent_id")
def since_last(spark, d):
    return analytics.since_last(events(spark, d), "agent_id", F.col("event_type") == "signup")


@query(f"WITH {EVENTS} SELECT event_type, severity, count(*) AS n, round(sum(value), 2) AS total FROM log GROUP BY 1, 2")
def labelled_counters(spark, d):
    return events(spark, d).groupBy("event_type", "severity").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT p_brand AS category, count(*) AS n FROM part GROUP BY 1")
def category_counts(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT id, spent, CASE WHEN spent > 50000 THEN 'over' WHEN spent > 40000 THEN 'warn' ELSE 'ok' END AS verdict FROM (SELECT id, sum(k) OVER (PARTITION BY agent_id ORDER BY at_s, id)::BIGINT AS spent FROM log)")
def budget_verdict(spark, d):
    return analytics.budget_verdict(events(spark, d), "agent_id", "k", ["at_s", "id"], 50_000, 40_000).select("id", "spent", "verdict")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), g AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM l), i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM g) SELECT doc_id, CAST(island AS BIGINT) AS island, any_value(line) AS line, count(*) AS times FROM i GROUP BY 1, 2 HAVING count(*) > 1")
def adjacent_repeats(spark, d):
    return analytics.adjacent_repeats(table(spark, d, "documents"), "doc_id", "text").where("times > 1")


@query("SELECT coalesce(nullif(regexp_extract(url, '^https?://([^/]+)', 1), ''), '-') AS host, count(*) AS n, sum(length(html))::BIGINT AS size FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 10")
def matches_per_file(spark, d):
    p = table(spark, d, "pages")
    host = F.coalesce(F.nullif(F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("")), F.lit("-"))
    return p.groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.sum(F.length("html")).cast("long").alias("size")).orderBy(F.desc("n"), "host").limit(10)
