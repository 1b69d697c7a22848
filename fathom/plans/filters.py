"""Predicates and projections of the store (search filters, lists, inboxes, guards)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.functions import scalars
from fathom.operators import store

from .base import query, table
from .views import AS_OF_S, EVENTS, MEMORY, TASKS, as_of, events, memory, tasks


@query(f"WITH {MEMORY} SELECT id, source FROM memory WHERE (project_id IS NULL OR project_id <> '__test__') AND source NOT IN ('task_event', 'rpetd_phase') AND list_has_any(tags, ['pg', 'es']) AND invalid_s IS NULL")
def memory_filter(spark, d):
    return store.memory_filter(memory(spark, d), tags=["pg", "es"], valid_column="invalid_s").select("id", "source")


@query(f"WITH {MEMORY} SELECT id FROM memory WHERE project_id = 'de' AND source = 'auto_learning'")
def memory_filter_scoped(spark, d):
    return store.memory_filter(memory(spark, d), project_id="de", source="auto_learning").select("id")


@query("SELECT page_id FROM pages WHERE url = 'http://a' OR starts_with(url, 'https://blog/') OR url LIKE 'https://m.%'")
def path_scope(spark, d):
    p = table(spark, d, "pages")
    return p.where(store.beneath(F.col("url"), "http://a") | store.beneath(F.col("url"), "https://blog") | store.literal_prefix(F.col("url"), "https://m.")).select("page_id")


@query(f"WITH {TASKS} SELECT id, status, priority FROM tasks WHERE lower(assigned_to) = 'agent3' AND status = 'pending' AND type = 'bug' AND sprint = 'S1'")
def task_list(spark, d):
    return tasks(spark, d).where((F.lower("assigned_to") == "agent3") & (F.col("status") == "pending") & (F.col("type") == "bug") & (F.col("sprint") == "S1")).select("id", "status", "priority")


@query(f"WITH {TASKS} SELECT coalesce(nullif(trim(project_id), ''), 'default') AS project, count(*) AS n FROM tasks GROUP BY 1")
def project_default(spark, d):
    return tasks(spark, d).groupBy(F.coalesce(F.nullif(F.trim("project_id"), F.lit("")), F.lit("default")).alias("project")).agg(F.count("*").alias("n"))


@query(f"WITH {TASKS} SELECT id FROM tasks WHERE contains(lower(concat_ws(' ', status, priority, assigned_to, type, sprint, project_id)), 'agent1 epic s')")
def task_search(spark, d):
    return tasks(spark, d).where(F.lower(F.concat_ws(" ", "status", "priority", "assigned_to", "type", "sprint", "project_id")).contains("agent1 epic s")).select("id")


@query(f"WITH {MEMORY} SELECT id, created_s FROM memory WHERE project_id = 'en' ORDER BY created_s DESC, id LIMIT 25 OFFSET 10")
def memory_list(spark, d):
    return memory(spark, d).where("project_id = 'en'").orderBy(F.desc("created_s"), "id").offset(10).limit(25).select("id", "created_s")


@query(f"WITH {EVENTS} SELECT id, event_type, at_s FROM log WHERE task_id = 7 AND event_type = 'error' AND at_s >= 1704412800 AND at_s < 1706140800 ORDER BY at_s DESC, id DESC LIMIT 100")
def audit_slice(spark, d):
    return events(spark, d).where("task_id = 7 AND event_type = 'error' AND at_s >= 1704412800 AND at_s < 1706140800").orderBy(F.desc("at_s"), F.desc("id")).limit(100).select("id", "event_type", "at_s")


@query(f"WITH {EVENTS} SELECT id, severity, status FROM log WHERE status = 'open' AND severity IN ('high', 'critical') AND at_s >= 1705000000 ORDER BY at_s DESC, id DESC LIMIT 200")
def findings_sweep(spark, d):
    return events(spark, d).where("status = 'open' AND severity IN ('high', 'critical') AND at_s >= 1705000000").orderBy(F.desc("at_s"), F.desc("id")).limit(200).select("id", "severity", "status")


@query(f"WITH {EVENTS} SELECT id, at_s FROM log WHERE task_id = 11 ORDER BY at_s DESC")
def findings_by_task(spark, d):
    return events(spark, d).where("task_id = 11").orderBy(F.desc("at_s")).select("id", "at_s")


@query(f"WITH {EVENTS} SELECT id, status FROM log WHERE recipient = 'agent3' AND status IN ('open', 'ticketed')")
def inbox(spark, d):
    return events(spark, d).where(F.col("recipient") == "agent3").where(F.col("status").isin("open", "ticketed")).orderBy("at_s", "id").select("id", "status")


@query(f"WITH {EVENTS} SELECT id FROM log WHERE recipient IS NULL OR recipient = 'agent2' ORDER BY at_s DESC, id DESC LIMIT 5")
def blackboard(spark, d):
    return events(spark, d).where("recipient IS NULL OR recipient = 'agent2'").orderBy(F.desc("at_s"), F.desc("id")).limit(5).select("id")


@query(f"WITH {EVENTS} SELECT id FROM log WHERE severity = 'critical' AND at_s >= (SELECT max(at_s) FROM log) - 86400 ORDER BY at_s DESC, id DESC LIMIT 3")
def security_recent(spark, d):
    e = events(spark, d)
    last = e.agg(F.max("at_s").alias("last"))
    return e.crossJoin(F.broadcast(last)).where((F.col("severity") == "critical") & (F.col("at_s") >= F.col("last") - 86400)).orderBy(F.desc("at_s"), F.desc("id")).limit(3).select("id")


@query(f"WITH {EVENTS} SELECT id, event_type FROM log WHERE task_id = 3 AND gate_failed IS NOT NULL ORDER BY at_s, id")
def session_decisions(spark, d):
    return events(spark, d).where("task_id = 3 AND gate_failed IS NOT NULL").orderBy("at_s", "id").select("id", "event_type")


@query(f"WITH {MEMORY} SELECT id, text, source FROM memory WHERE id = 42")
def point_lookup(spark, d):
    return memory(spark, d).where("id = 42").select("id", "text", "source")


@query(f"WITH {TASKS} SELECT t.id, t.status, count(x.id) = 0 AS deps_met FROM tasks t LEFT JOIN (SELECT id, unnest(dependencies) AS dep FROM tasks) w ON w.id = t.id LEFT JOIN tasks x ON x.id = w.dep AND x.status <> 'done' WHERE t.assigned_to = 'agent5' AND t.status IN ('pending', 'in_progress', 'failed', 'validation') GROUP BY t.id, t.status")
def agent_tasks(spark, d):
    from fathom.operators.tasks import with_deps_met

    return with_deps_met(tasks(spark, d)).where("assigned_to = 'agent5' AND status IN ('pending', 'in_progress', 'failed', 'validation')").select("id", "status", "deps_met")


@query("SELECT vec_id, label FROM embeddings")
def vectors_stripped(spark, d):
    return store.without_vectors(table(spark, d, "embeddings"))


@query(f"WITH {MEMORY} SELECT id FROM memory WHERE NOT (coalesce(regexp_matches(text, 'AKIA|token ='), false) OR coalesce(source IN ('agent'), false))")
def purged(spark, d):
    return store.purged(memory(spark, d), text_pattern="AKIA|token =", sources=["agent"]).select("id")


@query(f"WITH {MEMORY}, c AS (SELECT source, project_id, count(*) AS n FROM memory GROUP BY 1, 2) SELECT m.id FROM memory m JOIN c ON m.source IS NOT DISTINCT FROM c.source AND m.project_id IS NOT DISTINCT FROM c.project_id WHERE c.n < 3")
def event_guard(spark, d):
    return store.below_count(memory(spark, d), ["source", "project_id"], 3).select("id")


@query(f"WITH {EVENTS} SELECT id FROM (SELECT id, at_s, lag(at_s) OVER (PARTITION BY agent_id, event_type ORDER BY at_s, id) AS prev FROM log) WHERE prev IS NULL OR at_s - prev > 10")
def repeat_guard(spark, d):
    return store.first_within(events(spark, d), ["agent_id", "event_type"], "at_s", 10).select("id")


@query(f"WITH {MEMORY} SELECT source, max(created_s) AS created_s, arg_max(id, created_s) AS id FROM memory GROUP BY source")
def latest_by_source(spark, d):
    return store.latest_per_key(memory(spark, d).select("id", "source", "created_s"), ["source"], "created_s")


@query(f"WITH {MEMORY} SELECT id, CASE WHEN invalid_s IS NULL THEN 1 ELSE 0 END AS valid, CAST(greatest(floor(({AS_OF_S} - created_s) / 86400), 0) AS BIGINT) AS days FROM memory")
def memory_age(spark, d):
    return memory(spark, d).select("id", F.col("invalid_s").isNull().cast("int").alias("valid"), scalars.age_days("created_at", as_of()).alias("days"))


@query("SELECT DISTINCT lower(p_name) AS title FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE lower(q.p_name) = lower(p.p_name) AND q.p_partkey < p.p_partkey AND q.p_size = p.p_size)")
def title_guard(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("title"), "p_size")
    first = p.groupBy("title", "p_size").agg(F.min("p_partkey").alias("p_partkey"))
    return p.join(first, ["title", "p_size", "p_partkey"], "left_semi").select("title").distinct()


@query(f"WITH {EVENTS} SELECT task_id, id, outcome, CAST(row_number() OVER (PARTITION BY task_id ORDER BY at_s DESC, id DESC) AS INTEGER) AS place FROM log WHERE gate_failed IS NOT NULL OR outcome = 'pass'")
def validation_history(spark, d):
    """Each task's validations, the newest first."""
    place = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("at_s"), F.desc("id")))
    return events(spark, d).where("gate_failed IS NOT NULL OR outcome = 'pass'").select("task_id", "id", "outcome", place.alias("place"))
