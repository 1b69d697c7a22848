"""Modules, lists of records, reports, and the upkeep of caches and indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import modules, store
from fathom.operators import tasks as engine

from .base import query, table
from .views import AS_OF_S, EVENTS, MEMORY, TASKS, events, memory, tasks


def _modules(spark, d):
    """Parts as modules: every 97th is a second row of the one before, each needs the one at a third of its number."""
    size, at = F.col("p_size"), F.col("p_partkey")
    name = F.concat(F.lit("m"), F.when(at % 97 == 0, at - 1).otherwise(at).cast("string"))
    version = F.concat_ws(".", (size % 4).cast("string"), (size % 3).cast("string"), F.lit("0"))
    spec = F.concat(F.when(at % 2 == 0, "^").when(at % 5 == 0, "").otherwise("~"), version)
    return table(spark, d, "part").select(name.alias("name"), version.alias("version"), at.alias("at"), F.concat(F.lit("m"), F.floor(at / 3).cast("string")).alias("dep"), F.when(at % 31 == 0, "latest").otherwise(spec).alias("spec"))


_MODULES = """m AS (SELECT 'm' || CASE WHEN p_partkey % 97 = 0 THEN p_partkey - 1 ELSE p_partkey END AS name, (p_size % 4) || '.' || (p_size % 3) || '.0' AS version, p_partkey AS nr, 'm' || (p_partkey // 3) AS dep, p_size % 4 * 1000000 + p_size % 3 * 1000 AS lo,
  CASE WHEN p_partkey % 31 = 0 THEN 'x' WHEN p_partkey % 2 = 0 THEN '^' WHEN p_partkey % 5 = 0 THEN '' ELSE '~' END AS op, p_size % 4 AS ma, p_size % 3 AS mi FROM part),
firsts AS (SELECT name, min(nr) AS first_at, arg_min(version, nr) AS first_version, arg_min(lo, nr) AS v FROM m GROUP BY 1),
asked AS (SELECT dep, CASE WHEN op = 'x' THEN 'latest' ELSE op || version END AS spec, min(name) AS module, count(*) AS n, any_value(CASE WHEN op <> 'x' THEN lo END) AS lo,
  any_value(CASE WHEN op = '^' AND ma > 0 THEN (ma + 1) * 1000000 WHEN op IN ('^', '~') THEN ma * 1000000 + (mi + 1) * 1000 WHEN op = '' THEN lo + 1 END) AS hi FROM m GROUP BY 1, 2)"""


@query(f"""WITH {_MODULES} SELECT 'duplicate' AS kind, NULL AS dep, name AS module_a, first_version AS range_a, name AS module_b, version AS range_b, 1::BIGINT AS n FROM m JOIN firsts USING (name) WHERE nr > first_at
UNION ALL SELECT 'missing', dep, NULL, NULL, NULL, NULL, sum(n)::BIGINT FROM asked WHERE dep NOT IN (SELECT name FROM firsts) GROUP BY dep
UNION ALL SELECT 'conflict', a.dep, a.module, a.spec, b.module, b.spec, a.n * b.n FROM asked a JOIN asked b ON a.dep = b.dep AND a.spec < b.spec WHERE NOT coalesce(a.lo < b.hi AND b.lo < a.hi, false)
UNION ALL SELECT 'conflict', dep, module, spec, module, spec, n * (n - 1) // 2 FROM asked WHERE lo IS NULL AND n > 1
UNION ALL SELECT 'unmet', dep, module, spec, dep, '=' || first_version, n FROM asked JOIN firsts ON name = dep WHERE NOT coalesce(lo <= v AND v < hi, false)""")
def module_problems(spark, d):
    m = _modules(spark, d)
    return modules.module_problems(m, m.select("name", "dep", "spec"))


@query("SELECT p_partkey AS id, CASE WHEN lower(p_name) = 'cold widget' THEN 0 WHEN contains(lower(p_name), 'cold widget') THEN 1 WHEN contains(lower(p_brand), 'cold widget') THEN 2 END AS tier FROM part WHERE tier IS NOT NULL")
def registry_ranked(spark, d):
    index = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("maintainer"), F.concat_ws(".", F.col("p_size").cast("string"), F.lit("0"), F.lit("0")).alias("version"))
    return modules.registry_ranked(index, " Cold Widget ").select("id", "tier")


@query(f"WITH {EVENTS} SELECT id, task_id, at_s FROM log WHERE task_id = 7")
def context_list(spark, d):
    """All contexts of a task, oldest first."""
    return events(spark, d).where("task_id = 7").select("id", "task_id", "at_s").orderBy("at_s", "id")


@query(f"WITH {MEMORY} SELECT id, applied_count AS importance, created_s FROM memory WHERE project_id = 'en' ORDER BY importance DESC, created_s DESC, id LIMIT 50 OFFSET 50")
def knowledge_list(spark, d):
    """The second page of a category, most important first."""
    rows = memory(spark, d).where("project_id = 'en'").select("id", F.col("applied_count").alias("importance"), "created_s")
    return rows.orderBy(F.desc("importance"), F.desc("created_s"), "id").offset(50).limit(50)


@query(f"WITH {EVENTS} SELECT task_id AS session_id, max(at_s) AS updated_s, count(*) AS updates, arg_max(outcome, id) AS status FROM log GROUP BY 1")
def session_list(spark, d):
    """Sessions, latest update first."""
    return events(spark, d).groupBy(F.col("task_id").alias("session_id")).agg(F.max("at_s").alias("updated_s"), F.count("*").alias("updates"), F.max_by("outcome", "id").alias("status")).orderBy(F.desc("updated_s"), "session_id")


@query(f"WITH {_MODULES} SELECT name AS module_name, arg_max(version, nr) AS version, {AS_OF_S} + min(nr) AS installed_s, CASE WHEN count(*) > 1 THEN {AS_OF_S} + max(nr) END AS upgraded_s FROM m GROUP BY 1")
def install_records(spark, d):
    """A record of each module with its last version, newest first."""
    rows = _modules(spark, d).groupBy(F.col("name").alias("module_name")).agg(F.max_by("version", "at").alias("version"), (AS_OF_S + F.min("at")).alias("installed_s"), F.when(F.count("*") > 1, AS_OF_S + F.max("at")).alias("upgraded_s"))
    return rows.orderBy(F.desc("installed_s"), "module_name")


@query(f"WITH {EVENTS} SELECT round(sum(k) / CAST(sum(k) + sum(CASE WHEN outcome = 'fail' THEN 50 ELSE 0 END) AS DOUBLE), 4) AS hit_rate, sum(k)::BIGINT AS cache_read_tokens, sum(CASE WHEN outcome = 'fail' THEN 50 ELSE 0 END)::BIGINT AS cache_creation_tokens, round(sum(k) / 1000000.0::DOUBLE * 2.7::DOUBLE, 4) AS cost_savings_estimate, count(*) AS total_requests FROM log")
def prompt_cache_stats(spark, d):
    read, made = F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("outcome") == "fail", 50).otherwise(0)), F.lit(0))
    total = events(spark, d).agg(read.alias("cache_read_tokens"), made.alias("cache_creation_tokens"), F.count("*").alias("total_requests"))
    rate = F.when(F.col("cache_read_tokens") + F.col("cache_creation_tokens") > 0, F.col("cache_read_tokens") / (F.col("cache_read_tokens") + F.col("cache_creation_tokens"))).otherwise(0.0)
    saved = F.col("cache_read_tokens") / 1_000_000 * 2.7  # dollars a million tokens read from the cache
    return total.select(F.round(rate, 4).alias("hit_rate"), "cache_read_tokens", "cache_creation_tokens", F.round(saved, 4).alias("cost_savings_estimate"), "total_requests")


@query(f"WITH {MEMORY} SELECT count(*) AS memory_rows, count(embedding_model) AS memory_rows_with_embeddings, (SELECT count(*) FROM pages) AS chunks FROM memory")
def degraded_counts(spark, d):
    m = memory(spark, d).agg(F.count("*").alias("memory_rows"), F.count("embedding_model").alias("memory_rows_with_embeddings"))
    return m.crossJoin(table(spark, d, "pages").agg(F.count("*").alias("chunks")))  # one row each


@query(f"WITH {EVENTS} SELECT k % 7 AS phase_number, round(avg((at_s + k * 1000 - at_s) / 3600.0::DOUBLE), 1) AS mean_hours FROM log GROUP BY 1")
def phase_hours(spark, d):
    e = events(spark, d).select((F.col("k") % 7).alias("phase_number"), ((F.col("at_s") + F.col("k") * 1000 - F.col("at_s")) / 3600.0).alias("hours"))
    return e.groupBy("phase_number").agg(F.round(F.avg("hours"), 1).alias("mean_hours"))


_PATHS = ["tests/test_a.py", "migrations/001.sql", "services/x-daemon.py", "api/users.py", "web/router.py", "README.md", "specs/a.md", "agents/b.md", "src\\core\\c.py", "src/core/d.py"]


@query(f"""WITH f AS (SELECT l_orderkey AS id, list(({_PATHS})[CAST(l_partkey % 10 + 1 AS INTEGER)]) AS f FROM lineitem GROUP BY 1) SELECT id, CAST(len(f) AS INTEGER) AS files_expected, CAST(least(len(list_filter(f, lambda p: starts_with(p, 'tests/'))), 10) AS INTEGER) AS test_impact, CAST(least(len(f) // 3, 10) AS INTEGER) AS dependency_depth,
list_contains(f, 'migrations/001.sql') AS has_migration, list_has_any(f, ['services/x-daemon.py', 'api/users.py', 'web/router.py']) AS has_api_change, CAST(CASE WHEN list_contains(f, 'migrations/001.sql') THEN 4 WHEN list_has_any(f, ['services/x-daemon.py', 'agents/b.md']) THEN 3 WHEN list_contains(f, 'specs/a.md') THEN 2 ELSE 0 END AS INTEGER) AS security_sensitivity,
CAST(len(list_distinct(list_filter(list_transform(f, lambda p: regexp_extract(replace(p, '\\', '/'), '^([^/]+)/', 1)), lambda p: p <> ''))) AS INTEGER) AS top_level_dir_width FROM f""")
def file_features(spark, d):
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("l_partkey") % 10 + 1).cast("int"))
    files = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(path).alias("files"))  # a few lines an order
    return files.select("id", engine.file_features(F.col("files")).alias("f")).select("id", "f.*")


_STEPS, _PHASES, _ALWAYS = ["start", "research", "plan", "check", "approve", "close"], {"research": "R", "plan": "P", "check": "T", "approve": "D"}, {"start", "close"}


@query(f"WITH {TASKS}, s AS (SELECT id, ({_STEPS})[CAST(id % 6 + 1 AS INTEGER)] AS step, CAST(id % 6 + 1 AS INTEGER) AS nr, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN ['p', 'T'] WHEN 2 THEN ['D'] ELSE ['E'] END AS chosen FROM tasks) SELECT id, step, list_filter(list_slice({_STEPS}, nr + 1, 6), lambda t: chosen IS NULL OR t IN ('start', 'close') OR list_contains(chosen, CASE t WHEN 'research' THEN 'R' WHEN 'plan' THEN 'p' WHEN 'check' THEN 'T' WHEN 'approve' THEN 'D' END))[1] AS next_step FROM s")
def next_step(spark, d):
    k = F.col("id")
    chosen = F.when(k % 4 == 1, F.array(F.lit("p"), F.lit("T"))).when(k % 4 == 2, F.array(F.lit("D"))).when(k % 4 == 3, F.array(F.lit("E")))
    rows = tasks(spark, d).select("id", F.element_at(F.array(*map(F.lit, _STEPS)), (k % 6 + 1).cast("int")).alias("step"), chosen.alias("chosen"))
    return rows.select("id", "step", modules.next_step(F.col("step"), F.col("chosen"), _STEPS, _ALWAYS, _PHASES).alias("next_step"))


@query("""WITH i AS (SELECT *, doc_id AS id, (doc_id % 9)::INTEGER AS plan FROM documents WHERE lang IS NOT NULL), c AS (SELECT id, doc_id % 10 = 0 AS own, CASE WHEN id % 7 = 0 AND lang IN ('en', 'de', 'fr') THEN lang WHEN id % 7 = 1 THEN 'de' END AS by_tag, CASE id % 5 WHEN 0 THEN 'en' END AS by_path, id % 5 = 1 AS two_paths, CASE WHEN id % 3 = 0 AND plan IN (0, 3) THEN 'fr' END AS by_plan, id % 3 = 0 AND plan = 6 AS two_owners, CASE id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' END AS by_title FROM i)
SELECT id, CASE WHEN own THEN 'P' ELSE coalesce(by_tag, by_path, by_plan, by_title, 'default') END AS project, CASE WHEN own THEN 'already_set' WHEN by_tag IS NOT NULL THEN 'repo_tag' WHEN by_path IS NOT NULL THEN 'repo_path' WHEN by_plan IS NOT NULL THEN 'plan_owner' WHEN by_title IS NOT NULL THEN 'title_prefix' ELSE 'unchanged' END AS rule, NOT own AND by_tag IS NULL AND two_paths AS path_ambiguous, NOT own AND by_tag IS NULL AND by_path IS NULL AND two_owners AS plan_ambiguous FROM c""")
def project_classes(spark, d):
    k, plan = F.col("id"), F.concat(F.lit("plan:01-0"), (F.col("id") % 9).cast("string"))
    rows = table(spark, d, "documents").where("lang IS NOT NULL").withColumnRenamed("doc_id", "id")
    tag = F.when(k % 7 == 0, F.concat(F.lit("Repo: "), F.col("lang"))).when(k % 7 == 1, 'repo:"german"')
    tags = F.array_compact(F.array(F.lit("x"), tag, F.when(k % 3 == 0, plan)))
    blob = F.when(k % 5 == 0, "see /Users/a/Code/en. and /Users/b/Code/en").when(k % 5 == 1, "/Users/a/Code/en /Users/a/Code/de/x").otherwise("/Users/a/Code/unknown")
    title = F.when(k % 4 == 0, "[German] x").when(k % 4 == 1, "english: x").otherwise("english:x")
    items = rows.select("id", F.when(k % 10 == 0, "P").otherwise(" ").alias("project_id"), tags.alias("tags"), title.alias("title"), blob.alias("blob"))
    owners = spark.createDataFrame([("01-00", "fr"), ("01-03", "fr"), ("01-06", "fr"), ("01-06", "de")], "plan string, checkout string")
    return engine.classified(items, ["en", "de", "fr"], {"german": "de", "english": "en"}, owners)


@query("SELECT doc_id AS id, doc_id % 6 > 0 AND NOT (doc_id % 20 < 10 AND doc_id % 3 <> 1) AND NOT (doc_id % 13 < 2) AS valid FROM documents")
def cache_invalidated(spark, d):
    k = F.col("doc_id")
    name = lambda a, n: F.concat(F.lit(a), (k % n).cast("string"))
    entries = table(spark, d, "documents").select(k.alias("id"), (k % 6 > 0).alias("valid"), F.create_map(name("f", 20), name("h", 3), name("g", 13), F.lit("old")).alias("hashes"))
    changed = spark.range(10).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), F.lit("h1").alias("hash")).unionByName(spark.range(2).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("file"), F.lit("new").alias("hash")))
    return store.cache_invalidated(entries, changed).select("id", "valid")


@query("SELECT count(*) AS checked, count(*) FILTER (WHERE o_orderkey % 7 = 0 AND o_orderkey % 14 = 0) AS skipped_on_purpose, count(*) FILTER (WHERE o_orderkey % 7 = 0 AND o_orderkey % 14 <> 0) AS missing FROM orders")
def keys_arrived(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return store.keys_arrived(o, o.where("o_orderkey % 7 <> 0"), "o_orderkey", o.where("o_orderkey % 14 = 0"))


@query("SELECT doc_id AS id, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) AS tokens FROM documents WHERE doc_id % 4 = 0 OR doc_id % 4 <> 2")
def backfill_pending(spark, d):
    k = F.col("id")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.when(k % 4 > 0, F.array(F.lit(1.0))).alias("vector"), F.when(k % 4 > 0, F.concat(F.lit("model-"), (k % 4).cast("string"))).alias("model"))
    return store.backfill_pending(rows, "model-2", F.ceil(F.length("text") / 4), 1 << 60)


@query()
def repeated_titles(spark, d):
    """Each part whose number is divisible by 50, as a new task against all open ones of its agent."""
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("agent"), F.when(F.col("p_size") % 3 == 0, "done").otherwise("pending").alias("status"), F.concat_ws(" ", "p_name", "p_type").alias("title"))
    return engine.repeated_titles(rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "agent", "title"), rows)
