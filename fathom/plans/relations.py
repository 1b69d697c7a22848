"""Joins, graphs, set operations, windows and changes of the store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.operators import analytics, evaluate, graph, scan, store
from fathom.operators import tasks as task_ops
from fathom.storage import stored

from .base import query, table
from .views import AS_OF_S, EVENTS, MEMORY, TASKS, events, memory, tasks

_SYMBOLS = "symbols AS (SELECT p_partkey AS id, p_brand || '.' || replace(p_name, ' ', '_') || '_' || (p_partkey // 2) AS symbol FROM part), wanted AS (SELECT p_partkey AS src, CASE WHEN p_partkey % 3 = 0 THEN p_brand || '.' || replace(p_name, ' ', '_') || '_' || (p_partkey // 2) WHEN p_partkey % 3 = 1 THEN replace(p_name, ' ', '_') || '_' || (p_partkey // 2) ELSE 'x.none' END AS name FROM part), exact AS (SELECT symbol, min(id) AS exact FROM symbols GROUP BY 1), tails AS (SELECT split_part(symbol, '.', -1) AS tail, count(*) AS n, min(id) AS by_tail FROM symbols GROUP BY 1), edges AS (SELECT src, name, coalesce(exact, CASE WHEN n = 1 THEN by_tail END) AS dst, coalesce(n, 0) AS n FROM wanted LEFT JOIN exact ON symbol = name LEFT JOIN tails ON tail = split_part(name, '.', -1))"


def _symbols(spark, d):
    p = table(spark, d, "part")
    tail = F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), F.floor(F.col("p_partkey") / 2).cast("string"))
    symbol = F.concat_ws(".", "p_brand", tail)
    name = F.when(F.col("p_partkey") % 3 == 0, symbol).when(F.col("p_partkey") % 3 == 1, tail).otherwise("x.none")
    return p.select(F.col("p_partkey").alias("id"), symbol.alias("symbol")), p.select(F.col("p_partkey").alias("src"), name.alias("name"))


@query(f"WITH {_SYMBOLS} SELECT src, name, dst, CASE WHEN dst = src THEN 'self' WHEN dst IS NOT NULL THEN 'edge' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS state FROM edges")
def dependency_edges(spark, d):
    return graph.resolved_edges(*_symbols(spark, d))


@query("WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey), i AS (SELECT dst AS id, list_sort(list(src))[1:10] AS dependents FROM e GROUP BY 1), o AS (SELECT src AS id, list_sort(list(dst))[1:10] AS dependencies FROM e GROUP BY 1) SELECT id, array_to_string(dependents, ',') AS dependents, array_to_string(dependencies, ',') AS dependencies FROM (SELECT id, coalesce(dependents, []) AS dependents, coalesce(dependencies, []) AS dependencies FROM i FULL JOIN o USING (id))")
def graph_neighbours(spark, d):
    e = table(spark, d, "lineitem").where("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return graph.neighbours(e, 10, 10).select("id", F.array_join("dependents", ",").alias("dependents"), F.array_join("dependencies", ",").alias("dependencies"))


@query("WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey), i AS (SELECT dst AS id, list_sort(list(src))[1:50] AS dependents FROM e GROUP BY 1), o AS (SELECT src AS id, list_sort(list(dst)) AS dependencies FROM e GROUP BY 1) SELECT id, array_to_string(coalesce(dependents, []), ',') AS dependents, array_to_string(coalesce(dependencies, []), ',') AS dependencies FROM i FULL JOIN o USING (id)")
def graph_neighbours_whole(spark, d):
    e = table(spark, d, "lineitem").where("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return graph.neighbours(e).select("id", F.array_join("dependents", ",").alias("dependents"), F.array_join("dependencies", ",").alias("dependencies"))


def _supply(spark, d):
    """Nodes and edges of parts and their suppliers."""
    keys = stored(table(spark, d, "lineitem").select("l_partkey", "l_suppkey").where("l_partkey IS NOT NULL AND l_suppkey IS NOT NULL").distinct(), "pairs")
    pairs = keys.select("l_partkey", F.concat(F.lit("p"), "l_partkey").alias("p"), F.concat(F.lit("s"), "l_suppkey").alias("s"))
    nodes = pairs.select(F.col("p").alias("id")).union(pairs.select("s"))
    return nodes, pairs.select(F.col("p").alias("src"), F.col("s").alias("dst")).union(pairs.where("l_partkey % 3 = 0").select("s", "p"))


@query()
def pagerank(spark, d):
    return graph.pagerank(*_supply(spark, d)).select("id", F.round("rank", 6).alias("rank"))


@query("WITH RECURSIVE pairs AS (SELECT DISTINCT l_partkey AS k, 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL), e AS (SELECT DISTINCT src, dst FROM (SELECT p AS src, s AS dst FROM pairs UNION SELECT s, p FROM pairs WHERE k % 3 = 0)), d AS (SELECT src, count(*) AS degree FROM e GROUP BY 1), nodes AS (SELECT id, degree IS NULL AS dangling FROM (SELECT p AS id FROM pairs UNION SELECT s FROM pairs) LEFT JOIN d ON src = id), total AS (SELECT count(*) AS n FROM nodes), r(i, id, rank) AS (SELECT 0, id, 1.0::DOUBLE / n FROM nodes, total UNION ALL SELECT any_value(o.i) + 1, o.id, 0.85::DOUBLE * (coalesce(sum(g.rank / d.degree), 0) + any_value(l.lost) / any_value(n)) + 0.15::DOUBLE / any_value(n) FROM r o LEFT JOIN e ON e.dst = o.id LEFT JOIN r g ON g.id = e.src LEFT JOIN d ON d.src = e.src, total, (SELECT coalesce(sum(rank), 0) AS lost FROM r JOIN nodes USING (id) WHERE dangling) l WHERE o.i < 12 GROUP BY o.id) SELECT id, round(rank, 8) AS rank FROM r WHERE i = 12")
def pagerank_rounds(spark, d):
    return graph.pagerank(*_supply(spark, d), rounds=12, tolerance=0).select("id", F.round("rank", 8).alias("rank"))


@query(f"WITH RECURSIVE {TASKS}, t(id, root, depth) AS (SELECT id, id, 0 FROM tasks WHERE parent IS NULL UNION ALL SELECT c.id, t.root, t.depth + 1 FROM tasks c JOIN t ON c.parent = t.id) SELECT id, root, depth FROM t")
def task_tree(spark, d):
    return task_ops.tree(tasks(spark, d)).select("id", "root", "depth")


@query(f"WITH {TASKS}, r AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'done' ELSE status END AS status, assigned_to, sprint FROM tasks WHERE id % 7 <> 0 UNION ALL SELECT id + 90000000, status, assigned_to, sprint FROM tasks WHERE id % 50 = 0), pairs AS (SELECT coalesce(l.id, r.id) AS id, l.id AS a, r.id AS b, [l.status, l.assigned_to, l.sprint] AS x, [r.status, r.assigned_to, r.sprint] AS y FROM tasks l FULL JOIN r ON l.id = r.id) SELECT id, 'missing' AS kind, '' AS field, '' AS \"left\", '' AS \"right\" FROM pairs WHERE b IS NULL UNION ALL SELECT id, 'extra', '', '', '' FROM pairs WHERE a IS NULL UNION ALL SELECT id, 'differs', (['status', 'assigned_to', 'sprint'])[i], coalesce(x[i], ''), coalesce(y[i], '') FROM pairs, (SELECT unnest([1, 2, 3]) AS i) WHERE a IS NOT NULL AND b IS NOT NULL AND coalesce(x[i], '') <> coalesce(y[i], '')")
def reconcile(spark, d):
    left = tasks(spark, d).select("id", "status", "assigned_to", "sprint")
    right = left.where("id % 7 <> 0").withColumn("status", F.when(F.col("id") % 10 == 0, "done").otherwise(F.col("status"))).unionByName(left.where("id % 50 = 0").withColumn("id", F.col("id") + 90_000_000))
    return task_ops.reconciled(left, right, ["status", "assigned_to", "sprint"])


@query(f"WITH {TASKS}, gone AS (SELECT id FROM tasks WHERE status = 'done' AND created_s < {AS_OF_S} - 86400 * 9000), d AS (SELECT t.id, u.pos, t.dependencies[u.pos] AS dep FROM tasks t, (SELECT unnest([1, 2, 3]) AS pos) u WHERE u.pos <= len(t.dependencies)), k AS (SELECT id, string_agg(CAST(dep AS VARCHAR), ',' ORDER BY pos) AS dependencies FROM d WHERE dep NOT IN (SELECT id FROM gone) GROUP BY id) SELECT t.id, coalesce(k.dependencies, '') AS dependencies FROM tasks t LEFT JOIN k USING (id) WHERE t.id NOT IN (SELECT id FROM gone)")
def archive(spark, d):
    kept, _ = task_ops.archived(tasks(spark, d), AS_OF_S, 9000)
    return kept.select("id", F.array_join("dependencies", ",").alias("dependencies"))


@query(f"WITH {TASKS}, c AS (SELECT id + 5 AS id, 'changed' AS status FROM tasks WHERE id % 1000 = 0) SELECT id, status FROM tasks WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT id, status FROM c")
def upsert(spark, d):
    t = tasks(spark, d).select("id", "status")
    return task_ops.upserted(t, t.where("id % 1000 = 0").select((F.col("id") + 5).alias("id"), F.lit("changed").alias("status")))


@query("SELECT l.l_orderkey AS id FROM (SELECT DISTINCT l_orderkey FROM lineitem) l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')")
def prune_missing(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct().join(done, "id", "left_anti")


@query(f"WITH {EVENTS} SELECT agent_id, array_to_string(list_sort(list_filter(['click', 'signup', 'view'], lambda t: NOT list_contains(used, t))), ',') AS unused, array_to_string(list_sort(list_filter(used, lambda t: NOT list_contains(['click', 'signup', 'view'], t))), ',') AS undeclared FROM (SELECT agent_id, list(DISTINCT event_type) AS used FROM log GROUP BY 1)")
def declared_vs_used(spark, d):
    declared = F.array(F.lit("click"), F.lit("signup"), F.lit("view"))
    used = events(spark, d).groupBy("agent_id").agg(F.collect_set("event_type").alias("used"))
    return used.select("agent_id", F.array_join(F.array_sort(F.array_except(declared, "used")), ",").alias("unused"), F.array_join(F.array_sort(F.array_except("used", declared)), ",").alias("undeclared"))


@query("WITH r AS (SELECT DISTINCT p_brand AS dep, '^' || (p_size % 4) || '.' || (p_size % 3) || '.0' AS spec, p_size % 4 AS ma, p_size % 3 AS mi FROM part), v AS (SELECT *, ma * 1000000 + mi * 1000 AS lo, CASE WHEN ma > 0 THEN (ma + 1) * 1000000 WHEN mi > 0 THEN (mi + 1) * 1000 ELSE 1 END AS hi FROM r) SELECT a.dep, a.spec AS a, b.spec AS b FROM v a JOIN v b ON a.dep = b.dep AND a.spec < b.spec AND NOT (a.lo < b.hi AND b.lo < a.hi)")
def version_conflicts(spark, d):
    p = table(spark, d, "part")
    spec = F.concat(F.lit("^"), (F.col("p_size") % 4).cast("string"), F.lit("."), (F.col("p_size") % 3).cast("string"), F.lit(".0"))
    return graph.conflicts(p.select(F.col("p_brand").alias("dep"), spec.alias("spec")))


@query("WITH t AS (SELECT quality = 1 AS was, toxic = 0 AS now FROM labels), n AS (SELECT count(*) FILTER (WHERE was AND NOT now) AS b, count(*) FILTER (WHERE NOT was AND now) AS c, count(*) AS total FROM t), x AS (SELECT *, CASE WHEN b + c > 0 THEN power(abs(b - c) - 1, 2) / (b + c) ELSE 0.0 END AS chi FROM n), z AS (SELECT *, 1 / (1 + 0.3275911 * sqrt(chi) / sqrt(2.0)) AS t FROM x), p AS (SELECT *, CASE WHEN chi > 0 THEN t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-chi / 2) / 2 ELSE 1.0 END AS p FROM z) SELECT b, c, total, round(CAST(chi AS DOUBLE), 6) AS chi_squared, round(CAST(p AS DOUBLE), 6) AS p_value, round((b - c) / CAST(total AS DOUBLE), 6) AS delta, p < 0.05 AND (b - c) / CAST(total AS DOUBLE) > 0.01 AS degraded FROM p")
def mcnemar(spark, d):
    rows = table(spark, d, "labels")
    out = evaluate.mcnemar(rows.select(F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("passed")), rows.select(F.col("doc_id").alias("key"), (F.col("toxic") == 0).alias("passed")))
    return out.withColumns({c: F.round(c, 6) for c in ("chi_squared", "p_value", "delta")})


@query(f"WITH {MEMORY} SELECT id, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'identical' WHEN id % 3 = 0 THEN 'conflict' WHEN EXISTS (SELECT 1 FROM memory t WHERE t.id % 3 = 0 AND t.id % 2 = 0 AND t.text = m.text) THEN 'content_duplicate' ELSE 'insert' END AS action FROM memory m")
def migration_plan(spark, d):
    m = memory(spark, d).select("id", "text")
    target = m.where("id % 3 = 0").withColumn("text", F.when(F.col("id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!changed"))))
    return store.migration_plan(m, target, "id", ["text"])


@query(f"WITH {MEMORY} SELECT id, source, text FROM memory WHERE id % 2 = 0 UNION ALL SELECT id, source, text FROM memory WHERE id % 2 = 1 AND id % 5 = 0")
def import_merge(spark, d):
    m = memory(spark, d).select("id", "source", "text")
    return store.merged(m.where("id % 2 = 0"), m.where("id % 5 = 0").withColumn("unknown", F.lit(1)), "id")


@query(f"WITH {MEMORY} SELECT id, CASE WHEN id % 10 = 3 AND invalid_s IS NULL THEN {AS_OF_S} ELSE invalid_s END AS invalid_s FROM memory")
def bitemporal(spark, d):
    m = memory(spark, d)
    return store.invalidated(m, m.where("id % 10 = 3").select("id"), AS_OF_S).select("id", F.col("invalid_s").cast("long").alias("invalid_s"))


@query(f"WITH {MEMORY}, {EVENTS}, c AS (SELECT k AS id, task_id, min(at_s) AS at_s FROM log GROUP BY 1, 2), t AS (SELECT id, count(*) AS n, min(at_s) AS f, max(at_s) AS l FROM c GROUP BY 1) SELECT m.id, coalesce(n, 0) AS new_citations, f AS first_cited_s, l AS last_cited_s, CAST(applied_count + coalesce(n, 0) AS INTEGER) AS applied_count FROM memory m LEFT JOIN t USING (id)")
def citations(spark, d):
    return store.cited(memory(spark, d), events(spark, d).select(F.col("k").cast("long").alias("id"), "task_id", "at_s")).select("id", "new_citations", "first_cited_s", "last_cited_s", "applied_count")


@query("SELECT conv_id, turn, spent FROM (SELECT conv_id, turn, sum(CAST(ceil(length(text) / 4) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn DESC)::BIGINT AS spent FROM conversations) WHERE spent <= 400")
def token_prune(spark, d):
    cost = F.ceil(F.length("text") / 4).cast("long")
    return store.within_budget(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], cost, 400).select("conv_id", "turn", "spent")


@query(f"WITH {EVENTS} SELECT id, count(*) OVER (PARTITION BY agent_id ORDER BY at_s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) > 3 AS over FROM log")
def rate_limit(spark, d):
    return analytics.rate_limited(events(spark, d), "agent_id", "at_s", 3, 3600).select("id", "over")


@query(f"WITH {EVENTS}, s AS (SELECT id, event_type AS reason, at_s AS created_s, k % 2 = 0 AS verified, row_number() OVER (PARTITION BY event_type ORDER BY at_s DESC, id DESC) AS place FROM log), b AS (SELECT reason, arg_max(id, created_s * 1000000 + id) AS best FROM s WHERE verified GROUP BY 1) SELECT id, s.reason FROM s LEFT JOIN b ON s.reason = b.reason WHERE place > 3 AND created_s < {AS_OF_S} - 5 * 86400 AND id IS DISTINCT FROM best")
def snapshot_retention(spark, d):
    s = events(spark, d).select("id", F.col("event_type").alias("reason"), F.col("at_s").alias("created_s"), (F.col("k") % 2 == 0).alias("verified"))
    return analytics.snapshots_to_prune(s, AS_OF_S, days=5)


@query("SELECT p_partkey AS id, CASE WHEN p_name = 'x' THEN 0 WHEN contains(lower(p_name), 'an') THEN 1 WHEN contains(lower(p_brand), '1') THEN 2 ELSE 3 END AS tier FROM part ORDER BY tier, p_size DESC, p_partkey LIMIT 40")
def registry_search(spark, d):
    tier = F.when(F.col("p_name") == "x", 0).when(F.lower("p_name").contains("an"), 1).when(F.lower("p_brand").contains("1"), 2).otherwise(3)
    return table(spark, d, "part").withColumn("tier", tier).orderBy("tier", F.desc("p_size"), "p_partkey").limit(40).select(F.col("p_partkey").alias("id"), "tier")


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, d, "orders").select("o_custkey"))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT page_id, max_by(r.kind, r.specificity * 100 + r.prio) AS kind FROM pages p JOIN (VALUES ('^https?://blog\\.', 'blog', 2, 1), ('^https?://', 'web', 0, 1), ('/de/', 'german', 1, 5), ('[?&]page=', 'listing', 1, 9)) r(pattern, kind, specificity, prio) ON regexp_matches(p.url, r.pattern) GROUP BY page_id")
def pattern_routing(spark, d):
    rules = spark.createDataFrame([(r"^https?://blog\.", "blog", 2, 1), ("^https?://", "web", 0, 1), ("/de/", "german", 1, 5), ("[?&]page=", "listing", 1, 9)], "pattern string, kind string, specificity int, prio int")
    hits = scan.matches(table(spark, d, "pages").select("page_id", "url"), rules, "url")
    return hits.groupBy("page_id").agg(F.max_by("kind", F.struct("specificity", "prio")).alias("kind"))


@query(f"WITH {TASKS}, m AS (SELECT 'status' AS f, id FROM tasks) SELECT t.id, coalesce(l.status, t.status) AS status FROM tasks t LEFT JOIN (SELECT id, 'done' AS status FROM tasks WHERE id % 9 = 0 AND status IS DISTINCT FROM 'done') l USING (id)")
def update_from(spark, d):
    t = tasks(spark, d).select("id", "status")
    new = t.where("id % 9 = 0").select("id", F.lit("done").alias("new"))
    return t.join(new, "id", "left").select("id", F.when(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("status")), F.col("new")).otherwise(F.col("status")).alias("status"))


@query(f"WITH {MEMORY} SELECT id, t.tag FROM memory, (SELECT unnest(['de', 'fr']) AS tag) t WHERE list_contains(tags, t.tag)")
def tag_unnest(spark, d):
    return memory(spark, d).select("id", F.explode("tags").alias("tag")).where(F.col("tag").isin("de", "fr"))


@query(f"WITH {EVENTS} SELECT agent_id, id, CAST(row_number() OVER (PARTITION BY agent_id ORDER BY value DESC, id) AS INTEGER) AS place FROM log QUALIFY place <= 3")
def top_per_agent(spark, d):
    place = F.row_number().over(Window.partitionBy("agent_id").orderBy(F.desc("value"), "id"))
    return events(spark, d).withColumn("place", place).where("place <= 3").select("agent_id", "id", "place")
