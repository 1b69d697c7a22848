"""The store's tables as projections of the test tables, in Spark and, for the oracle, in SQL.

Timestamps are kept beside their epoch seconds (`..._s`), which is what queries return. AS_OF stands for now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

AS_OF_S = 1_706_745_600  # 2024-02-01 00:00 UTC
SOURCES = ["lesson-learned", "best-practice", "auto_learning", "web_search_result", "session-learning", "distilled", "rpetd_phase", "task_event", "agent"]
PRIORITIES = ["critical", "high", "medium", "low", "someday"]


def as_of() -> Column:
    return F.timestamp_seconds(F.lit(AS_OF_S))


def memory(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring("source", 4, 9).cast("int")
    created = F.lit(AS_OF_S) - F.col("doc_id") * 3600
    rows = table(spark, d, "documents").withColumn("n", n).withColumn("created_s", created)
    source = F.when(n % 10 < 9, F.element_at(F.array(*map(F.lit, SOURCES)), n % 10 + 1))
    tags = F.array_compact(F.array(F.col("source"), F.when(n % 3 == 0, "pg"), F.when(F.col("doc_id") % 2 == 0, " Py "), F.when(F.col("doc_id") % 5 == 0, "misc"), F.col("lang")))
    return rows.select(
        F.col("doc_id").alias("id"), "text", source.alias("source"), F.when(F.col("doc_id") % 11 == 0, "__test__").when(F.col("doc_id") % 13 != 0, F.col("lang")).alias("project_id"),
        (F.col("n_chars") % 12).cast("int").alias("applied_count"), tags.alias("tags"), "created_s", F.timestamp_seconds("created_s").alias("created_at"),
        F.when(F.col("doc_id") % 17 == 0, F.col("created_s") + 60).alias("invalid_s"), F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("model-"), (F.col("doc_id") % 4).cast("string"))).alias("embedding_model"),
        F.concat(F.lit("agent"), (F.col("doc_id") % 9).cast("string")).alias("agent_id"),
    )


MEMORY = f"""memory AS (SELECT doc_id AS id, text, CASE WHEN n % 10 < 9 THEN (['{"','".join(SOURCES)}'])[n % 10 + 1] END AS source,
  CASE WHEN doc_id % 11 = 0 THEN '__test__' WHEN doc_id % 13 <> 0 THEN lang END AS project_id, CAST(n_chars % 12 AS INTEGER) AS applied_count,
  list_filter([src, CASE WHEN n % 3 = 0 THEN 'pg' END, CASE WHEN doc_id % 2 = 0 THEN ' Py ' END, CASE WHEN doc_id % 5 = 0 THEN 'misc' END, lang], lambda t: t IS NOT NULL) AS tags,
  {AS_OF_S} - doc_id * 3600 AS created_s, CASE WHEN doc_id % 17 = 0 THEN {AS_OF_S} - doc_id * 3600 + 60 END AS invalid_s,
  CASE WHEN doc_id % 4 > 0 THEN 'model-' || (doc_id % 4) END AS embedding_model, 'agent' || (doc_id % 9) AS agent_id
  FROM (SELECT *, source AS src, CAST(substr(source, 4) AS INTEGER) AS n FROM documents))"""


def tasks(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "done").otherwise(F.element_at(F.array(F.lit("in_progress"), F.lit("failed"), F.lit("validation")), (k % 3 + 1).cast("int")))
    return table(spark, d, "orders").select(
        k.alias("id"), status.alias("status"), F.element_at(F.array(*map(F.lit, PRIORITIES)), p).alias("priority"), (6 - p).alias("importance"), (k % 5 + 1).cast("int").alias("urgency"),
        F.concat(F.lit("agent"), (c % 20).cast("string")).alias("assigned_to"), F.when(k % 3 == 0, F.array(F.floor(k / 2), F.floor(k / 3), k + 10_000_000)).otherwise(F.array().cast("array<bigint>")).alias("dependencies"),
        F.element_at(F.array(F.lit("task"), F.lit("bug"), F.lit("epic")), (k % 3 + 1).cast("int")).alias("type"), F.when(k % 6 > 0, F.concat(F.lit("S"), (k % 6).cast("string"))).alias("sprint"),
        F.when(k % 4 > 0, F.concat(F.lit("P"), (k % 4).cast("string"))).alias("project_id"), (k % 4 == 0).alias("rpetd_complete"), F.when(k >= 10, F.floor(k / 10)).alias("parent"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created_s"), F.when(k % 2 == 0, F.lit(AS_OF_S) + (k % 9 - 2) * 86400 + 3600).alias("due_s"), F.col("o_totalprice").alias("price"),
    )


TASKS = f"""tasks AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'done' ELSE (['in_progress','failed','validation'])[o_orderkey % 3 + 1] END AS status,
  (['{"','".join(PRIORITIES)}'])[p] AS priority, 6 - p AS importance, CAST(o_orderkey % 5 + 1 AS INTEGER) AS urgency, 'agent' || (o_custkey % 20) AS assigned_to,
  CASE WHEN o_orderkey % 3 = 0 THEN [o_orderkey // 2, o_orderkey // 3, o_orderkey + 10000000] ELSE [] END AS dependencies, (['task','bug','epic'])[o_orderkey % 3 + 1] AS type,
  CASE WHEN o_orderkey % 6 > 0 THEN 'S' || (o_orderkey % 6) END AS sprint, CASE WHEN o_orderkey % 4 > 0 THEN 'P' || (o_orderkey % 4) END AS project_id, o_orderkey % 4 = 0 AS rpetd_complete,
  CASE WHEN o_orderkey >= 10 THEN o_orderkey // 10 END AS parent, CAST(epoch(o_orderdate) AS BIGINT) AS created_s, CASE WHEN o_orderkey % 2 = 0 THEN {AS_OF_S} + (o_orderkey % 9 - 2) * 86400 + 3600 END AS due_s, o_totalprice AS price
  FROM (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p FROM orders))"""


def events(spark: SparkSession, d: str) -> DataFrame:
    """The log: agent, outcome, gate, times; also serves as audit trail, findings and messages."""
    e = table(spark, d, "events")
    outcome = F.when(F.col("event_type").isin("purchase", "signup"), "pass").when(F.col("event_type") == "error", "fail").otherwise("partial")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("agent"), F.col("user_id").cast("string")).alias("agent_id"), "event_type", outcome.alias("outcome"), "value", k.alias("k"), "props",
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at_s"), (F.col("user_id") % 40).alias("task_id"), F.when(outcome == "fail", F.element_at(F.array(F.lit("BRANCH_EVIDENCE"), F.lit("TEST_EVIDENCE"), F.lit("PR_URL"), F.lit("LEARNING_BLOCK")), k % 4 + 1)).alias("gate_failed"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high"), F.lit("critical")), k % 4 + 1).alias("severity"), F.element_at(F.array(F.lit("open"), F.lit("ticketed"), F.lit("closed")), k % 3 + 1).alias("status"),
        F.when(k % 5 > 0, F.concat(F.lit("agent"), (F.col("event_id") % 7).cast("string"))).alias("recipient"),
    )


EVENTS = """log AS (SELECT event_id AS id, 'agent' || user_id AS agent_id, event_type, CASE WHEN event_type IN ('purchase', 'signup') THEN 'pass' WHEN event_type = 'error' THEN 'fail' ELSE 'partial' END AS outcome, value, k, props,
  CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS at_s, user_id % 40 AS task_id, CASE WHEN event_type = 'error' THEN (['BRANCH_EVIDENCE','TEST_EVIDENCE','PR_URL','LEARNING_BLOCK'])[k % 4 + 1] END AS gate_failed,
  (['low','medium','high','critical'])[k % 4 + 1] AS severity, (['open','ticketed','closed'])[k % 3 + 1] AS status, CASE WHEN k % 5 > 0 THEN 'agent' || (event_id % 7) END AS recipient
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
