"""What an agent is given when it starts: memories near its role, its board, its last activity and the latest security findings, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors

MEMORIES, NOTES, ALERTS, WINDOW_S = 5, 5, 3, 86_400


def board(agents: DataFrame, notes: DataFrame, most: int = NOTES) -> DataFrame:
    """(agent_id, place, id) of the newest notes (id, recipient, at_s) that are to the agent or to all. Those to all are cut to the newest first, so no agent meets all notes."""
    newest = Window.partitionBy("recipient").orderBy(F.desc("at_s"), F.desc("id"))
    own = notes.where("recipient IS NOT NULL").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= most).select(F.col("recipient").alias("agent_id"), "id", "at_s")
    to_all = notes.where("recipient IS NULL").orderBy(F.desc("at_s"), F.desc("id")).limit(most).select("id", "at_s")
    rows = own.join(agents.select("agent_id"), "agent_id", "left_semi").unionByName(agents.select("agent_id").crossJoin(F.broadcast(to_all)))  # `most` rows
    place = F.row_number().over(Window.partitionBy("agent_id").orderBy(F.desc("at_s"), F.desc("id")))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("agent_id", "place", "id")


def bundle(agents: DataFrame, memory: DataFrame, log: DataFrame, role: str = "role") -> DataFrame:
    """(agent_id, section, place, id) of agents (agent_id distinct, role: a vector or null), memory (id, embedding), log (id, agent_id, recipient, severity, at_s).

    Sections: memory (the nearest rows; none without a role), blackboard, recent_activity (the agent's last event), security (critical findings of
    the day before the log's end, the same for all). A section that has nothing has no rows, and takes nothing away from the others.
    """
    numbered = agents.select("agent_id", F.xxhash64("agent_id").alias("query_id"), F.col(role).alias("q"))
    near = vectors.search(vectors.built(memory), numbered, MEMORIES).join(numbered.select("agent_id", "query_id"), "query_id")
    last = log.join(agents.select("agent_id"), "agent_id", "left_semi").groupBy("agent_id").agg(F.max(F.struct("at_s", "id")).alias("last"))
    end = log.agg(F.max("at_s").alias("end"))
    alerts = log.where("severity = 'critical'").crossJoin(F.broadcast(end)).where(F.col("at_s") >= F.col("end") - WINDOW_S).orderBy(F.desc("at_s"), F.desc("id")).limit(ALERTS)  # end is one row
    alerts = alerts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("at_s"), F.desc("id")))).select("place", "id")
    sections = {
        "memory": near.select("agent_id", F.col("rank").alias("place"), "id"),
        "blackboard": board(agents, log.select("id", "recipient", "at_s")),
        "recent_activity": last.select("agent_id", F.lit(1).alias("place"), F.col("last.id").alias("id")),
        "security": agents.select("agent_id").crossJoin(F.broadcast(alerts)),  # ALERTS rows
    }
    out = None
    for name, rows in sections.items():
        rows = rows.select("agent_id", F.lit(name).alias("section"), F.col("place").cast("int").alias("place"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out
