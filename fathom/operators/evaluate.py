"""Judging retrieval and regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import scalars
from fathom.storage import BLOCK, in_blocks


def mcnemar(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Of (key, passed) frames: a missing current one has failed. One row: b, c, total, chi_squared, p_value, delta, degraded."""
    both = baseline.select("key", F.col("passed").alias("was")).join(current.select("key", F.col("passed").alias("now")), "key", "left").withColumn("now", F.coalesce("now", F.lit(False)))
    rows = both.agg(F.count_if(F.col("was") & ~F.col("now")).alias("b"), F.count_if(~F.col("was") & F.col("now")).alias("c"), F.count("*").alias("total"))
    n = F.col("b") + F.col("c")
    chi = F.when(n > 0, F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2)) / n).otherwise(0.0)
    rows = rows.withColumn("chi_squared", chi).withColumn("p_value", F.when(F.col("chi_squared") > 0, 1 - scalars.normal_cdf(F.sqrt("chi_squared"))).otherwise(1.0))
    rows = rows.withColumn("delta", (F.col("b") - F.col("c")) / F.col("total"))
    return rows.withColumn("degraded", (F.col("p_value") < 0.05) & (F.col("delta") > 0.01))


def reciprocal_rank(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """One row: mean reciprocal rank over expected (query_id, id), where results are (query_id, id, rank); beyond k counts 0."""
    hits = expected.join(results.where(F.col("rank") <= k), ["query_id", "id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return hits.agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def top1_concentration(results: DataFrame) -> DataFrame:
    """One row: answered queries, different first results, and the largest share of one of them."""
    first = results.where("rank = 1").groupBy("id").agg(F.count("*").alias("n"))
    return first.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("answered"), F.count("*").alias("distinct_top1"), F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"))


def nearest_per_query(queries: DataFrame, rows: DataFrame, similarity: Column, k: int, where: str = "query_id <> id", block: int = BLOCK) -> DataFrame:
    """(query_id, id, rank, similarity): a stated query set against all rows, in blocks; each task keeps k rows a query before the shuffle."""

    def search(asked: DataFrame) -> DataFrame:
        scored = rows.crossJoin(asked).where(where).select("query_id", "id", similarity.alias("similarity"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
        return scored.withColumn("rank", place).where(F.col("rank") <= k)

    return in_blocks(queries, search, block)


def known_items(rows: DataFrame, queries: DataFrame, label: str = "label") -> DataFrame:
    """(query_id, id): of each query (query_id, label) the least other id of its label. Each label's two least ids are kept, so no label is joined with itself."""
    least = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.min("id").alias("first"))
    second = rows.join(least, label).where("id <> first").groupBy(label).agg(F.min("id").alias("second"))
    both = least.join(second, label, "left")
    return queries.join(both, label).select("query_id", F.when(F.col("first") != F.col("query_id"), F.col("first")).otherwise(F.col("second")).alias("id")).where("id IS NOT NULL")
