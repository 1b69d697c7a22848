"""Bounded samples of labelled rows, on which classifiers are fitted."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def least_hashed(rows: DataFrame, by: str, most: int, id_col: str = "id") -> tuple[DataFrame, dict]:
    """Of each value of `by` up to `most` rows with the least hashes of their id, with `place` from 1; and the values' full counts.

    Rows are first thinned to the hashes below a bound that leaves a little more than `most` of each value, so what is
    sorted has a bound whatever the number of rows. Ids are distinct within a value; null values are left out.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(by).isNotNull()).groupBy(by).count().collect()}  # a row for each class
    if not counts:
        return rows.limit(0).withColumn("place", F.lit(1)), counts
    share = [(k, min(1.0, (most + 8 * math.sqrt(most) + 40) / n)) for k, n in counts.items()]
    bounds = rows.sparkSession.createDataFrame(share, f"_class {rows.schema[by].dataType.simpleString()}, _share double")
    hashed = F.shiftrightunsigned(F.xxhash64(id_col), 11) / float(1 << 53)
    near = rows.join(F.broadcast(bounds), F.col(by) == F.col("_class")).withColumn("_hash", hashed).where("_hash < _share").drop("_class", "_share")
    place = F.row_number().over(Window.partitionBy(by).orderBy("_hash", id_col))
    return near.withColumn("place", place).where(F.col("place") <= most).drop("_hash"), counts


def within_bytes(rows: DataFrame, by: str, most: int, size: str = "size") -> DataFrame:
    """Of each value of `by` the rows in order of `place` until their sizes sum up to `most`; the first one always. rows are a bounded sample."""
    total = F.sum(size).over(Window.partitionBy(by).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_total", total).where((F.col("_total") <= most) | (F.col("place") == 1)).drop("_total")


def sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text", max_bytes: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """Up to per_class labelled documents of each class (id, text, y) by hash order, where fold holds; and the classes' full counts.

    Rows without a label, or with one that is neither 0 nor 1, or whose document is missing, are left out. A document that is
    labelled more than once counts by its largest label. max_bytes bounds the sum of a class's texts: whole texts of any length
    are taken in hash order until it is reached, one at least.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(fold & F.col("id").isNotNull() & F.col("y").isin(0, 1))
    chosen, counts = least_hashed(marked.groupBy("id").agg(F.max("y").alias("y")), "y", per_class)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if max_bytes:
        chosen = stored(chosen, "chosen")
        sized = rows.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).join(F.broadcast(chosen), "id")
        chosen = within_bytes(sized.groupBy("id", "y", "place").agg(F.max("size").alias("size")), "y", max_bytes)
    return rows.join(F.broadcast(stored(chosen.select("id", "y"), "chosen")), "id"), counts  # at most per_class rows of each class
