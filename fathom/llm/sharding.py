"""Sharding by proportional stratified interleaving.

Within each source, rows are put in a seeded random order and ranked from 0. Row r of the n rows of a
source stands at (r + 1/2) / n; sorted by that, every stretch of the corpus has the sources in nearly the
corpus's proportions. Cutting the order into equal counts gives shards that match the mixture.

Places are counted without a window over a source: rows are range-partitioned and numbered within their
task, and only the tasks' counts are summed up, so a source that holds most rows is dealt out like the rest.

A null source is a source of its own. A null text has no bytes and a null checksum. Repeated rows are rows
like any other; ties are broken by id and then by checksum. Fewer rows than shards leave shards empty.
An empty table gives no rows. Columns other than those named are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SHARDS = 40
SEED = 17
#: What a row takes beside its text.
OVERHEAD = 16
_LOCAL = (1 << 33) - 1


def numbered(df: DataFrame, order: list[Column], tag: str, name: str) -> DataFrame:
    """df with its rows' numbers in the given order, from 0. df should be narrow: it is sorted and stored."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL))), tag)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("_part", first.alias("_first")), "_part").withColumn(name, F.col("_first") + F.col("_nth")).drop("_part", "_nth", "_first")


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot (place in the shard) of every row. Counts of shards differ by one at most."""
    data = F.col(text_col).cast("binary")
    key = F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary")), 1, 16)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (F.coalesce(F.octet_length(data), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), key.alias("key"))
    ties = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    placed = numbered(rows, [F.col("source"), F.col("key"), *ties], "by-source", "place")
    sources = placed.groupBy("source").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    ranked = placed.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("at", (F.col("place") - F.col("first") + 0.5) / F.col("n")).drop("s", "n", "first", "place")
    mixed = numbered(ranked, [F.col("at"), F.col("source"), *ties], "interleaved", "place")
    total = placed.count()
    if not total:
        return mixed.select("doc_id", "source", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    shard = F.expr(f"place * {shards} DIV {total}")  # exact while rows times shards are below 2 ** 63
    start = F.expr(f"(shard * {total} + {shards - 1}) DIV {shards}")  # the first place whose shard it is
    return mixed.withColumn("shard", shard).withColumn("slot", F.col("place") - start).select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The rows of docs (unique ids), as one sorted Parquet folder per shard."""
    slots = placed.select(F.col("doc_id").alias(id_col), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows = docs.join(slots, id_col).repartition("_shard").sortWithinPartitions("_shard", "_slot")
    rows.write.partitionBy("_shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


OP3_SQL = f"""
WITH steps AS (SELECT list(c ORDER BY b) AS crc FROM (
  SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS c FROM (SELECT unnest(range(256))::BIGINT AS b))),
bytes AS (SELECT doc_id, text, source, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: (strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1)::BIGINT[] AS b FROM documents),
rows_ AS (
  SELECT doc_id, source, coalesce(octet_length(encode(text)), 0) + {OVERHEAD} AS size,
    xor(list_reduce(b, lambda c, x: xor(c // 256, crc[xor(c % 256, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32, substr(md5('{SEED}-' || doc_id), 1, 16) AS key
  FROM bytes, steps),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key, doc_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS frac FROM rows_),
placed AS (SELECT *, row_number() OVER (ORDER BY frac, source, doc_id) - 1 AS place, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, place * {SHARDS} // total AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard::INT AS shard, (place - (shard * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, source FROM cut
"""
