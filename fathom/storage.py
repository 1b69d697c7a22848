"""Where intermediate results go: the folder that driver and executors share."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A set of 64-bit ids is broadcast up to this many (16 MB); beyond it the join is shuffled.
BROADCAST_IDS = 2_000_000
#: A key that more rows than this have is hot: its rows are joined by a broadcast of the keys that are.
HOT = 100_000
#: So many queries of a stated set are broadcast at a time.
BLOCK = 10_000

def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder in the warehouse, which is shared too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_fathom"
    return re.sub("^file:/+", "file:///", root)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """df written to the shared folder and read from there: its lineage is cut, and a lost executor costs nothing. codec: Parquet's, if not the session's."""
    path = new_path(df.sparkSession, tag)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, tag: str, key: str) -> DataFrame:
    """As stored(), but dealt to spark.sql.shuffle.partitions buckets by a key: what is joined or grouped by it later is not shuffled again. forget() deletes it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    name, n = f"fathom_{path.rsplit('-', 1)[1]}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def forget(df: DataFrame) -> None:
    """Deletes what stored() wrote for df. For rounds of a loop whose successor is written: nothing reads them any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """df (stored, narrow) with a broadcast hint if it has at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def looked_up(left: DataFrame, right: DataFrame, on: list[str], times: str) -> DataFrame:
    """left with the columns of right (stored, unique in `on`; `times`: how many rows of left have the key), or nulls.

    Hot keys are few, as each has more than HOT rows: they are broadcast, so that no task gets all rows of one.
    """
    hot = right.where(F.col(times) > HOT).drop(times)
    if not hot.limit(1).count():
        return left.join(right.drop(times), on, "left")
    spread = left.join(small(hot.withColumn("_hot", F.lit(True))), on, "left")
    rest = left.join(small(hot.select(*on)), on, "left_anti").join(right.where(F.col(times) <= HOT).drop(times), on, "left")
    return spread.where("_hot").drop("_hot").unionByName(rest)


def in_blocks(queries: DataFrame, work: Callable[[DataFrame], DataFrame], most: int = BLOCK) -> DataFrame:
    """work(block) of a stated query set (query_id distinct, ...), together: each block is broadcast and has `most` queries or a few more.

    Beyond one block results are stored block by block, so nothing that is broadcast grows with the table.
    """
    queries = stored(queries, "queries")
    n = queries.count()
    if n <= most:
        return work(F.broadcast(queries))
    blocks = math.ceil(n / most)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [stored(work(F.broadcast(queries.where(block == b))), "block") for b in range(blocks)])
