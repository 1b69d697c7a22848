"""Embedding what is missing: content-addressed vectors, and a job in batches that can be stopped and resumed.

Vectors are stored by the digest of their text and the name of the model, so a text is embedded once however many rows have it, and
in later runs not at all. The job fixes its batches when it first runs, by running sums of rows and tokens; waves of batches are then
worked off in order, each written under its own name, so that a wave which is done is never done again and one that broke off is written anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text

from .running import batches

DIMENSIONS = 64
#: (text digest, text) frames to (digest, vector) frames.
Embed = Callable[[DataFrame], DataFrame]


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def hashed_vectors(texts: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(digest, vector) of (digest, text) without any model: each word adds 1 or -1 to a place that its hash names; vectors have length 1, of texts without words 0."""
    words = texts.select("digest", F.transform(text.tokens(F.coalesce("text", F.lit(""))), lambda t: F.xxhash64(t)).alias("words"))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("words")
            h = lists.flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            at = row * dimensions + (h % np.uint64(dimensions)).astype(np.int64)
            out = np.bincount(at, np.where(h >> np.uint64(63), -1.0, 1.0), len(lists) * dimensions).reshape(-1, dimensions)
            length = np.linalg.norm(out, axis=1, keepdims=True)
            out = (out / np.where(length > 0, length, 1)).astype(np.float32)
            ends = pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dimensions)
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=["digest", "vector"])

    return words.mapInArrow(embed, "digest string, vector array<float>")


def with_vectors(rows: DataFrame, store: str, embed: Embed = hashed_vectors, model: str = "hashed-64", text_col: str = "text") -> tuple[DataFrame, dict[str, int]]:
    """rows with `vector`, and how many texts there were, how many different ones, how many of those the store had, and how many were embedded.

    store: a folder of (digest, vector) by model, to which new vectors are added. A null text counts as an empty one.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_text", F.coalesce(text_col, F.lit(""))).withColumn("_digest", F.sha2(F.col("_text").cast("binary"), 256))
    different = keyed.groupBy(F.col("_digest").alias("digest")).agg(F.first("_text").alias("text"))  # each task keeps one of a text before the shuffle
    path = f"{store}/model={model}"
    schema = "digest string, vector array<float>"
    had = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    known = had.count()
    missing = different.join(had.select("digest"), "digest", "left_anti")
    embed(missing).write.mode("append").parquet(path)
    now = spark.read.schema(schema).parquet(path)
    new = now.count() - known
    texts, kinds = keyed.agg(F.count("*"), F.count_distinct("_digest")).first()
    out = keyed.join(now.withColumnRenamed("digest", "_digest"), "_digest").drop("_digest", "_text")
    return out, {"texts": texts, "different": kinds, "from_store": kinds - new, "embedded": new}


def _done(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """Folders of finished waves, and the first and last wave of each. One that broke off has no mark and doesn't count, whatever files it has."""
    if not exists(spark, f"{path}/out"):
        return {}
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/out")
    names = [f.getPath().getName() for f in where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(where)]
    ends = {n: n.removeprefix("wave=").split("-") for n in names if n.startswith("wave=")}
    return {f"{path}/out/{n}": (int(e[0]), int(e[-1])) for n, e in ends.items() if exists(spark, f"{path}/out/{n}/_SUCCESS")}


def run(pending: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, budget: int | None, most_rows: int = 100, most_tokens: int = 50_000, wave: int = 64, together: int = 1) -> dict:
    """Works off pending rows (id, tokens, ...) in the order of ids; returns what this run did: status ('done' or 'stopped'), waves, tokens, and the tokens that are left.

    path: the job's own folder. The first run stores the plan there, later ones go on with it whatever `pending` is then. work gets the rows of a wave, or of
    `together` waves that follow each other, with their batch: these are one job, and done anew if it breaks off. A run ends before the wave that would go
    beyond its budget. Results are read by `results`. A job must not be run twice at once.
    """
    if not budget or budget <= 0:
        raise ValueError("a backfill needs a budget of tokens")
    spark = pending.sparkSession
    plan = f"{path}/plan"
    if not exists(spark, f"{plan}/_SUCCESS"):
        cut = batches(pending, most_rows, most_tokens)
        cut.repartitionByRange("batch").sortWithinPartitions("batch", "id").write.mode("overwrite").parquet(plan)
    rows = spark.read.parquet(plan)
    waves = rows.groupBy(F.expr(f"batch DIV {wave}").alias("wave")).agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens")).orderBy("wave")
    done = {w for first, last in _done(spark, path).values() for w in range(first, last + 1)}
    did, spent, left = 0, 0, 0
    group: list[int] = []

    def finish() -> None:
        if group:
            first, last = group[0], group[-1]
            name = f"{first}" if first == last else f"{first}-{last}"
            work(rows.where(F.col("batch").between(first * wave, last * wave + wave - 1))).write.mode("overwrite").parquet(f"{path}/out/wave={name}")
            group.clear()

    for w in waves.toLocalIterator():
        if w.wave in done:
            continue
        if left or spent + w.tokens > budget:
            left += w.tokens
            continue
        if group and (len(group) == together or w.wave != group[-1] + 1):
            finish()
        group.append(w.wave)
        did, spent = did + 1, spent + w.tokens
    finish()
    return {"status": "stopped" if left else "done", "waves": did, "tokens": spent, "left": left}


def results(spark: SparkSession, path: str) -> DataFrame:
    """What all runs of a job have made so far."""
    return spark.read.parquet(*sorted(_done(spark, path)))
