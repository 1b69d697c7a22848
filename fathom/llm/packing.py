"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces of power-of-two lengths, the longest first: as many of max_len as
fit, then the binary digits of the rest. Pieces of one length form a bucket, and each is a sequence by
itself: no sequence crosses documents and none is padded.

Null and empty texts have the end id alone: one piece of length 1. Repeated rows and equal ids give
pieces of their own. An empty table gives no piece. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import chunks, stored, table

BROADCAST_BUCKETS = 200_000


def binary_lengths(n: int, max_len: int) -> list[int]:
    """n as pieces of max_len, and then the powers of two in the rest, falling."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = 4096, path: str | None = None, end_id: int = tokens.END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian uint32), and its place in its task's bucket (part, nth)."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    path = path or tokens.vocabulary()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def cut(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for rows in batches:
            for some, texts in chunks(rows, "text"):
                ids, n = tokens.encode(texts, path, end_id)
                data, at = ids.astype("<u4").tobytes(), 0
                which, start, length, nth, blob = [], [], [], [], []
                for i, size in enumerate(n.tolist()):
                    done = 0
                    for k in binary_lengths(size, max_len):
                        which.append(i), start.append(done), length.append(k), nth.append(seen.get(k, 0))
                        blob.append(data[4 * (at + done) : 4 * (at + done + k)])
                        seen[k] = seen.get(k, 0) + 1
                        done += k
                    at += size
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").take(pa.array(which, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(np.take(n, which), pa.int64()), pa.array(blob, pa.binary()), pa.array([part] * len(which), pa.int32()), pa.array(nth, pa.int64())],
                    names=["doc_id", "start", "length", "doc_tokens", "ids", "part", "nth"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(cut, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, part int, nth long")


def sequences(cut: DataFrame) -> DataFrame:
    """The pieces with sequence_id, which is gapless from 0 and ascends bucket by bucket, the longest first; offset is 0."""
    cut = stored(cut, "pieces")
    sizes = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bucket = sizes.groupBy("length").agg(F.sum("n").alias("total"))
    base = bucket.select("length", F.coalesce(F.sum("total").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    first = stored(sizes.select("length", "part", before.alias("before")).join(base, "length").select("length", "part", (F.col("before") + F.col("base")).alias("first")), "buckets")
    small = first.count() <= BROADCAST_BUCKETS
    out = cut.join(F.broadcast(first) if small else first, ["length", "part"])
    return out.withColumn("sequence_id", F.col("first") + F.col("nth")).withColumn("offset", F.lit(0).cast("long")).drop("first", "nth", "part")


def op9_packing(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    cut = pieces(table(spark, sf_dir, "documents") if docs is None else docs)
    return sequences(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
