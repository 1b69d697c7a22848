"""Token files: ids ranked by frequency, in a byte-aligned variable-length code with its control bytes apart.

Ids are replaced by their rank in the corpus (the commonest is 0), so that common ids take one byte.
Each rank takes 1 to 4 bytes; its length is two bits of a control byte, four ranks to a control byte, and
all control bytes stand before the data bytes. Reading looks the lengths up in a table of 256 rows.

File: magic, then as little-endian 64-bit numbers the counts of documents, ids and data bytes, each
document's id, whether it has one (a byte), and its count of ids; control bytes; data bytes. The file
ranks.bin has the id of each rank. Files are named so that their order is that of the documents.

Documents stand in ascending order of their id, null ids first; equal ids by their contents. Null and
empty texts have the end id alone. An empty table gives no file but ranks.bin. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import by_chunk, new_path, stored, table

MAGIC = b"FTOK0001"
IDS_PER_FILE = 4_000_000
#: Range partitions at most; their number has seven digits in a file's name.
MOST_PARTS = 8_192
_SHIFTS = np.array([0, 2, 4, 6], dtype=np.uint8)
#: The four lengths that each control byte stands for.
LENGTHS = (((np.arange(256)[:, None] >> _SHIFTS) & 3) + 1).astype(np.int64)


def pack_ranks(v: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of the ranks."""
    v = v.astype("<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    padded[: len(v)] = code
    control = np.bitwise_or.reduce(padded.reshape(-1, 4) << _SHIFTS, axis=1).astype(np.uint8) if len(v) else padded
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].ravel()[:n]
    at = np.cumsum(size) - size
    data = np.concatenate([data, np.zeros(4, dtype=np.uint8)])
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def file_bytes(doc_ids: list, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack_ranks(ranks)
    head = np.array([len(doc_ids), len(ranks), len(data)], dtype="<i8")
    ids = np.array([0 if i is None else i for i in doc_ids], dtype="<i8")
    known = np.array([i is not None for i in doc_ids], dtype=np.uint8)
    return b"".join([MAGIC, head.tobytes(), ids.tobytes(), known.tobytes(), counts.astype("<i8").tobytes(), control, data])


def from_bytes(blob: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, counts and ranks of a file."""
    if blob[:8] != MAGIC:
        raise ValueError("not a token file")
    n, m, size = np.frombuffer(blob, "<i8", 3, 8).tolist()
    ids = np.frombuffer(blob, "<i8", n, 32)
    known = np.frombuffer(blob, np.uint8, n, 32 + 8 * n)
    counts = np.frombuffer(blob, "<i8", n, 32 + 9 * n)
    at = 32 + 17 * n
    control = np.frombuffer(blob, np.uint8, -(-m // 4), at)
    return [i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)], counts, unpack_ranks(control, np.frombuffer(blob, np.uint8, size, at + len(control)), m)


def put(path: str, blob: bytes) -> None:
    """Writes a file of the shared store: under another name first, so that a task's second attempt does no harm."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    own = f"{inner}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 'driver'}.part"
    with store.open_output_stream(own) as out:
        out.write(blob)
    store.move(own, inner)


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, end_id: int = tokens.END_ID, ids_per_file: int = IDS_PER_FILE, most_parts: int = MOST_PARTS) -> None:
    """Encodes the documents and writes their ids to files under path (a URI that driver and executors share)."""
    from pyarrow import fs

    vocab = vocab or tokens.vocabulary()
    kind = "<u2"  # ids fit: see the check below
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def encode(rows, texts):
        ids, n = tokens.encode(texts, vocab, end_id)
        if len(ids) and int(ids.max()) > 0xFFFF:
            raise ValueError("a vocabulary of more than 65,536 ids")
        data, ends = ids.astype(kind).tobytes(), (2 * np.cumsum(n)).tolist()
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([data[a:b] for a, b in zip([0, *ends], ends, strict=False)], pa.binary()), pa.array(n, pa.int64())], names=["doc_id", "ids", "n"])

    coded = stored(docs.mapInArrow(by_chunk(encode), "doc_id long, ids binary, n long"), "ids", "zstd")

    def count(batches):
        total = np.zeros(1 << 16, dtype=np.int64)
        for rows in batches:
            for ids in rows.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=1 << 16)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["id", "n"])

    counts = coded.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = [r.id for r in counts.orderBy(F.desc("n"), "id").collect()]  # at most as many as the vocabulary has
    rank = np.zeros(1 << 16, dtype=np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(inner)
    put(f"{path}/ranks.bin", np.array(ranked, dtype="<u4").tobytes())

    def write(batches):
        part, number, size, ids, n, held = TaskContext.get().partitionId(), 0, 0, [], [], []

        def flush():
            nonlocal number, size
            ranks = rank[np.concatenate(held)]
            put(f"{path}/{part:07d}-{number:09d}.tok", file_bytes(ids, np.array(n), ranks))
            number, size = number + 1, 0
            ids.clear(), n.clear(), held.clear()

        for rows in batches:
            for doc_id, blob in zip(rows.column("doc_id").to_pylist(), rows.column("ids"), strict=True):
                ids.append(doc_id)
                held.append(np.frombuffer(blob.as_py(), kind))
                n.append(len(held[-1]))
                size += n[-1]
                if size >= ids_per_file or len(n) >= 1 << 16:
                    flush()
        if n:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

    total = coded.agg(F.sum("n")).first()[0] or 0
    parts = min(most_parts, max(1, math.ceil(total / ids_per_file)))  # beyond, a part writes several files
    ordered = coded.withColumn("tie", F.xxhash64("ids")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    ordered.mapInArrow(write, "part int").write.format("noop").mode("overwrite").save()


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: file, nth (its place there), start (ids before it), doc_id, n_tokens, ids (little-endian uint32)."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{inner}/ranks.bin") as f:
        id_of = np.frombuffer(f.read(), dtype="<u4")

    def decode(batches):
        for rows in batches:
            for name, blob in zip(rows.column("file").to_pylist(), rows.column("content"), strict=True):
                doc_ids, n, ranks = from_bytes(blob.as_buffer())
                ids, ends = id_of[ranks].astype("<u4"), np.cumsum(n)
                for a in range(0, len(n), 2000):
                    b = min(len(n), a + 2000)
                    data = [ids[e - k : e].tobytes() for e, k in zip(ends[a:b].tolist(), n[a:b].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * (b - a)), pa.array(np.arange(a, b)), pa.array((ends - n)[a:b]), pa.array(doc_ids[a:b], pa.int64()), pa.array(n[a:b], pa.int64()), pa.array(data, pa.binary())],
                        names=["file", "nth", "before", "doc_id", "n_tokens", "ids"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(path).select(F.substring_index("path", "/", -1).alias("file"), "content")
    return files.mapInArrow(decode, "file string, nth long, before long, doc_id long, n_tokens long, ids binary")


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds start: the ids of all documents before, by the totals of files, summed up within groups of files and then over the groups.

    A file's name begins with its part's seven digits; the files of a part make a group, so no window takes more than MOST_PARTS groups
    or the files of one part.
    """
    files = stored(rows.groupBy("file").agg(F.sum("n_tokens").alias("total")).withColumn("group", F.substring("file", 1, 7)), "files")
    before = lambda w: F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = files.groupBy("group").agg(F.sum("total").alias("total")).select("group", before(Window.orderBy("group")).alias("group_before"))
    placed = files.select("file", "group", before(Window.partitionBy("group").orderBy("file")).alias("in_group")).join(F.broadcast(groups), "group")  # MOST_PARTS groups at most
    earlier = placed.select("file", (F.col("group_before") + F.col("in_group")).alias("earlier"))
    return rows.join(earlier, "file").withColumn("start", F.col("earlier") + F.col("before")).drop("earlier", "before")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    digests = stored(read_token_files(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "digests")
    return with_starts(digests).select("doc_id", "start", "n_tokens", "ids_crc32", "file")
