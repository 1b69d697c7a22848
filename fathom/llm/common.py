"""What the training-data operators share: storage, word scans, joins by checked size, components.

Numpy code here runs inside Spark tasks on one bounded chunk of rows at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.storage import HOT, looked_up, new_path, small, stored

__all__ = ["HOT", "looked_up", "new_path", "small", "stored"]

#: Bytes of text that a task handles at once.
CHUNK_BYTES = 1 << 18
#: Bytes of rows that Spark hands to a Python worker at once. Its default (64 MB) is held by the JVM and by the worker, for each task; chunks are smaller anyway.
BATCH_BYTES = "2m"
#: ASCII white space: tab to carriage return, and space.
SPACES = bytes([9, 10, 11, 12, 13, 32])

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands BATCH_BYTES of rows to Python workers at once, or less if it was set so."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.fullmatch(r"(\d+)\s*([kmg]?)b?", spark.conf.get(key).strip().lower())
    if not held or int(held[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[held[2]] > 2 << 20:
        spark.conf.set(key, BATCH_BYTES)


def semi(left: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of left whose key is in ids (distinct and stored). Broadcast only if ids is small enough, else shuffled."""
    return left.join(small(ids), on, "left_semi")


def without(left: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of left whose key is not in ids (distinct and stored). A null key is in none."""
    return left.join(small(ids), on, "left_anti")


def fold_of(id_col: str, n: int) -> Column:
    """crc32(id as text) mod n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def chunks(rows: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batch of about limit bytes of text, each with its texts. A longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(rows.column(text)), 0).to_pylist()
    first = held = 0
    for i, n in enumerate(sizes):
        if i > first and held + n > limit:
            part = rows.slice(first, i - first)
            yield part, part.column(text).to_pylist()
            first, held = i, 0
        held += n
    if first < len(sizes):
        part = rows.slice(first)
        yield part, part.column(text).to_pylist()


def by_chunk(work: Callable[[pa.RecordBatch, list], pa.RecordBatch], text: str = "text") -> Callable:
    """A mapInArrow function that applies work to each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part, texts in chunks(rows, text):
                yield work(part, texts)

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Joins batches that are sorted by key so that no group is cut."""
    held: list[pa.RecordBatch] = []
    for rows in batches:
        if not rows.num_rows:
            continue
        k = rows.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
        if cut:
            yield pa.Table.from_batches([*held, rows.slice(0, cut)])
            held = []
        elif held and held[-1].column(key)[-1] != rows.column(key)[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(rows.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


# ---------------------------------------------------------------- words and hashes

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_WINDOW = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit (splitmix64)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(256, dtype=np.uint64) * _GOLD)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 4096), base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans ascend and don't overlap. Memory is bounded by a window."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _WINDOW)))
        base, n = int(starts[i]), int(ends[j - 1] - starts[i])
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data[base : base + n]] * _power(_BASE, n), out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * _power(pow(_BASE, -1, 1 << 64), n + 1)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def splitter(separators: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(separators)] = True
    return out


SPACE_TABLE = splitter(SPACES)
#: Separators of plain words: all ASCII but letters, digits and the underscore.
PLAIN_TABLE = splitter(bytes(i for i in range(128) if not (chr(i).isalnum() or chr(i) == "_")))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of some texts: spans in one buffer of bytes, and the number of each word's text."""

    def __init__(self, texts: list, separators: np.ndarray, ascii_lower: bool = False):
        parts = [(t or "").encode() for t in texts]
        self.size = np.array([len(p) for p in parts], dtype=np.int64)
        data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
        self.data = LOWER[data] if ascii_lower else data
        self.first = np.concatenate([[0], np.cumsum(self.size + 1)])  # where each text begins
        gap = np.concatenate([[True], separators[data]])
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.doc = np.searchsorted(self.first, self.starts, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def runs(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, and the word at which each begins."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    g = h[:n]
    for j in range(1, k):
        g = mix(g) + h[j : n + j]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(g[at]), at


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of k-word runs; of a shorter text its whole sequence. Returns hashes and texts, sorted by text and hash."""
    h = words.hashes()
    first = np.concatenate([[0], np.cumsum(words.count)])
    got = [runs(h, words.doc, k)[0]]
    docs = [words.doc[runs(h, words.doc, k)[1]]]
    for n in range(1, k):
        short = np.flatnonzero(words.count == n)
        g = h[first[short]]
        for j in range(1, n):
            g = mix(g) + h[first[short] + j]
        got.append(mix(g + np.uint64(n)))
        docs.append(short)
    g, d = np.concatenate(got), np.concatenate(docs)
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    return g[new], d[new]


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each end of the edges (a, b) reaches.

    Labels go to neighbours and then to their labels' labels, so the rounds grow with the logarithm of
    the longest path. Each round is stored; only the number of changes comes to the driver. A node with
    very many neighbours, and a label that very many nodes have, are joined as hot keys.
    """
    pairs = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp"), F.count("*").alias("degree")), "labels")
    crowded = pairs.limit(HOT + 1).count() > HOT  # else no key can be hot
    while True:
        ends = labels.select(F.col("node").alias("b"), "comp", "degree")
        near = looked_up(pairs, ends, ["b"], "degree") if crowded else pairs.join(ends, "b")
        step = labels.join(near.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near")), "node").select("node", "degree", F.col("comp").alias("old"), F.least("comp", "near").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("comp").alias("above"))
        if crowded:
            step = stored(step, "step")
            up = stored(step.groupBy("next").agg(F.count("*").alias("times")).join(up, "next"), "up")
        met = looked_up(step, up, ["next"], "times") if crowded else step.join(up, "next")
        labels_2 = stored(met.select("node", "degree", "old", F.least("next", "above").alias("comp")), "labels")
        changed = labels_2.where("comp <> old").limit(1).count()
        labels = labels_2.select("node", "degree", "comp")
        if not changed:
            return labels.select("node", "comp")
