"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters, digits and underscores. A document is a candidate for an item if
they share a seed: a run of `min_match` words. Of each candidate pair, tiles are found by running
Karp-Rabin: matches of unmarked words are extended from hashed seeds, the longest match that overlaps no
marked word is marked on both sides, and so on down to `min_match` words. The tiles need not keep their
order, so reordered passages count in full. The document is contaminated by the item if the tiles cover at
least `coverage` of the item's words. An item shorter than `min_match` words matches as a whole only.

Documents are scanned once, whatever the benchmark's size: a bit map of the items' seeds, of at most MOST_BITS
bits, is broadcast, and a document that has seeds in it is kept as the hashes of the words that they cover, with
a mark at each gap. So passages count however far they lie apart, and a long document costs no more than what it
may share. Its seeds are joined with the items' rarer ones (salted, beyond `block_chars` characters of benchmark), so many that a
document which covers enough of an item has one of them. This
also removes what the bit map lets through by chance, and a pair is tiled if the seeds that it shares could
cover enough of the item.

Longest matches are found by bisection over their length with hashes of runs of words, in time that grows with
the words and not with the pairs of places, so repeated words do no harm. Among matches of one length the one
that comes first in the document is marked first, and then the first in the item.

Null and empty texts, and items without words, match nothing. Repeated documents and items give a row
each. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PLAIN_TABLE, Words, by_chunk, chunks, mix, runs, stored, table

MIN_MATCH, COVERAGE = 5, 0.5
#: Items of more characters than this are joined by shuffles, others broadcast.
BLOCK_CHARS = 4_000_000
#: The bit map of seeds has 2 ** 16 bits at least, 32 for each seed, and this many at most (128 MB).
MOST_BITS = 30
SALTS = 16
#: Stands between stretches of a document.
_GAP = np.uint64(0)
#: General punctuation and no-break space, which the scan of bytes would take for letters.
_WIDE = re.compile("[ -⁯　 «»]")


def _words(texts: list) -> Words:
    return Words([_WIDE.sub(" ", t.lower()) if t else t for t in texts], PLAIN_TABLE)


def _doubled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by runs of powers of two; a run is two of them that overlap."""
    k = 1
    while 2 * k <= n:
        h = mix(mix(h[:-k]) + h[k:]) if len(h) > k else h[:0]
        k *= 2
    if k == n or not len(h):
        return h
    return mix(mix(h[: max(0, len(h) - n + k)] ^ np.uint64(n)) + h[n - k :]) if len(h) > n - k else h[:0]


def _free_runs(h: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the runs of n words that are all free."""
    g = _doubled(h, n)
    sums = np.concatenate([[0], np.cumsum(free)])
    at = np.flatnonzero(sums[n:] - sums[:-n] == n) if len(h) >= n else np.zeros(0, dtype=np.int64)
    return g[at], at


def _mark(h: tuple, at: tuple, free: tuple, n: int) -> list[tuple[int, int]]:
    """Marks matches of n words, the longest that there are: the first in the document first, each with the first free one in the item."""
    (hash_d, hash_i), (at_d, at_i), (free_d, free_i) = h, at, free
    order = np.argsort(hash_i, kind="stable")
    hash_i, at_i = hash_i[order], at_i[order]
    lo, hi = np.searchsorted(hash_i, hash_d), np.searchsorted(hash_i, hash_d, side="right")
    some = np.flatnonzero(lo < hi)
    after: dict[int, int] = {}  # of each hash, the first place in the item that may be free
    found, end = [], -1
    for p, a, b in zip(at_d[some].tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
        if p < end:
            continue
        k = after.get(a, a)
        # All marks of this length are as long as the run: one that overlaps it covers one of its ends.
        while k < b and not (free_i[at_i[k]] and free_i[at_i[k] + n - 1]):
            k += 1
        after[a] = k
        if k < b:
            q = int(at_i[k])
            free_d[p : p + n] = False
            free_i[q : q + n] = False
            found.append((p, q))
            end = p + n
    return found


def tiles(doc: np.ndarray, item: np.ndarray, least: int, gaps: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of word hashes: (place in doc, place in item, length), the longest first. Gaps in doc match nothing."""
    least = max(1, min(least, len(item)))
    free = np.ones(len(doc), dtype=bool) if gaps is None else ~gaps, np.ones(len(item), dtype=bool)
    found, most = [], min(len(doc), len(item))

    def matches(n: int) -> bool:
        return bool(np.isin(_free_runs(doc, free[0], n)[0], _free_runs(item, free[1], n)[0]).any())

    while most >= least and matches(least):
        low, high = least, most + 1  # a match of low words is known, of high words there is none
        step = 1
        while low + step < high and matches(low + step):
            low, step = low + step, 2 * step
        high = min(high, low + step)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if matches(middle) else (low, middle)
        (hash_d, at_d), (hash_i, at_i) = (_free_runs(x, f, low) for x, f in zip((doc, item), free, strict=True))
        found += [(p, q, low) for p, q in _mark((hash_d, hash_i), (at_d, at_i), free, low)]
        most = low
    return found


def _seeds(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and the words at which they begin. Runs of other lengths have other hashes."""
    g, at = runs(h, doc, k)
    return mix(g ^ np.uint64(k)), at


def _item_seeds(min_match: int):
    """A mapInArrow function over items (item, text): item, words (hashes), seeds, times (of each seed)."""

    def work(batch, texts):
        w = _words(texts)
        h, first = w.hashes(), np.cumsum(w.count) - w.count
        words, seeds, times = [], [], []
        for a, n in zip(first.tolist(), w.count.tolist(), strict=True):
            g, m = np.unique(_seeds(h[a : a + n], np.zeros(n, dtype=np.int64), min(min_match, n))[0] if n else np.zeros(0, dtype=np.uint64), return_counts=True)
            words.append(h[a : a + n].view(np.int64)), seeds.append(g.view(np.int64)), times.append(m.astype(np.int64))
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("item"), pa.array(words, longs), pa.array(seeds, longs), pa.array(times, longs)], names=["item_id", "item", "words", "seeds", "times"])

    return by_chunk(work)


def _bit_map(seeds: DataFrame, n: int) -> np.ndarray:
    """A bit for each seed's low bits; its size has a bound, so it may come to the driver."""
    bits = min(MOST_BITS, max(16, math.ceil(math.log2(max(n, 1) * 32))))
    at = F.col("seed").bitwiseAND(F.lit((1 << bits) - 1))
    rows = seeds.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(seed & 63 AS INT))")).alias("set")).toArrow()
    out = np.zeros(1 << bits - 6, dtype=np.int64)
    out[rows.column("word").to_numpy()] = rows.column("set").to_numpy()
    return out.view(np.uint64)


def _kept_documents(bit_map, lengths: list[int]):
    """A mapInArrow function over documents: those with seeds in the map, as row (a number of its own), words, places and seeds."""

    def run(batches):
        part, nth, bits = TaskContext.get().partitionId(), 0, bit_map.value
        mask = np.uint64(len(bits) * 64 - 1)
        for rows in batches:
            for some, texts in chunks(rows, "text"):
                w = _words(texts)
                h, first = w.hashes(), np.cumsum(w.count) - w.count
                hits: list[tuple] = []
                for k in lengths:
                    g, at = _seeds(h, w.doc, k)
                    ok = bits[(g & mask) >> np.uint64(6)] >> (g & np.uint64(63)) & np.uint64(1) == 1
                    hits.append((g[ok], at[ok], np.full(ok.sum(), k)))
                g, at, size = (np.concatenate(x) for x in zip(*hits, strict=True))
                out: list[tuple] = []
                owner = w.doc[at]
                order = np.argsort(owner, kind="stable")
                owner, g, at, size = owner[order], g[order], at[order], size[order]
                cuts = np.flatnonzero(np.diff(owner, prepend=-1, append=-1)) if len(owner) else []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    t = int(owner[a])
                    delta = np.zeros(w.count[t] + 1, dtype=np.int64)
                    np.add.at(delta, at[a:b] - first[t], 1)
                    np.add.at(delta, at[a:b] - first[t] + size[a:b], -1)
                    place = np.flatnonzero(np.cumsum(delta) > 0)
                    gaps = np.flatnonzero(np.diff(place) > 1) + 1
                    words = np.insert(h[first[t] + place], gaps, _GAP)
                    out.append((t, part << 40 | nth, words.view(np.int64), np.insert(place, gaps, -1).astype(np.int32), np.unique(g[a:b]).view(np.int64)))
                    nth += 1
                cols = list(zip(*out, strict=True)) or [[]] * 5
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], longs), pa.array(cols[3], pa.list_(pa.int32())), pa.array(cols[4], longs)],
                    names=["doc_id", "row", "words", "places", "seeds"],
                )

    return run


def rare_seeds(seeds: DataFrame, hits: DataFrame, min_match: int, coverage: float) -> DataFrame:
    """(seed, item): of each item so many of its seeds, those in the fewest documents first, that a document which covers enough of it has one of them.

    Tiles of min_match words or more that cover c words hold c / min_match of the item's seed places at least, so all places but one
    less than those may be left out: a line that very many documents and items share brings nobody together. An item's own
    seeds, ordered by a window, are as many as its words.
    """
    size = F.least("n", F.lit(min_match))
    places = F.greatest(F.ceil(F.col("n") * coverage / size), F.lit(1)) - 1  # that may be left out
    common = hits.groupBy("seed").agg(F.count("*").alias("documents"))
    met = seeds.join(common, "seed").withColumn("spare", places)  # seeds that no document has are of no use as keys
    # A row stays if those before and after it, in that order, could not all be done without.
    after = F.sum("times").over(Window.partitionBy("item").orderBy(F.desc("documents"), "seed").rowsBetween(Window.unboundedPreceding, 0))
    return met.withColumn("after", after).where(F.col("after") > F.col("spare")).select("seed", "item")


def _tiled(min_match: int, coverage: float):
    """A mapInArrow function over pairs of documents and items: those that tiles cover enough of."""

    def run(batches):
        for rows in batches:
            keep, out = [], []
            for n, row in enumerate(zip(*(rows.column(c) for c in ("words", "places", "seeds", "item_words", "item_seeds", "times")), strict=True)):
                doc, places, seeds, item, item_seeds, times = (x.values.to_numpy() for x in row)
                reach = int(times[np.isin(item_seeds, seeds)].sum()) * min(min_match, len(item))  # words of the item in seeds that the document has, at most
                if reach < coverage * len(item):
                    continue
                got = tiles(doc.view(np.uint64), item.view(np.uint64), min_match, places < 0)
                covered = sum(k for _, _, k in got)
                if covered and covered >= coverage * len(item):
                    keep.append(n)
                    out.append((len(item), covered, covered / len(item), [{"start": p, "length": k} for p, k in sorted((int(places[p]), k) for p, _, k in got)]))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(at), rows.column("item_id").take(at), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))],
                names=["doc_id", "item_id", "item_words", "covered", "coverage", "spans"],
            )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row per contaminated document and item: doc_id, item_id, item_words, covered, coverage, spans (array of start, length in words of the document, ascending)."""
    if min_match < 1:
        raise ValueError("min_match must be 1 at least")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, item_words int, covered int, coverage double, spans array<struct<start:int,length:int>>"

    items = stored(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text IS NOT NULL").withColumn("item", F.monotonically_increasing_id()), "items")
    chars = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    items = stored(items.mapInArrow(_item_seeds(min_match), f"item_id {kinds[1]}, item long, words array<long>, seeds array<long>, times array<long>"), "items").where("size(words) > 0")
    seeds = items.select("item", F.size("words").alias("n"), F.explode(F.arrays_zip("seeds", "times")).alias("s")).select("item", "n", F.col("s.seeds").alias("seed"), F.col("s.times").alias("times"))
    lengths = [r.k for r in items.select(F.least(F.size("words"), F.lit(min_match)).alias("k")).distinct().collect()]  # min_match values at most
    if not lengths:
        return spark.createDataFrame([], schema)
    bit_map = spark.sparkContext.broadcast(_bit_map(seeds, seeds.count()))
    kept = stored(docs.mapInArrow(_kept_documents(bit_map, lengths), f"doc_id {kinds[0]}, row long, words array<long>, places array<int>, seeds array<long>"), "kept")

    hits = kept.select("row", F.explode("seeds").alias("seed"))
    few = chars <= block_chars
    keys = stored(rare_seeds(seeds, hits, min_match, coverage), "keys")
    if few:
        met = hits.join(F.broadcast(keys), "seed")
    else:
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
        met = hits.withColumn("salt", F.pmod("row", F.lit(SALTS))).join(keys.withColumn("salt", salts), ["seed", "salt"])
    pairs = met.select("row", "item").distinct()
    of = items.select("item", "item_id", F.col("words").alias("item_words"), F.col("seeds").alias("item_seeds"), "times")
    both = pairs.join(F.broadcast(of) if few else of, "item").join(kept.select("row", "doc_id", "words", "places", "seeds"), "row")
    return both.select("doc_id", "item_id", "words", "places", "seeds", "item_words", "item_seeds", "times").mapInArrow(_tiled(min_match, coverage), schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
