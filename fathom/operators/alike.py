"""Pairs of similar sets of longs: exact, by prefix filtering, without a row for each token of each set.

With a set's tokens in an order that all sets share, the rarest first, two sets that are similar enough share one of the first n - ceil(threshold * n) + 1 of each, and
the smaller one has it even earlier. The order goes by counts in buckets of tokens, which every task holds, so a set's first tokens are taken where its row is; only these
are shuffled. Where two sets meet by one, their sketches are compared, which every task holds too (of REPS sets and REPS others at a time, pass by pass). What is left is verified by part:
pairs that hang together go to one part, and a set is sent to a part once, not once for each of its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.storage import small, stored

#: Tokens are counted in so many buckets (a power of two).
BUCKETS = 1 << 22
#: Longs of a set's sketch that tasks hold, of a second one of sets with more than LARGE tokens, and of the one that is made where pairs are verified.
SKETCH, WIDE, FINE = 8, 32, 64
LARGE = 300
#: So many sets' sketches are a block; tasks hold two.
REPS = 1_500_000
#: So many first tokens, or sets, are a part; rows that share a token with more than HOT are dealt out again; so many pairs are compared at a time.
ROWS, SETS, HOT, PAIRS = 400_000, 2_000, 20_000, 250_000
#: Beyond so many pairs, those that hang together are several parts.
GROUP = 50_000
#: A part gives its pairs when it has found so many.
MOST = 4_000_000
SLACK = 1e-6


def _sketches(tokens: np.ndarray, row: np.ndarray, rows: int, longs: int) -> np.ndarray:
    """Of each row, bits that say of how many of its tokens there is an odd number: each bit that differs is a token that one row alone has."""
    out = np.zeros((rows, longs), dtype=np.uint64)
    bit = (tokens.view(np.uint64) >> np.uint64(22)) % np.uint64(64 * longs)
    np.bitwise_xor.at(out, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, their rows, and the rows' sizes."""
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n), n


def _held(sets: DataFrame) -> Broadcast:
    """Ids, in order, with sizes, sketches, the places of their second sketches (-1: none), and these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1_000):
                part = b.slice(a, 1_000)
                tokens, row, n = _lists(part.column("t"))
                bits, wide = _sketches(tokens, row, len(n), SKETCH), _sketches(tokens, row, len(n), WIDE)
                kept = [x.tobytes() + (y.tobytes() if size > LARGE else b"") for x, y, size in zip(bits, wide, n, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), pa.array(kept, pa.binary())], names=["id", "n", "bits"])

    rows = sets.mapInArrow(run, "id long, n long, bits binary").toArrow().sort_by("id")
    n, kept = rows["n"].to_numpy().astype(np.int32), rows["bits"].to_pylist()
    bits = np.frombuffer(b"".join(k[: 8 * SKETCH] for k in kept), dtype=np.uint64).reshape(-1, SKETCH)
    wide = np.frombuffer(b"".join(k[8 * SKETCH :] for k in kept), dtype=np.uint64).reshape(-1, WIDE)
    at = np.where(n > LARGE, np.cumsum(n > LARGE) - 1, -1).astype(np.int32)
    return sets.sparkSession.sparkContext.broadcast((rows["id"].to_numpy(), n, bits, at, wide))


def _counts(sets: DataFrame) -> Broadcast:
    """How many tokens of all sets are in each bucket."""
    bucket = F.col("x").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket")
    rows = sets.select(F.explode("t").alias("x")).groupBy(bucket).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return sets.sparkSession.sparkContext.broadcast(counts)


def _least(share: float, n: np.ndarray) -> np.ndarray:
    """ceil(share * n), or one less where that is a matter of rounding."""
    return np.ceil(share * n - SLACK).astype(np.int64)


def _firsts(counts: Broadcast, threshold: float, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(part, key, id, at) of the first tokens of each set: at is the token's place; beside a hot token, sets are dealt out, and meet all that are smaller, whose copies have at below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counts.value
        for b in batches:
            for a in range(0, b.num_rows, 1_000):
                part = b.slice(a, 1_000)
                tokens, row, n = _lists(part.column("t"))
                c = of[tokens & (BUCKETS - 1)]
                order = np.lexsort((tokens, c, row))
                tokens, c = tokens[order], c[order]
                at = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
                used = (at < (n - _least(threshold, n) + 1)[row]) & (c > 1)  # a token that one set alone has brings nobody together, but takes its place
                tokens, c, row, at = tokens[used], c[used], row[used], at[used]
                ids = part.column("id").to_numpy(zero_copy_only=False)[row]
                ways = 1 + c // HOT
                own = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % ways
                early = np.flatnonzero((ways > 1) & (at < (n - _least(2 * threshold / (1 + threshold), n) + 1)[row]))
                copy = np.repeat(early, ways[early])
                way = np.arange(len(copy)) - np.repeat(np.cumsum(ways[early]) - ways[early], ways[early])
                other = way != own[copy]
                copy, way = copy[other], way[other]
                key, way = np.concatenate([tokens, tokens[copy]]), np.concatenate([own, way])
                where = ((key.view(np.uint64) + way.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)) % np.uint64(parts)
                yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(key), pa.array(np.concatenate([ids, ids[copy]])), pa.array(np.concatenate([at, -1 - at[copy]]).astype(np.int32))], names=["part", "key", "id", "at"])

    return run


def _meet(one: Broadcast, two: Broadcast | None, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b) of a part's rows that may be similar: of one block, or of one and the other. A pair comes twice only among very many."""
    share = threshold / (1 + threshold)  # of both sizes together, what similar sets have in common at least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, bits, at_wide, wide_bits = one.value
        ids2, sizes2, bits2, at_wide2, wide_bits2 = one.value if two is None else two.value
        rows = pa.Table.from_batches(batches)
        key, id_, at = (rows.column(c).to_numpy() for c in ("key", "id", "at"))
        at_id = np.minimum(np.searchsorted(ids, id_), len(ids) - 1)
        mine = ids[at_id] == id_
        at_id = np.where(mine, at_id, np.minimum(np.searchsorted(ids2, id_), len(ids2) - 1))
        n = np.where(mine, sizes[np.minimum(at_id, len(ids) - 1)], sizes2[np.minimum(at_id, len(ids2) - 1)]).astype(np.int64)
        asks, at = at >= 0, np.where(at < 0, -1 - at, at).astype(np.int64)
        order = np.lexsort((n, key))
        key, at, n, asks, at_id, mine, id_ = key[order], at[order], n[order], asks[order], at_id[order], mine[order], id_[order]
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        wide = int(n.max()) + 2
        early = np.flatnonzero(at < n - _least(2 * share, n) + 1)
        of_early = (group * wide + n)[early]
        # A set meets those of its size and smaller ones that share the token, of which so much may follow that they could be similar.
        most = np.minimum(n, np.floor((n - at) / share - n + SLACK).astype(np.int64))
        first = np.searchsorted(of_early, group * wide + _least(threshold, n), "left")
        last = np.searchsorted(of_early, group * wide + np.maximum(most, 0), "right")
        many = np.where(asks, np.maximum(last - first, 0), 0)

        def answer(codes: list[np.ndarray]) -> pa.RecordBatch:
            code = np.unique(np.concatenate(codes))
            u, v = ids[code >> 32], ids2[code & 0xFFFFFFFF]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])

        ends, begin, out = np.cumsum(many), 0, [np.zeros(0, dtype=np.int64)]
        while begin < len(many):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
            m = many[begin:end]
            for low in range(0, int(m.max()), PAIRS):  # a row may meet very many by itself
                some = np.clip(m - low, 0, PAIRS)
                y = np.repeat(np.arange(begin, end), some)
                x = early[np.repeat(first[begin:end] + low - np.cumsum(some) + some, some) + np.arange(len(y))]
                good = (n[x] - at[x] >= share * (n[x] + n[y]) - SLACK) & ((n[x] < n[y]) | (id_[x] < id_[y]))
                good &= mine[x] & mine[y] if two is None else mine[x] != mine[y]
                x, y = x[good], y[good]
                x, y = np.where(mine[x], x, y), np.where(mine[x], y, x)
                u, v = at_id[x], at_id[y]
                most_apart = (1 - 2 * share) * (n[x] + n[y]) + SLACK
                near = np.bitwise_count(bits[u] ^ bits2[v]).sum(axis=1) <= most_apart
                u, v, most_apart = u[near], v[near], most_apart[near]
                i, j = at_wide[u], at_wide2[v]
                large = np.flatnonzero((i >= 0) & (j >= 0))
                near = np.ones(len(u), dtype=bool)
                near[large] = np.bitwise_count(wide_bits[i[large]] ^ wide_bits2[j[large]]).sum(axis=1) <= most_apart[large]
                u, v = u[near], v[near]
                out.append(np.unique((np.minimum(u, v) << 32 | np.maximum(u, v)) if two is None else (u << 32 | v)))
                if sum(map(len, out)) > MOST:
                    yield answer(out)
                    out = []
            begin = end
        if out:
            yield answer(out)

    return run


def _verified(threshold: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(a, b, similarity) of a part's pairs with Jaccard >= threshold, from its sets (id, t)."""

    def run(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        ids, lists = sets.column("id").to_numpy(), sets.column("t").combine_chunks()
        a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
        if not len(ids) or not len(a):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        tokens, row, n = _lists(lists)
        begin = np.cumsum(n) - n
        order = np.argsort(ids, kind="stable")
        i, j = order[np.searchsorted(ids, a, sorter=order)], order[np.searchsorted(ids, b, sorter=order)]
        bits = _sketches(tokens, row, len(n), FINE)
        similarity = np.zeros(len(a))
        for s in range(0, len(a), 10_000):
            x, y = i[s : s + 10_000], j[s : s + 10_000]
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1)
            for p in np.flatnonzero(apart <= (1 - threshold) / (1 + threshold) * (n[x] + n[y]) + SLACK):
                left, right = tokens[begin[x[p]] : begin[x[p]] + n[x[p]]], tokens[begin[y[p]] : begin[y[p]] + n[y[p]]]
                at = np.minimum(np.searchsorted(right, left), len(right) - 1)
                both = int((right[at] == left).sum())
                similarity[s + p] = both / (len(left) + len(right) - both)
        good = similarity >= threshold
        return pa.table({"a": pa.array(a[good]), "b": pa.array(b[good]), "similarity": pa.array(similarity[good])})

    return run


def _cover(pairs: DataFrame) -> DataFrame:
    """pairs (stored: a, b) with the part where each is verified: of the smallest row beside a or b, and those of a, if very many hang together."""
    beside = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    label = beside.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("label"))
    grouped = pairs.join(label.select(F.col("x").alias("a"), F.col("label").alias("la")), "a").join(label.select(F.col("x").alias("b"), F.col("label").alias("lb")), "b")
    grouped = stored(grouped.select("a", "b", F.least("la", "lb").alias("grp")), "grouped", "zstd")
    large = stored(grouped.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("grp", F.ceil(F.col("n") / GROUP).alias("ways")), "large")
    return grouped.join(small(large), "grp", "left").select("a", "b", "grp", F.pmod(F.xxhash64("a"), F.coalesce("ways", F.lit(1))).alias("way"))


def alike(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs a < b of sets (stored; id long, t: array of longs, distinct, ascending, not empty) with Jaccard >= threshold."""
    n = F.size("t").cast("long")
    rows, firsts = sets.agg(F.count("*"), F.coalesce(F.sum(n - F.ceil(n * threshold) + 1), F.lit(0))).first()
    blocks, parts = max(1, math.ceil(rows / REPS)), max(1, math.ceil(firsts / ROWS))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    counts = _counts(sets)
    keys = sets.mapInArrow(_firsts(counts, threshold, parts), "part int, key long, id long, at int")
    keys = stored(keys, "keys", "zstd") if blocks > 1 else keys
    found = None
    for i in range(blocks):
        one = _held(sets.where(block == i))
        for j in range(i, blocks):
            two = _held(sets.where(block == j)) if j > i else None
            some = keys.where(block.isin(i, j)) if blocks > 1 else keys
            new = stored(some.groupBy("part").applyInArrow(_meet(one, two, threshold), "a long, b long").distinct(), "pairs", "zstd")
            found = new if found is None else found.unionByName(new)
            if two is not None:
                two.destroy()
        one.destroy()
    counts.destroy()
    pairs = _cover(found)
    to = F.struct("grp", "way")
    parts = max(1, math.ceil(pairs.select(F.explode(F.array("a", "b")).alias("id"), to.alias("to")).distinct().count() / SETS))
    pairs = stored(pairs.select("a", "b", F.pmod(F.xxhash64(to), F.lit(parts)).alias("part")), "parts", "zstd")
    need = stored(pairs.select(F.explode(F.array("a", "b")).alias("id"), "part").distinct(), "need", "zstd")
    sent = sets.join(small(need), "id")
    return sent.select("id", "t", "part").groupBy("part").cogroup(pairs.groupBy("part")).applyInArrow(_verified(threshold), "a long, b long, similarity double")
