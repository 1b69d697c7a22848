"""Inverted-file vector index: exact nearest rows by cosine, read cell by cell; fewer cells on request.

Unit vectors are put in the cell of their nearest centre; each cell knows the least and the greatest angle between its centre and its rows.
The angle between a query and any row of a cell is at least what the triangle inequality leaves of the query's angle to the centre, so a
cell has a bound on the cosine. A query reads its cells in the order of that bound, four times as many in each round, until no cell
that is left can beat its k-th row. Where `probes` is given, it reads so many cells and stops, and may miss rows.

Centres are fitted by k-means on the first `sample` rows in the order of a hash; every row is indexed. Rows are stored
sorted by cell, so a filter on cells skips files and row groups; a cell of any size is split among tasks. Queries come in blocks,
which are broadcast (BLOCK_CELLS numbers at most); each task keeps k rows of a query.

Vectors that are null, zero, hold null or non-finite components, or have another number of components than the index, are
not indexed, and as queries find nothing. Ties in the similarity, rounded to `digits`, go to the smaller id. Ids are longs; rows with
a null id are left out. An empty table finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.storage import stored

SAMPLE, LLOYD_ROUNDS, ROWS_PER_CELL, MOST_CELLS, SEED = 32_768, 6, 2_000, 1_024, 7
#: Queries of a block times cells, components or k, whichever are most, at most.
BLOCK_CELLS = 4_000_000
#: Up to so many cells are named in a filter of the scan.
MOST_NAMED = 256
_MARGIN = 1e-9


def unit(vector: str, size: int | None = None) -> Column:
    """The vector in double precision with length 1; null if it has no direction."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    ok = (length > 0) & (length < float("inf"))
    if size is not None:
        ok = ok & (F.size(vector) == size)
    return F.when(ok, F.transform(x, lambda v: v / length))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of arrays of equal size as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fitted(x: np.ndarray, cells: int, rounds: int = LLOYD_ROUNDS, seed: int = SEED) -> np.ndarray:
    """Unit centres of unit vectors, by Lloyd's method with cosine; a centre that gets no vector takes the one that is worst placed."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        dots = x @ centres.T
        of, best = dots.argmax(axis=1), dots.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        length = np.linalg.norm(sums, axis=1)
        lost = np.flatnonzero(length < 1e-12)
        sums[lost], length[lost] = x[np.argsort(best)[: len(lost)]], 1.0
        centres = sums / length[:, None]
    return centres


@dataclass
class VectorIndex:
    """rows (id, cell, unit, group), stored by cell; centres; each cell's least and greatest angle and number of rows."""

    rows: DataFrame
    centres: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries, cells): no row of the cell has a greater cosine with the query."""
        angle = np.arccos(np.clip(q @ self.centres.T, -1, 1))
        gap = np.maximum(np.maximum(angle - self.high, self.low - angle), 0)
        return np.where(self.count > 0, np.cos(np.minimum(gap, math.pi)), -2.0)


def built(vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding", group: Column | None = None, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """The index of all vectors. group (any type, null is a group too): a search may ask for rows of the query's own group alone."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("_v"), (F.lit(0).cast("long") if group is None else F.xxhash64(group)).alias("group"))
    size = rows.where("_v IS NOT NULL").agg(F.mode(F.size("_v"), True)).first()[0] or 1
    rows = stored(rows.where("id IS NOT NULL").select("id", "group", unit("_v", size).alias("unit")).where("unit IS NOT NULL"), "units")
    n = rows.count()
    want = max(1, min(cells or math.ceil(n / ROWS_PER_CELL), MOST_CELLS, max(n, 1)))
    if want == 1:
        centres = np.eye(1, size)
    else:
        centres = fitted(_matrix(rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("unit").toArrow().column("unit")), want)
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            dots = _matrix(b.column("unit")) @ shared.value.T
            of = dots.argmax(axis=1)
            angle = np.arccos(np.clip(dots[np.arange(len(of)), of], -1, 1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "group", "unit")), pa.array(of.astype(np.int32)), pa.array(angle)], names=["id", "group", "unit", "cell", "angle"])

    placed = rows.mapInArrow(assign, "id long, group long, unit array<double>, cell int, angle double")
    if want > 1:
        placed = placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
    else:
        placed = placed.sortWithinPartitions("id")
    placed = stored(placed, "cells")
    low, high, count = np.zeros(len(centres)), np.zeros(len(centres)), np.zeros(len(centres), dtype=np.int64)
    for r in placed.groupBy("cell").agg(F.min("angle"), F.max("angle"), F.count("*")).collect():  # MOST_CELLS rows at most
        low[r[0]], high[r[0]], count[r[0]] = r[1], r[2], r[3]
    return VectorIndex(placed.select("id", "cell", "unit", "group"), centres, low, high, count)


def _best(values: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row, ties to the smaller id."""
    order = np.argsort(ids, axis=1, kind="stable")
    values, ids = np.take_along_axis(values, order, 1), np.take_along_axis(ids, order, 1)
    order = np.argsort(-values, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(values, order, 1), np.take_along_axis(ids, order, 1)


def _top_of(values: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row as narrow matrices, ids ascending, so that of equal values the first ones count."""
    if values.shape[1] > k:
        least = -np.partition(-values, k - 1, axis=1)[:, k - 1 : k]
        above, equal = values > least, values == least
        keep = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        at = np.nonzero(keep)[1].reshape(len(values), k)
        return np.take_along_axis(values, at, 1), ids[at]
    return values, np.broadcast_to(ids, values.shape)


def _scan(shared, k: int, digits: int, own_group: bool, earlier: bool):
    """A mapInArrow function over the index: the task's k best rows of each query among the cells that it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q, groups, first, members = shared.value
        best_v, best_i = np.full((len(asked), k), -np.inf), np.full((len(asked), k), np.iinfo(np.int64).max)
        scale = 10.0**digits
        for b in batches:
            if not b.num_rows:
                continue
            ids, cell, group, x = b.column("id").to_numpy(), b.column("cell").to_numpy(), b.column("group").to_numpy(), _matrix(b.column("unit"))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                of = members[first[cell[s]] : first[cell[s] + 1]]
                step = max(1, 2_000_000 // max(1, e - s))
                for a in range(0, len(of), step):
                    some = of[a : a + step]
                    v = np.floor((q[some] @ x[s:e].T) * scale + 0.5) / scale
                    out = ids[None, s:e] == asked[some, None]
                    if own_group:
                        out |= group[None, s:e] != groups[some, None]
                    if earlier:
                        out |= ids[None, s:e] > asked[some, None]
                    v[out] = -np.inf
                    top_v, top_i = _top_of(v, ids[s:e], k)
                    best_v[some], best_i[some] = _best(np.concatenate([best_v[some], top_v], axis=1), np.concatenate([best_i[some], top_i], axis=1), k)
        at, place = np.nonzero(best_v > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(asked[at]), pa.array(best_i[at, place]), pa.array(best_v[at, place])], names=["query_id", "id", "similarity"])

    return run


def _search_block(index: VectorIndex, asked: np.ndarray, q: np.ndarray, groups: np.ndarray, k: int, probes: int | None, first_probes: int, digits: int, own_group: bool, earlier: bool, reads: list | None) -> DataFrame:
    bound = index.bounds(q)
    order = np.argsort(-bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, 1)
    cells, kth = len(index.centres), np.full(len(asked), -np.inf)
    found, done, until = None, 0, min(probes or first_probes, len(index.centres))
    place = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    while True:
        # A cell is read unless the k rows that are known are all better than any of its own can be, also after rounding.
        open_ = (bound[:, done:until] > -2) & (bound[:, done:until] + 0.5 / 10**digits + _MARGIN >= kth[:, None])
        at, nth = np.nonzero(open_)
        if len(at):
            cell = order[at, nth + done]
            by = np.argsort(cell, kind="stable")
            first = np.searchsorted(cell[by], np.arange(cells + 1))
            shared = index.rows.sparkSession.sparkContext.broadcast((asked, q, groups, first, at[by]))
            named = np.unique(cell)
            rows = index.rows.where(F.col("cell").isin(named.tolist())) if cells > len(named) <= MOST_NAMED else index.rows
            new = rows.mapInArrow(_scan(shared, k, digits, own_group, earlier), "query_id long, id long, similarity double")
            new = (found.unionByName(new) if found is not None else new).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            if reads is not None:
                reads.append({"queries": len(np.unique(at)), "cells": len(named), "compared": int(index.count[cell].sum())})
            if until == cells or probes:
                return new
            found = stored(new, "found").select("query_id", "id", "similarity")
            got = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity").alias("kth")).where(F.col("n") == k).toArrow()  # a row per query of the block at most
            where = np.searchsorted(asked, got.column("query_id").to_numpy())
            kth[where] = got.column("kth").to_numpy()
        done, until = until, min(cells, 4 * until)
        if done == cells or not ((bound[:, done:] > -2) & (bound[:, done:] + 0.5 / 10**digits + _MARGIN >= kth[:, None])).any():
            if found is None:
                return index.rows.sparkSession.createDataFrame([], "query_id long, id long, similarity double, rank int")
            return found.withColumn("rank", F.row_number().over(place))


def search(index: VectorIndex, queries: DataFrame, k: int, query_id: str = "query_id", vector_col: str = "q", group: Column | None = None, earlier: bool = False, probes: int | None = None, first_probes: int = 4, digits: int = 6, reads: list | None = None) -> DataFrame:
    """(query_id, id, rank, similarity): the k rows nearest to each query (distinct ids) by rounded cosine, itself apart.

    group: rows of the query's own group alone. earlier: rows of smaller ids alone. probes: so many cells and no more, not exact.
    reads: a list that gets, for each round, how many queries were open, cells read and pairs compared.
    """
    size = index.centres.shape[1]
    rows = queries.select(F.col(query_id).cast("long").alias("query_id"), (F.lit(0).cast("long") if group is None else F.xxhash64(group)).alias("group"), unit(vector_col, size).alias("q")).where("q IS NOT NULL AND query_id IS NOT NULL")
    rows = stored(rows, "queries")
    blocks = max(1, math.ceil(rows.count() * max(len(index.centres), size, k) / BLOCK_CELLS))
    parts = []
    for b in range(blocks):
        t = (rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).orderBy("query_id").toArrow()  # a block
        if t.num_rows:
            args = t.column("query_id").to_numpy(), _matrix(t.column("q")), t.column("group").to_numpy()
            part = _search_block(index, *args, k, probes, first_probes, digits, group is not None, earlier, reads)
            parts.append(part if blocks == 1 else stored(part, "block"))
    if not parts:
        return index.rows.sparkSession.createDataFrame([], "query_id long, id long, rank int, similarity double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query_id", "id", F.col("rank").cast("int").alias("rank"), F.round("similarity", digits).alias("similarity"))
