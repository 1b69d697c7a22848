"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosine checks.

A vector is normalised; table t hashes it with k quantised random projections floor((a.x + b) / width),
a normal and b uniform. Vectors that agree in all k projections of a table share a bucket. The number of
projections follows the logarithm of the number of vectors, so that a vector meets about one unrelated
vector in a bucket, and the number of tables is such that a pair at the bound itself is missed with a
probability below `MISS`; nearer pairs are missed less often still.

All pairs of a bucket are checked in double precision, block against block, inside a task; a bucket of
more than `block` vectors is dealt out as pairs of blocks, so that no task holds a whole hot bucket. A pair
that shares buckets in several tables counts in the first of them, so counts need no list of pairs: a task
sends each vector's number of links, and for connectivity its component within the task's links.

Equal vectors are one class: its members are linked with each other and with all that one of them is.
Vectors that are null, empty, zero, or hold null or non-finite components are linked with nothing, as are
vectors of other lengths with each other. Rows with equal ids are separate vectors whose links are counted
apart, in one component. A row with a null id takes no part. An empty table gives no rows. Other columns are
not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, looked_up, mix, stored, table, whole_groups

WIDTH, BLOCK, MISS = 2.4, 512, 2e-6
SEED = 29
#: Tasks of at most so many rows are compared together.
SMALL = 32


def agreement(cosine: float, width: float = WIDTH) -> float:
    """The probability that one quantised projection agrees on two unit vectors (Datar et al., 2004)."""
    r = width / math.sqrt(max(2 - 2 * cosine, 1e-12))
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def parameters(n: int, least: float) -> tuple[int, int]:
    """Tables and projections for n vectors."""
    k = max(12, math.ceil(math.log(max(n, 2)) / -math.log(agreement(0.0))))
    return math.ceil(math.log(MISS) / math.log1p(-min(agreement(least) ** k, 1 - 1e-9))), k


def raw(lists: pa.Array, kind: str) -> list[bytes | None]:
    """The bytes of each vector that has a direction, else None."""
    out: list[bytes | None] = []
    for v in lists.to_pylist():
        x = np.array([np.nan if c is None else c for c in v or []], dtype=kind)
        out.append((x + 0).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
    return out


def units(blobs: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors of equal length, in double precision."""
    x = np.stack([np.frombuffer(b, dtype=kind) for b in blobs]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


_drawn: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def _draw(dimensions: int, n: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and shifts of n projections, drawn once in a worker."""
    have = _drawn.get((dimensions, n, width, seed))
    if have is None:
        rng = np.random.default_rng([seed, dimensions])
        have = _drawn[dimensions, n, width, seed] = rng.standard_normal((dimensions, n)), rng.uniform(0, width, n)
    return have


def cells(x: np.ndarray, a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
    """floor((x.a + b) / width). The sums of a product of matrices depend on its shape in their last bits: where that could
    matter, next to a bound, they are added up one dimension at a time, so a row's cells don't depend on the other rows."""
    z = (x @ a + b) / width
    row, column = np.nonzero(np.abs(z - np.rint(z)) < 1e-9)
    if len(row):
        acc = b[column].copy()
        for d in range(x.shape[1]):
            acc += x[row, d] * a[d, column]
        z[row, column] = acc / width
    return np.floor(z).astype(np.int64).view(np.uint64)


def projections(x: np.ndarray, tables: int, k: int, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """(rows, tables) bucket keys of unit vectors."""
    a, b = _draw(x.shape[1], tables * k, width, seed)
    out = np.empty((len(x), tables), dtype=np.uint64)
    for i in range(0, len(x), 256):
        cell = cells(x[i : i + 256], a, b, width).reshape(-1, tables, k)
        key = np.zeros(cell.shape[:2], dtype=np.uint64) + np.arange(tables, dtype=np.uint64) + np.uint64(x.shape[1] << 16)
        for j in range(k):
            key = mix(key) + cell[:, :, j]
        out[i : i + 256] = mix(key)
    return out


def hashed(vectors: DataFrame, kind: str, tables: int, k: int) -> DataFrame:
    """id, v (the vector's bytes; null if it has no direction), keys."""

    def work(batches):
        for rows in batches:
            for at in range(0, rows.num_rows, 512):
                part = rows.slice(at, 512)
                blobs = raw(part.column("v"), kind)
                keys: list = [None] * len(blobs)
                for size in {len(b) for b in blobs if b}:
                    which = [i for i, b in enumerate(blobs) if b and len(b) == size]
                    for i, key in zip(which, projections(units([blobs[i] for i in which], kind), tables, k).view(np.int64), strict=True):
                        keys[i] = key
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(blobs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "v", "keys"])

    return vectors.mapInArrow(work, "id long, v binary, keys array<long>")


def _exact(x: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether the cosines of pairs are at least `least`, by sums that don't depend on what they are computed with."""
    out = np.empty(len(i), dtype=bool)
    for a in range(0, len(i), 16_384):
        out[a : a + 16_384] = np.einsum("ij,ij->i", x[i[a : a + 16_384]], x[j[a : a + 16_384]]) >= least
    return out


def _linked(x: np.ndarray, first: np.ndarray, size: np.ndarray, mine: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs (i, j) of rows, i < j, within tasks that begin at `first`; of a task of two blocks those between the blocks."""
    got_i, got_j = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for n in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():  # small tasks: all that are of one size at once
        i, j = (np.ravel(first[size == n][:, None] + at) for at in np.triu_indices(n, 1))
        apart = (lo[i] == hi[i]) | (mine[i] != mine[j])
        got_i.append(i[apart]), got_j.append(j[apart])
    i, j = np.concatenate(got_i), np.concatenate(got_j)
    ok = _exact(x, i, j, least)
    got_i, got_j = [i[ok]], [j[ok]]
    for a, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        if lo[a] == hi[a]:
            i, j = np.nonzero(x[a : a + n] @ x[a : a + n].T >= least - 1e-9)
            i, j = i[i < j], j[i < j]
        else:
            left, right = np.flatnonzero(mine[a : a + n] == lo[a]), np.flatnonzero(mine[a : a + n] == hi[a])
            i, j = np.nonzero(x[a + left] @ x[a + right].T >= least - 1e-9)
            i, j = left[i], right[j]
            i, j = np.minimum(i, j), np.maximum(i, j)
        ok = _exact(x[a : a + n], i, j, least)
        got_i.append(a + i[ok]), got_j.append(a + j[ok])
    return np.concatenate(got_i), np.concatenate(got_j)


def _compare(kind: str, tables: int, k: int, least: float):
    """A mapInArrow function over tasks: for each vector with links its number of those that count here, and the least row it is connected with here."""

    def run(batches):
        for t in whole_groups(batches, "task"):
            sizes = pc.binary_length(t.column("v")).to_numpy()
            for length in np.unique(sizes).tolist():  # the vectors of a task are of one length
                part = t.filter(pa.array(sizes == length))
                task, node, key, mine, lo, hi, copies = (part.column(c).to_numpy() for c in ("task", "node", "key", "mine", "lo", "hi", "copies"))
                first = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
                x = units(part.column("v").to_pylist(), kind)
                i, j = _linked(x, first, np.diff(first, append=len(task)), mine, lo, hi, least)
                if not len(i):
                    continue
                # The pair counts in the first table in which the two share a bucket.
                ends, row = np.unique(node, return_index=True)
                ends, row = ends[np.isin(ends, node[np.concatenate([i, j])])], row[np.isin(ends, node[np.concatenate([i, j])])]
                keys = projections(x[row], tables, k).view(np.int64)
                here = np.empty(len(i), dtype=bool)
                for a in range(0, len(i), 65_536):
                    p, q = (keys[np.searchsorted(ends, node[e[a : a + 65_536]])] for e in (i, j))
                    here[a : a + 65_536] = p[np.arange(len(p)), (p == q).argmax(axis=1)] == key[i[a : a + 65_536]]
                n = np.bincount(i[here], weights=copies[j[here]], minlength=len(node)) + np.bincount(j[here], weights=copies[i[here]], minlength=len(node))
                root = np.arange(len(node))
                while True:
                    before = root.copy()
                    np.minimum.at(root, i, root[j])
                    np.minimum.at(root, j, root[i])
                    root = root[root]
                    if (root == before).all():
                        break
                at = np.unique(np.concatenate([i, j]))
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(n[at].astype(np.int64)), pa.array(node[root[at]])], names=["node", "n", "root"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, block: int = BLOCK) -> DataFrame:
    """One row per row: vec_id, n_links, component_id (smallest id reachable by links), kept."""
    if not 0 < least < 1:
        raise ValueError("least must lie between 0 and 1")
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    tables, k = parameters(vectors.count(), least)
    rows = hashed(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")), kind, tables, k)
    rows = stored(rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(SEED), "v")), "vectors")
    good = rows.where("v IS NOT NULL AND id IS NOT NULL")
    classes = good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.first("keys").alias("keys"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "directions")

    keys = classes.select("node", F.explode("keys").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block)
    placed = keys.join(sizes, "key").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node", "key"), F.col("blocks")))
    # Block i meets each block j: the row goes to the pairs (i, j) that have its own block on either side.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    placed = placed.select("node", "key", "mine", other.alias("other")).withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    tasks = placed.select("node", "key", "mine", "lo", "hi", F.xxhash64("key", "lo", "hi").alias("task"))
    tasks = tasks.join(classes.select("node", "v", "copies"), "node").repartition("task").sortWithinPartitions("task")

    found = stored(tasks.mapInArrow(_compare(kind, tables, k, least), "node long, n long, root long"), "found")
    counts = found.groupBy("node").agg(F.sum("n").alias("others"))
    named = classes.select("node", "rep", "copies", "h1", "h2")
    twice = good.join(good.groupBy("id").count().where("count > 1").select("id"), "id", "left_semi").select("id", "h1", "h2").join(named, ["h1", "h2"]).select("id", F.col("node").alias("root"))
    tied = twice.join(twice.groupBy("id").agg(F.min("root").alias("node")), "id").where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    comp = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct().unionByName(tied))
    named = named.join(counts, "node", "left").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = stored(named.select("h1", "h2", "copies", "rep", "comp", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    groups = stored(named.groupBy("comp").agg(F.min("rep").alias("least"), F.count("*").alias("times")), "groups")
    named = stored(looked_up(named, groups, ["comp"], "times").select("h1", "h2", "copies", "n_links", "least"), "named")
    # Vectors without a direction have no class.
    out = looked_up(rows.where("v IS NOT NULL AND id IS NOT NULL").select("id", "h1", "h2"), named, ["h1", "h2"], "copies").select("id", "n_links", F.col("least").alias("root"))
    rest = rows.where("v IS NULL OR id IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("root"))
    out = out.unionByName(rest)
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("root").alias("component_id"), F.coalesce(F.col("root") == F.col("id"), F.lit(True)).alias("kept"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE given AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
good AS (SELECT vec_id, v FROM given WHERE len(v) > 0 AND list_aggregate(list_transform(v, lambda c: coalesce(isfinite(c), false)), 'bool_and') AND list_aggregate(list_transform(v, lambda c: c <> 0), 'bool_or')),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM given LEFT JOIN counts USING (vec_id) LEFT JOIN comp USING (vec_id)
"""
