"""The vector index against brute force."""

import numpy as np
import pytest

from fathom.operators import vectors
from fathom.operators.evaluate import known_items


def rows_of(rng, n, kind):
    if kind == "random":
        return rng.normal(size=(n, 12))
    centres = rng.normal(size=(15, 12))
    return centres[rng.integers(0, 15, n)] + 0.05 * rng.normal(size=(n, 12))


def brute(x, ids, queries, k, groups=None, earlier=False):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    for i, q in queries:
        v = np.floor(u @ u[q] * 1e6 + 0.5) / 1e6
        ok = ids != i
        if groups is not None:
            ok &= groups == groups[q]
        if earlier:
            ok &= ids < i
        best = sorted((-v[j], int(ids[j])) for j in np.flatnonzero(ok))[:k]
        out += [(int(i), b, r + 1, round(-s, 6)) for r, (s, b) in enumerate(best)]
    return sorted(out)


def frame(spark, x, ids, groups):
    return spark.createDataFrame([(int(i), [float(v) for v in row], int(g)) for i, row, g in zip(ids, x, groups, strict=True)], "id long, embedding array<double>, label int").repartition(5)


@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_exact(spark, kind, monkeypatch):
    rng = np.random.default_rng(4)
    x = rows_of(rng, 700, kind)
    x[600:680] = x[3]  # copies tie
    ids, groups = rng.permutation(10_000)[:700], rng.integers(0, 4, 700)
    df = frame(spark, x, ids, groups)
    at = list(range(0, 700, 35)) + [3, 610]
    asked = frame(spark, x[at], ids[at], groups[at]).toDF("query_id", "q", "label")
    want = brute(x, ids, [(ids[i], i) for i in at], 9)
    got = lambda found: sorted((r.query_id, r.id, r["rank"], r.similarity) for r in found.collect())
    index = vectors.built(df, cells=20)
    reads = []
    assert got(vectors.search(index, asked, 9, first_probes=1, reads=reads)) == want
    share = sum(r["compared"] for r in reads) / (len(at) * 700)
    assert share <= 1
    if kind == "clustered":
        assert share < 0.6
        near = got(vectors.search(index, asked, 9, probes=4))
        hit = {r[:2] for r in near} & {r[:2] for r in want}
        assert len(hit) >= 0.9 * len(want)
    assert got(vectors.search(vectors.built(df), asked, 9)) == want
    by_group = vectors.built(df, group=df.label, cells=6)
    assert got(vectors.search(by_group, asked, 3, group=asked.label, earlier=True)) == brute(x, ids, [(ids[i], i) for i in at], 3, groups, True)
    monkeypatch.setattr(vectors, "BLOCK_CELLS", 100)
    assert got(vectors.search(index, asked, 9)) == want


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [2.0, 0.0]), (9, [0.0, 3.0]), (None, [1.0, 0.0]), (8, [2.0, 0.0])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "id long, embedding array<double>, cell string, group int")
    asked = df.where("id IS NOT NULL").dropDuplicates(["id"]).selectExpr("id AS query_id", "embedding AS q", "cell")
    for cells in (None, 3):
        got = sorted((r.query_id, r.id, r["rank"], r.similarity) for r in vectors.search(vectors.built(df, cells=cells), asked, 2).collect())
        assert got == [(1, 8, 1, 1.0), (1, 8, 2, 1.0), (8, 1, 1, 1.0), (8, 9, 2, 0.0), (9, 1, 1, 0.0), (9, 8, 2, 0.0)]
    none = vectors.built(df.limit(0))
    assert vectors.search(none, asked, 2).collect() == []
    assert vectors.search(vectors.built(df), asked.limit(0), 2).collect() == []


def test_known_items(spark):
    rows = spark.createDataFrame([(1, "a"), (4, "a"), (4, "a"), (9, "a"), (2, "b"), (3, None), (5, None), (7, "c"), (6, "c")], "id long, label string")
    asked = rows.distinct().withColumnRenamed("id", "query_id")
    assert sorted(map(tuple, known_items(rows, asked).collect())) == [(1, 4), (4, 1), (6, 7), (7, 6), (9, 1)]
