"""Many small fits at once against one after another."""

import numpy as np
import pytest

from fathom.operators import calibration


def plain(x, y, target):
    most = x.max(axis=0)
    most[most == 0] = 1.0
    x, w = x / most, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= 0.05 * (x.T @ (p - y) / len(y) + 0.01 / len(y) * w)
    return 1 / (1 + np.exp(-(target / most) @ w))


def test_batched_fits():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 21, 50)
    x, y, target = rng.integers(0, 30, (50, 20, 8)).astype(float), rng.integers(0, 2, (50, 20)).astype(float), rng.integers(0, 30, (50, 8)).astype(float)
    x[:, :, 4] = 0
    got = calibration.batched_probabilities(x, y, n, target)
    assert got == pytest.approx([plain(x[i, :k], y[i, :k], target[i]) for i, k in enumerate(n.tolist())])


def test_calibrated_scores(spark):
    done = spark.createDataFrame([(i, [5.0, float(i), None], i < 20 if i < 40 else None) for i in range(60)], "id long, features array<double>, passed boolean")
    tasks = spark.createDataFrame([(1, 50, [5.0, 1.0, 0.0]), (2, 50, [5.0, 30.0, 0.0]), (3, 50, [1.0, 1.0, 1.0]), (4, 95, [0.0, 0.0, 0.0]), (5, 20, [1.0, 1.0, 1.0]), (6, 98, [5.0, 30.0, 0.0])], "query_id long, raw_score int, features array<double>")
    rows = [(q, i, s, r + 1) for q, first, s, n in ((1, 0, 0.9, 20), (2, 20, 0.9, 20), (3, 0, 0.4, 20), (4, 0, 0.9, 2), (6, 40, 0.8, 20)) for r, i in enumerate(range(first, first + n))]
    near = spark.createDataFrame(rows, "query_id long, id long, similarity double, rank int")
    got = {r.query_id: r for r in calibration.calibrated_scores(tasks, done, near, [30, 60, 100]).collect()}
    assert {q: (r.calibrated_score, r.adjustment, r.neighbour_count, r.cold_start) for q, r in got.items()} == {
        1: (50 + (-5 if got[1].confidence > 0.7 else 0), -5 if got[1].confidence > 0.7 else 0, 20, False), 2: (60 if got[2].confidence < 0.3 else 50, 10 if got[2].confidence < 0.3 else 0, 20, False),
        3: (61, 11, 20, True), 4: (95, 0, 2, True), 5: (31, 11, 0, True), 6: (100 if got[6].confidence < 0.3 else 98, 2 if got[6].confidence < 0.3 else 0, 20, False),
    }
    assert got[1].confidence > 0.7 and got[2].confidence < 0.3 and got[6].confidence < 0.3
    assert got[3].confidence == 0
    few = calibration.calibrated_scores(tasks, done.limit(5), near, [30, 60, 100]).collect()
    assert all(r.cold_start for r in few)
