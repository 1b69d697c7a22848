"""Periodic runs against brute force."""

import random

import numpy as np

from fathom.llm.periodic import OP11_SQL, op11_periodic_runs, periodic_runs, word_runs
from tests.oracle import agree, connect


def brute(w):
    found, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_word_runs():
    draw = random.Random(5)
    for _ in range(3000):
        kinds, n = draw.choice([1, 2, 2, 3, 5, 40]), draw.randrange(0, 90)
        w = [draw.randrange(kinds) for _ in range(n)]
        for _ in range(draw.randrange(4)):  # repeated stretches, also within each other
            at, q, times = draw.randrange(n + 1), draw.randrange(1, 14), draw.randrange(2, 9)
            w[at:at] = (w[at : at + q] or [7]) * times
        assert word_runs(np.array(w, dtype=np.int64)) == brute(w), w


def test_long_sequences():
    rng = np.random.default_rng(3)
    one = np.zeros(60_000, dtype=np.int64)
    assert word_runs(one) == [(0, 60_000, 1)]
    period = rng.integers(0, 5000, 1700)
    w = np.concatenate([rng.integers(0, 5000, 3000), np.tile(period, 6), rng.integers(5000, 9000, 2000)])
    assert [(k, q) for _, k, q in word_runs(w)] == [(6 * 1700 + _before(w[:3000], period) + _after(w, period), 1700)]


def _before(head, period):
    k = 0
    while head[-1 - k] == period[-1 - k % len(period)]:
        k += 1
    return k


def _after(w, period):
    at, k = 3000 + 6 * len(period), 0
    while w[at + k] == period[k % len(period)]:
        k += 1
    return k


def test_edges(spark):
    texts = [None, "", " \t\n", "a a a a a", "a a a a a a", "x a\x0bb a b a\x0cb a b y", "é b é b é b é b", "w " * 20_000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(4, texts[4], "clash"), (None, texts[4], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect()), key=repr)
    want = [
        (0, 0, [], ""), (1, 0, [], ""), (2, 0, [], ""), (3, 5, [], "a a a a a"), (4, 6, [(0, 6, 1)], "a"), (4, 6, [(0, 6, 1)], "a"), (None, 6, [(0, 6, 1)], "a"),
        (5, 10, [(1, 8, 2)], "x a b y"), (6, 8, [(0, 8, 2)], "é b"), (7, 20_000, [(0, 20_000, 1)], "w"),
    ]
    assert got == sorted(want, key=repr)
    assert periodic_runs(df.limit(0)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    df = op11_periodic_runs(spark, sf)
    assert df.where("n_runs > 0").count() > 0
    agree(df, OP11_SQL, connect(sf))
