"""Running sums over large keys, pruning, batches, strong components: against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from fathom.operators import graph, running


def test_running_sums(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["hot"] * 5 + ["a", None]), i, draw.choice([None, 0, 1, 5, -3])) for i in range(900)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "k string, i int, v int, _x string").repartition(6)
    got = {r.i: (r.s, r.c) for r in running.running_sums(df.withColumn("one", F.lit(1)), ["k"], [F.desc("i")], {"s": "v", "c": "one"}).collect()}
    want, at = {}, {}
    for k, i, v in sorted(rows, key=lambda r: -r[1]):
        s, c = at.get(k, (0, 0))
        want[i] = at[k] = (s + (v or 0), c + 1)
    assert got == want
    assert running.running_sums(df.limit(0), ["k"], [F.col("i")], {"s": "v"}).count() == 0


def plain_prune(turns, budget):
    total, out = 0, []
    for turn, full, bare in sorted(turns, reverse=True):
        cost = bare if total > budget * 0.5 else full
        if total + cost > budget:
            break
        out.append((turn, cost, total > budget * 0.5, total + cost))
        total += cost
    return out


def test_pruned_turns(spark):
    draw = random.Random(2)
    convs = {c: [(t, f := draw.randrange(0, 60), draw.randrange(0, f + 1)) for t in range(draw.randrange(1, 40))] for c in range(60)}
    convs[99] = [(t, 3, 1) for t in range(1500)]
    df = spark.createDataFrame([(c, *t) for c, ts in convs.items() for t in ts], "conv_id int, turn int, full int, bare int").repartition(5)
    for budget in (0, 100, 301):
        got = sorted((r.conv_id, r.turn, r.cost, r.stripped, r.spent) for r in running.pruned_turns(df, budget).collect())
        assert got == sorted((c, *x) for c, ts in convs.items() for x in plain_prune(ts, budget))


def test_compaction_fallback(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u" * 600), (1, 2, "assistant", " "), (1, 3, "assistant", "one"), (1, 4, "assistant", "x" * 300), (1, 5, "user", "later"), (2, 0, "assistant", None), (3, 0, "user", None)]
    got = {r.conv_id: r for r in running.compaction_fallback(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), "P").collect()}
    assert got[1].original_intent == "u" * 500
    assert got[1].completed_work == ["P: one", "P: " + "x" * 200]
    assert (got[2].original_intent, got[2].completed_work, got[3].original_intent) == ("Unknown intent", [], "")
    assert got[3].next_actions == ["Continue P-phase execution"]


@pytest.mark.parametrize(("most_rows", "most_tokens"), [(10, 100), (1, 7), (7, 1), (1000, 60)])
def test_batches(spark, most_rows, most_tokens):
    draw = random.Random(most_rows)
    rows = [(i * 3, draw.choice([None, 0, 1, 9, 40, 55, 300])) for i in range(300)]
    got = running.batches(spark.createDataFrame(rows, "id long, tokens int"), most_rows, most_tokens).collect()
    of: dict = {}
    for r in sorted(got):
        of.setdefault(r.batch, []).append((r.id, r.tokens or 0))
    assert sorted(of) == list(range(len(of)))
    assert [i for b in sorted(of) for i, _ in of[b]] == [i for i, _ in rows]
    for b in of.values():
        assert len(b) <= most_rows
        assert sum(t for _, t in b) <= most_tokens or len([t for _, t in b if t]) == 1


def brute_components(edges):
    nodes = sorted({x for e in edges for x in e})
    reach = {v: {v} for v in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            for v in nodes:
                if a in reach[v] and not reach[b] <= reach[v]:
                    reach[v] |= reach[b]
                    changed = True
    return {v: max(u for u in reach[v] if v in reach[u]) for v in nodes}


@pytest.mark.parametrize("seed", range(4))
def test_strong_components(spark, seed):
    draw = random.Random(seed)
    n = draw.randrange(5, 30)
    edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(draw.randrange(5, 2 * n))] + [(50, 51), (51, 52), (52, 50), (52, 60), (70, 70)]
    df = spark.createDataFrame([*edges, edges[0]], "src long, dst long")
    want = brute_components(edges)
    assert {r.id: r.comp for r in graph.strong_components(df).collect()} == want
    on = {v for v in want if sum(c == want[v] for c in want.values()) > 1} | {a for a, b in edges if a == b}
    assert {r.id for r in graph.cycles(df).collect()} == on
    assert 60 not in on and 51 in on
    assert graph.strong_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_strong_components_of_pairs(spark, seed):
    """Edges that lead back, paths of pairs, cycles of several pairs, null ends; by numbers and by names."""
    draw = random.Random(10 + seed)
    edges = [(a, b, draw.random() < 0.3) for a, b in ((draw.randrange(60), draw.randrange(60)) for _ in range(70))]
    edges += [(100 + i, 101 + i, True) for i in range(12)] + [(120, 121, True), (122, 123, True), (124, 125, None), (121, 122, False), (123, 120, None), (123, 124, False)]
    want = brute_components([(a, b) for a, b, _ in edges] + [(b, a) for a, b, back in edges if back])
    df = spark.createDataFrame([*edges, (None, 200, True), (201, None, False), (None, None, None), (100, 101, False)], "src long, dst long, back boolean")
    assert {r.id: r.comp for r in graph.strong_components(df, "back").collect()} == want | {200: 200, 201: 201}
    name = lambda c: F.concat(F.lit("n"), F.lpad(F.col(c).cast("string"), 5, "0")).alias(c)
    names = graph.strong_components(df.select(name("src"), name("dst"), "back"), "back")
    assert {int(r.id[1:]): int(r.comp[1:]) for r in names.collect()} == want | {200: 200, 201: 201}


def test_components(spark):
    draw = random.Random(5)
    pairs = [(draw.randrange(80), draw.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (90, 90)]
    want = brute_components(pairs + [(b, a) for a, b in pairs])
    assert {r.id: r.comp for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == want
