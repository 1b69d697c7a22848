"""Stateful streams: the same rows in differently cut batches, and timers moved by the watermark."""

import os
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from fathom.streaming import jobs, stateful

T0 = datetime(2024, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a job over rows that come in batches of their own: lists of tuples, a file each."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.with_rocksdb(spark)
    runs = []

    def run(batches, schema, job, mode="append"):
        place = tmp_path / f"run{len(runs)}"
        runs.append(place)
        (place / "in").mkdir(parents=True)
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{place}/part{i}")
            name = next((place / f"part{i}").glob("*.parquet"))
            name.rename(place / "in" / f"{i:03d}.parquet")
            os.utime(place / "in" / f"{i:03d}.parquet", (1_000_000 + 60 * i, 1_000_000 + 60 * i))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{place}/in")
        out = []
        query = job(source).writeStream.outputMode(mode).foreachBatch(lambda df, i: out.append([tuple(r) for r in df.collect()])).option("checkpointLocation", f"file://{place}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return out

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def cut(rows, *at):
    ends = [0, *at, len(rows)]
    return [rows[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def grams(text):
    out = set()
    for w in "".join(c if c.isalnum() else " " for c in text.lower()).split():
        out |= {f"  {w} "[i : i + 3] for i in range(len(w) + 1)}
    return out


def rules(text, near):
    """Marks in the text stand for the classifier's answer."""
    word = text.split()[0]
    return (word.upper(), near[0][0]) if word in ("update", "delete", "noop") else ("ADD", None)


def plain_writes(rows):
    valid, out = {}, []
    for project, i, text in sorted(rows, key=lambda r: r[1]):
        mine = grams(text)
        near = []
        for j, other in valid.get(project, {}).items():
            both = len(mine & other)
            if both and both / len(mine | other) >= 0.3:
                near.append((j, both / len(mine | other)))
        near = sorted(near, key=lambda r: (-r[1], r[0]))[:3]
        if near and near[0][1] >= 0.6:
            out.append((project or "", i, "SKIP", near[0][0], round(near[0][1], 4)))
            continue
        op, target = rules(text, near) if near else ("ADD", None)
        if op in ("UPDATE", "DELETE"):
            valid[project].pop(target, None)
        out.append((project or "", i, op, target, None))
        if op not in ("DELETE", "NOOP"):
            valid.setdefault(project, {})[i] = mine
    return sorted(out)


def test_writes_do_not_depend_on_batches(spark, stream):
    draw = random.Random(6)
    words = ["river", "stone", "cloud", "maple", "ember", "north"]
    rows = []
    for i in range(45):
        first = draw.choice(["", "", "", "update ", "delete ", "noop "])
        rows.append((draw.choice(["a", "a", "b", None]), i, first + " ".join(draw.choices(words, k=draw.randrange(1, 5)))))
    want = plain_writes(rows)
    assert {w[2] for w in want} == {"ADD", "SKIP", "UPDATE", "DELETE", "NOOP"}
    job = lambda df: stateful.written(df, classify=rules)
    clean = lambda out: sorted((p, i, op, None if o is None or pd.isna(o) else int(o), None if s is None or pd.isna(s) else s) for b in out for p, i, op, o, s in b)
    for cuts in ([], [7, 20], [1, 2, 3, 30, 44]):
        assert clean(stream(cut(rows, *cuts), "project string, id long, text string", job)) == want
    # The same as a batch query, and the versions that follow.
    df = spark.createDataFrame(rows, "project string, id long, text string")
    decisions = job(df).cache()
    assert clean([[tuple(r) for r in decisions.collect()]]) == want
    got = {r.id: (r.valid_from, r.invalid_at) for r in stateful.versions(df.selectExpr("id", "id * 10 AS at"), decisions).collect()}
    ends = {t: 10 * i for _, i, op, t, _ in reversed(want) if op in ("UPDATE", "DELETE")}
    assert got == {i: (10 * i, ends.get(i)) for _, i, op, _, _ in want if op in ("ADD", "UPDATE")}


def test_rate_limit_as_a_stream(stream):
    draw = random.Random(7)
    rows = [(i, T0 + timedelta(seconds=i * draw.choice([1, 3])), draw.choice(["x", "y"])) for i in range(60)]
    rows.sort(key=lambda r: (r[1], r[0]))
    want, past = [], {}
    for i, at, key in rows:
        times = [t for t in past.get(key, []) if t > at - timedelta(seconds=20)]
        if ok := len(times) < 4:
            times.append(at)
        past[key] = times
        want.append((i, key, ok))
    got = stream(cut(rows, 11, 40), "event_id long, ts timestamp, key string", lambda df: jobs.rate_limited(df, 4, 20))
    assert sorted(r for b in got for r in b) == sorted(want)


def test_ring_buffer(stream):
    rows = [(i, T0 + timedelta(minutes=(i * 7) % 50), "ab"[i % 2]) for i in range(30)]
    got = stream(cut(rows, 9, 10, 25), "event_id long, ts timestamp, key string", lambda df: stateful.ring_buffer(df, 3), "update")
    seen = {}
    for n, batch in zip([9, 10, 25, 30], got, strict=True):
        for key in "ab":
            new = sorted((t, i) for i, t, k in rows[:n] if k == key)[-3:]
            mine = sorted((p, i) for k, i, p in batch if k == key)
            if mine:
                seen[key] = [i for _, i in mine]
                assert seen[key] == [i for _, i in reversed(new)]
    assert set(seen) == {"a", "b"}


def ms(t):
    return int((t - datetime(1970, 1, 1)).total_seconds() * 1000)


def test_watchdog(stream):
    h = lambda n: T0 + timedelta(hours=n)
    moves = [
        [(1, h(0), 0, "in_progress", None), (2, h(0), 1, "in_progress", None), (3, h(0), 2, "in_progress", "WATCHDOG_EXEMPT"), (4, h(0), 3, "in_progress", None), (4, h(0), 4, "done", None)],
        [(2, h(40), 5, "in_progress", "claimed anew"), (9, h(47), 6, "pending", None)],
        [(9, h(49), 7, "pending", None)],
        [(9, h(95), 8, "pending", None)],
        [(9, h(99), 9, "pending", None)],
    ]
    got = stream(moves, "task_id long, ts timestamp, seq long, status string, notes string", lambda df: stateful.reverted_claims(df, 48))
    rows = sorted(r for b in got for r in b)
    assert rows == [(1, "pending", ms(h(0)), ms(h(48))), (2, "pending", ms(h(40)), ms(h(88)))]


def test_retention(stream):
    d = lambda n: T0 + timedelta(days=n)
    uses = [[(1, d(0), "agent"), (2, d(0), "lesson"), (3, d(0), None), (4, d(0), "agent")], [(4, d(20), "agent")], [(9, d(31), "agent")], [(9, d(100), "agent")], [(8, d(130), "lesson")], [(8, d(200), "lesson")]]
    got = stream(uses, "id long, ts timestamp, source string", lambda df: stateful.expired_rows(df, {"agent": 30, "lesson": 90}, 180))
    rows = {(r[0], r[3]) for b in got for r in b}
    assert {(1, ms(d(30))), (2, ms(d(90))), (3, ms(d(180))), (4, ms(d(50)))} <= rows
