"""Content-addressed vectors, resumed jobs, data sources."""

import json
import os

import pytest
from pyspark.sql import functions as F

from fathom.operators import backfill
from fathom.sources import datasources
from fathom.storage import new_path


def test_vectors_by_content(spark):
    store = new_path(spark, "vectors")
    rows = [(1, "alpha beta"), (2, "alpha beta"), (3, None), (4, ""), (5, "gamma")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, text string, digest string")
    out, counts = backfill.with_vectors(df, store)
    assert counts == {"texts": 5, "different": 3, "from_store": 0, "embedded": 3}
    got = {r.id: list(r.vector) for r in out.collect()}
    assert got[1] == got[2] and got[3] == got[4] == [0.0] * 64
    assert sum(v * v for v in got[1]) == pytest.approx(1)

    def forbidden(texts):
        return backfill.hashed_vectors(texts.withColumn("text", F.raise_error(F.concat(F.lit("embedded "), "digest"))))

    again, counts = backfill.with_vectors(df.where("id < 3"), store, embed=forbidden)
    assert counts == {"texts": 2, "different": 1, "from_store": 1, "embedded": 0}
    assert {r.id: list(r.vector) for r in again.collect()} == {1: got[1], 2: got[1]}
    more, counts = backfill.with_vectors(df.unionByName(df.selectExpr("id + 10 AS id", "concat(text, ' new') AS text", "digest")), store)
    assert counts == {"texts": 10, "different": 6, "from_store": 3, "embedded": 3}
    assert more.count() == 10


def test_job_is_resumed(spark):
    rows = spark.createDataFrame([(i, 10 + i % 7) for i in range(500)], "id long, tokens int")
    whole, broken = new_path(spark, "job"), new_path(spark, "job")
    work = lambda df: df.select("id", "batch", (F.col("tokens") * 2).alias("doubled"))
    want = backfill.run(rows, work, whole, 10**9, 20, 200, wave=4)
    assert want["status"] == "done" and want["waves"] > 5 and want["left"] == 0
    table = sorted(map(tuple, backfill.results(spark, whole).collect()))
    assert [r[0] for r in table] == list(range(500))

    calls = []

    def fails(df):
        calls.append(df.agg(F.min("id")).first()[0])
        if len(calls) == 3:
            raise RuntimeError("killed")
        return work(df)

    with pytest.raises(RuntimeError):
        backfill.run(rows, fails, broken, 10**9, 20, 200, wave=4)
    # Other rows come meanwhile; the job keeps its plan, stops at its budget, and is done in a third run.
    changed = rows.where("id < 100")
    part = backfill.run(changed, fails, broken, want["tokens"] // 3, 20, 200, wave=4)
    assert part["status"] == "stopped" and 0 < part["tokens"] <= want["tokens"] // 3
    last = backfill.run(changed, fails, broken, 10**9, 20, 200, wave=4)
    assert last["status"] == "done" and 2 + part["waves"] + last["waves"] == want["waves"]
    assert len(calls) == want["waves"] + 1 and calls[2] == calls[3]
    assert sorted(map(tuple, backfill.results(spark, broken).collect())) == table
    assert backfill.run(rows, fails, broken, 5, 20, 200, wave=4) == {"status": "done", "waves": 0, "tokens": 0, "left": 0}
    for budget in (None, 0, -1):
        with pytest.raises(ValueError, match="budget"):
            backfill.run(rows, work, whole, budget)


def test_waves_together(spark):
    rows = spark.createDataFrame([(i, 10 + i % 7) for i in range(500)], "id long, tokens int")
    path, calls = new_path(spark, "job"), []

    def work(df, fails=False):
        calls.append(df.agg(F.min("id"), F.max("id")).first())
        return df.select("id", F.raise_error(F.lit("killed")).cast("int").alias("x") if fails else F.lit(1).alias("x"))

    want = {"rows": sorted(range(500)), "tokens": sum(10 + i % 7 for i in range(500))}
    first = backfill.run(rows, work, path, want["tokens"] // 2, 20, 200, wave=1, together=8)
    assert first["status"] == "stopped" and first["tokens"] <= want["tokens"] // 2 and first["waves"] > 8
    assert len(calls) == -(-first["waves"] // 8)  # jobs, not one for each wave
    with pytest.raises(Exception, match="killed"):
        backfill.run(rows, lambda df: work(df, True), path, 10**9, 20, 200, wave=1, together=8)
    # What broke off left files without a mark, under a name that no later run takes.
    rows.where("id > 400").select("id", F.lit(2).alias("x")).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/out/wave={first['waves']}-9999")
    last = backfill.run(rows, work, path, 10**9, 20, 200, wave=1, together=5)
    assert last["status"] == "done" and first["tokens"] + last["tokens"] == want["tokens"]
    assert sorted(r.id for r in backfill.results(spark, path).collect()) == want["rows"]


def test_registry_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text(json.dumps({"registry_version": "1.0", "entries": [{"name": "m", "version": 2, "maintainer": None, "tags": ["x", 1], "extra": {}}, {}]}))
    (tmp_path / "sub" / "b.json").write_text(json.dumps({"registry_version": "1.0", "entries": None}))
    spark.dataSource.register(datasources.RegistrySource)
    got = spark.read.format("registry").load(str(tmp_path)).collect()
    assert [(os.path.basename(r.file), r.name, r.version, r.maintainer, r.tags) for r in got] == [("a.json", "m", "2", None, ["x", "1"]), ("a.json", None, None, None, [])]
    (tmp_path / "c.json").write_text("{broken")
    with pytest.raises(Exception, match="c.json"):
        spark.read.format("registry").load(str(tmp_path)).collect()
    assert spark.read.format("registry").option("lenient", True).load(str(tmp_path)).count() == 2


def test_telemetry_sink(spark, tmp_path):
    spark.dataSource.register(datasources.TelemetrySink)
    schema = "event_id string, event_type string, ts timestamp, project_hash string, payload string"
    rows = [("e1", "phase_start", None, "p", '{"n": 1}'), ("e2", "unknown", None, "p", None), ("e3", "error_class", None, None, "plain"), (None, "party_session", None, "p", None)]
    spark.createDataFrame(rows, schema).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).repartition(3).write.parquet(f"file://{tmp_path}/in")
    events = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")

    def run(state):
        q = events.writeStream.format("telemetry").option("path", str(tmp_path / "log")).option("checkpointLocation", f"file://{tmp_path}/{state}").trigger(availableNow=True).start()
        q.awaitTermination()

    run("s1")
    lines = [json.loads(x) for f in sorted((tmp_path / "log").glob("batch-*.jsonl")) for x in f.read_text().splitlines()]
    assert all(list(x) == datasources.ENVELOPE for x in lines)
    assert {x["event_type"] for x in lines} == {"phase_start", "error_class", "party_session"}
    assert {json.dumps(x["payload"]) for x in lines} == {'{"n": 1}', '{"text": "plain"}', "{}"}
    marks = [json.loads(f.read_text()) for f in (tmp_path / "log" / "_commits").glob("*.json")]
    assert marks == [{"batch": 0, "events": 3, "rejected": 1}]
    run("s2")  # batch 0 comes again: nothing changes
    assert len([x for f in (tmp_path / "log").glob("batch-*.jsonl") for x in f.read_text().splitlines()]) == 3
    assert not list((tmp_path / "log" / "_pending").iterdir())
    writer = datasources.TelemetryWriter(str(tmp_path / "log"))
    message = writer.write(iter(spark.createDataFrame([("e9", "phase_start", "2024")], "event_id string, event_type string, ts string").collect()))
    assert len(list((tmp_path / "log" / "_pending").iterdir())) == 1
    writer.abort([message, None], 7)
    assert not list((tmp_path / "log" / "_pending").iterdir())
