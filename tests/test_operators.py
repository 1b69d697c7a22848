import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fathom import storage
from fathom.operators import alike, analytics, calibration, chunking, evaluate, graph, retrieval, similarity, store, tasks
from fathom.sources import io
from fathom.streaming import jobs


def test_bm25_label_only_match_counts(spark):
    chunks = spark.createDataFrame([(1, "alpha beta", "getUser"), (2, "alpha alpha user", ""), (3, "gamma", "")], "id int, text string, label string")
    asked = spark.createDataFrame([(0, "user")], "query_id int, query string")
    got = {r.id: r.score for r in retrieval.bm25(chunks, asked, label_col="label").collect()}
    assert set(got) == {1, 2} and got[1] > got[2] > 0


def test_bm25_saturates(spark):
    rows = [(1, "cat " * 2 + "dog"), (2, "cat " * 50 + "dog"), (3, "fish bird")]
    asked = spark.createDataFrame([(0, "cat")], "query_id int, query string")
    got = {r.id: r.score for r in retrieval.bm25(spark.createDataFrame(rows, "id int, text string"), asked).collect()}
    assert got[2] > got[1] and got[2] < 2 * got[1]


def test_rrf(spark):
    lex = spark.createDataFrame([(1, 9.0), (2, 8.0), (3, 8.0)], "id int, score double")
    vec = spark.createDataFrame([(2, 0.9), (4, 0.5)], "id int, score double")
    got = {r.id: r for r in retrieval.fused(lex, vec).collect()}
    assert got[2].rank_bm25 == got[3].rank_bm25 == 2
    assert got[1].rrf_score == pytest.approx(1 / 61 + 1 / 81)
    assert got[2].rrf_score == pytest.approx(1 / 62 + 1 / 61)
    alone = {r.id: r.rrf_score for r in retrieval.fused(lex, vec, missing_rank=False, ties=False).collect()}
    assert alone[1] == pytest.approx(1 / 61) and alone[3] == pytest.approx(1 / 63)


def test_composite_bounds(spark):
    df = spark.range(1).select(retrieval.composite(F.lit(1.0), F.lit("agent"), F.lit(10**9), F.lit(10**6), F.array(F.lit("best-practice"))).alias("x"))
    assert df.first().x == pytest.approx(1 + 4 + 3 - 3)


def test_memory_search_rungs(spark):
    now = datetime(2024, 1, 1)
    m = spark.createDataFrame([(1, "the red fox", "agent", 0, now), (2, "red red fox", "best-practice", 0, now), (3, "blue", None, None, None)], "id int, text string, source string, applied_count int, created_at timestamp")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, embedding array<double>")
    assert retrieval.memory_search(m, "fox", F.lit(now)).first().id == 2
    assert {r.id for r in retrieval.memory_search(m, "fox", F.lit(now), [1.0, 0.0], v).collect()} == {1, 2}
    assert [r.id for r in retrieval.memory_search(m, "lu", F.lit(now)).collect()] == [3]
    assert retrieval.memory_search(m.limit(0), "fox", F.lit(now)).count() == 0
    found = retrieval.memory_search(m, "fox", F.lit(now))
    assert retrieval.reranked(found, "the").first().id == 1 or retrieval.reranked(found, "the").count() == 2


def test_pagerank_matches_power_iteration(spark):
    import numpy as np

    edges = [(0, 1), (0, 2), (1, 2), (2, 0), (3, 2), (3, 4)]
    n, alpha = 5, 0.85
    m = np.zeros((n, n))
    for s, t in edges:
        m[t, s] = 1
    out = m.sum(axis=0)
    r = np.full(n, 1 / n)
    for _ in range(200):
        r = alpha * (m @ np.where(out > 0, r / np.maximum(out, 1), 0) + r[out == 0].sum() / n) + (1 - alpha) / n
    got = graph.pagerank(spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(edges, "src long, dst long"), tolerance=1e-5)
    assert [x.rank for x in got.orderBy("id").collect()] == pytest.approx(r.tolist(), abs=1e-4)


def shuffled_rows(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteRecords()
    return total


def test_pagerank_shuffles_edges_once(spark):
    """Hubs and others, nodes without edges out, and edges of unknown nodes; the edges are dealt out before the rounds only."""
    import numpy as np

    n = 420
    edges = [(s, t) for s in range(300) for t in range(200, 400)] + [(s, s + 1) for s in range(300, 399)] + [(0, 200), (400, 0), (0, 999), (998, 1)]
    m = np.zeros((1000, n))
    for s, t in edges:
        m[t, s if s < n else 0] = max(m[t, s if s < n else 0], s < n)
    out = m.sum(axis=0)
    r = np.full(n, 1 / n)
    for _ in range(6):
        r = 0.85 * ((m @ np.where(out > 0, r / np.maximum(out, 1), 0))[:n] + r[out == 0].sum() / n) + 0.15 / n
    before, limit = shuffled_rows(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = graph.pagerank(spark.range(n), spark.createDataFrame(edges, "src long, dst long"), rounds=6, tolerance=0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert [x["rank"] for x in got.orderBy("id").collect()] == pytest.approx(r.tolist(), rel=1e-9)
    assert shuffled_rows(spark) - before < 3 * len(edges)


def test_strong_components_shuffle_edges_few_times(spark):
    """Two groups of nodes with edges both ways, and nodes that only lead to one: the edges are not walked in rounds."""
    edges = [(s, t) for s in range(0, 150) for t in range(500, 550)] + [(s, t) for s in range(200, 350) for t in range(600, 650)]
    df = spark.createDataFrame([e for s, t in edges for e in ((s, t), (t, s))] + [(s, t) for s in range(400, 450) for t in range(500, 550)], "src long, dst long")
    before, limit = shuffled_rows(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.id: r.comp for r in graph.strong_components(df).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {v: v if 400 <= v < 450 else 549 if v < 150 or 500 <= v < 550 else 649 for e in edges for v in e} | {v: v for v in range(400, 450)}
    assert shuffled_rows(spark) - before < 3 * df.count()


def test_edges_states(spark):
    s = spark.createDataFrame([(1, "a.f"), (2, "b.f"), (3, "c.g")], "id long, symbol string")
    w = spark.createDataFrame([(1, "c.g"), (1, "g"), (1, "f"), (1, "zz"), (3, "c.g"), (2, "a.f")], "src long, name string")
    got = [(r.src, r.name, r.dst, r.state) for r in graph.resolved_edges(s, w).collect()]
    assert sorted(got, key=str) == sorted([(1, "c.g", 3, "edge"), (1, "g", 3, "edge"), (1, "f", None, "ambiguous"), (1, "zz", None, "unresolved"), (3, "c.g", 3, "self"), (2, "a.f", 1, "edge")], key=str)


def test_levels_and_cycles(spark):
    n = spark.createDataFrame([(i,) for i in "abcxy"], "id string")
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "src string, dst string")
    assert {r.id: r.level for r in graph.levels(n, e).collect()} == {"a": 0, "b": 1, "c": 2}


def test_version_conflicts(spark):
    r = spark.createDataFrame([("d", "^1.2.0"), ("d", "~1.9.0"), ("d", "^2.0.0"), ("e", ">=1.0.0"), ("e", "^9.0.0")], "dep string, spec string")
    assert {(x.a, x.b) for x in graph.conflicts(r).collect()} == {("^1.2.0", "^2.0.0"), ("^2.0.0", "~1.9.0")}


def test_mcnemar_degrades(spark):
    base = spark.createDataFrame([(str(i), True) for i in range(100)], "key string, passed boolean")
    now = spark.createDataFrame([(str(i), i >= 12) for i in range(100)], "key string, passed boolean")
    got = evaluate.mcnemar(base, now).first()
    assert (got.b, got.c, got.degraded) == (12, 0, True) and got.chi_squared == pytest.approx(121 / 12)
    assert not evaluate.mcnemar(base, base).first().degraded


def test_greedy_leaders(spark):
    ids = spark.range(6)
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "a long, b long")
    got = {r.id: r.leader for r in similarity.greedy_leaders(ids, pairs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_similar_pairs_brute_first(spark):
    import itertools
    import random

    random.seed(3)
    sets = {i: sorted(set(random.choices("abcdefghij", k=random.randint(1, 8)))) for i in range(60)}
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.7}
    got = similarity.similar_pairs(spark.createDataFrame(list(sets.items()), "id long, tokens array<string>"), 0.7)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_task_rules_first(spark):
    t = spark.createDataFrame([(1, "pending", "critical", 5, 1, "a", [2, 99], 0, None), (2, "in_progress", "low", 1, 1, "a", [], 0, None), (3, "failed", "low", 3, 3, "a", [], 0, 1000), (4, "pending", "low", None, None, "b", [1, 1], 0, None)], "id long, status string, priority string, importance int, urgency int, assigned_to string, dependencies array<long>, created_s long, due_s long")
    scores = {r.id: r.score for r in tasks.scored(t, 1000).collect()}
    assert scores == {1: 2.0 + 0.3 + 0.6, 2: 0.4 + 0.3 + 0.3, 3: 1.2 + 1.5, 4: 1.2 + 0.9}
    assert {r.assigned_to: (r.id, r.kind) for r in tasks.next_tasks(t, 1000).collect()} == {"a": (3, "retry")}
    assert {r.id: r.deps_met for r in tasks.with_deps_met(t).collect()} == {1: False, 2: True, 3: True, 4: False}


def test_next_ids(spark):
    t = spark.createDataFrame([("TASK-0009",), ("TASK-12000",), ("BUG-1",), ("junk",), (None,)], "name string")
    assert {r.prefix: r.next_id for r in tasks.next_ids(t).collect()} == {"TASK": "TASK-12001", "BUG": "BUG-0002"}


def test_filter_nulls(spark):
    m = spark.createDataFrame([(1, None, "agent"), (2, "__test__", "agent"), (3, "p", None), (4, "p", "task_event")], "id int, project_id string, source string")
    assert [r.id for r in store.memory_filter(m).collect()] == [1]
    assert store.memory_filter(m.limit(0)).count() == 0


def test_merge_and_plan(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, text string")
    b = spark.createDataFrame([(2, "z", 0), (3, "x", 0), (None, "n", 0)], "id int, text string, more int")
    assert sorted(store.merged(a, b, "id").collect()) == [(1, "x"), (2, "y"), (3, "x")]
    assert sorted(store.merged(a, b, "id", replace=True).collect()) == [(2, "z"), (3, "x")]
    assert {r.id: r.action for r in store.migration_plan(b.where("id IS NOT NULL"), a, "id", ["text"]).collect()} == {2: "conflict", 3: "content_duplicate"}


def test_stale_files(spark):
    now = spark.createDataFrame([("a", 1.0, 5, "h"), ("b", 2.0, 5, "h"), ("c", 9.0, 5, "new"), ("d", 9.0, 5, "same")], "path string, mtime double, size long, sha256 string")
    old = spark.createDataFrame([("a", 1.0, 5, "?"), ("c", 1.0, 5, "old"), ("d", 1.0, 5, "same"), ("e", 1.0, 5, "x")], "path string, mtime double, size long, sha256 string")
    assert {r.path: r.state for r in store.stale_files(now, old).collect()} == {"a": "same", "b": "new", "c": "changed", "d": "same", "e": "vanished"}


def test_chunkers(spark):
    files = spark.createDataFrame([("x.md", "intro\n# One\ntext\n\nmore\n## Two ##\nend"), ("e.md", "")], "path string, text string")
    assert [(r.label, r.start_line, r.end_line) for r in chunking.sections(files).orderBy("start_line").collect()] == [("preamble", 1, 1), ("One", 2, 5), ("Two", 6, 7)]
    assert [(r.start_line, r.text) for r in chunking.paragraphs(files).orderBy("start_line").collect()] == [(1, "intro\n# One\ntext"), (5, "more\n## Two ##\nend")]
    sql = spark.createDataFrame([("a.sql", "CREATE TABLE foo (x int);\nINSERT INTO bar VALUES (1);\n")], "path string, text string")
    assert [r.label for r in chunking.statements(sql).collect()] == ["foo", "bar"]
    code = spark.createDataFrame([("m.py", "def f():\n    return g(1)\n\nclass C:\n    def m(self):\n        pass\n"), ("bad.py", "def (")], "path string, text string")
    got = {(r.path, r.label): r for r in chunking.python_symbols(code).collect()}
    assert set(got) == {("m.py", "f"), ("m.py", "C"), ("m.py", "C.m"), ("bad.py", "file")}
    assert got["m.py", "f"].dependencies == ["g"]
    assert chunking.described(chunking.python_symbols(code).where("label = 'f'")).first().description == "f|type:function|deps:g|touches:m"
    big = spark.createDataFrame([("p", "l", 10, 12, "aaaa\nbbbb\ncccc")], chunking.CHUNK)
    assert [(r.label, r.start_line, r.text) for r in chunking.split_oversized(big, 9).orderBy("start_line").collect()] == [("l (part 1)", 10, "aaaa\nbbbb"), ("l (part 2)", 12, "cccc")]


def test_sources(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"items": [{"id": 1, "name": "a"}, {"id": 2}]}')
    assert io.read_task_document(spark, str(tmp_path / "t.json"), "struct<id:int,name:string>").count() == 2
    (tmp_path / "bad.json").write_text("{not json")
    assert io.read_task_document(spark, str(tmp_path / "bad.json"), "struct<id:int,name:string>").count() == 0
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.jsonl").write_text('{"id": 1}\nnope\n{"id": 3}\n')
    good, broken = io.read_log(spark, str(tmp_path / "log"), "id int")
    assert (good.count(), broken.count()) == (2, 1)
    io.export(spark.sql("SELECT 1 AS a, array(1, 2) AS b"), str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().b == "[1,2]"
    for name in ("src/a.py", "src/.git/b.py", "node_modules/c.py", "src/d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in io.corpus_files(spark, str(tmp_path), ["py", "md"]).collect()] == ["a.py"]
    (tmp_path / "n.md").write_text("alpha beta\nalpha\nnone\n")
    assert [(r.line, r.score) for r in io.keyword_lines(spark, str(tmp_path), ["Alpha", "beta"]).collect()] == [("alpha beta", 2), ("alpha", 1)]
    where = io.write_version(spark.range(2), str(tmp_path / "v"), 1)
    assert spark.read.json(where).count() == 2
    assert {r.table: r.rows for r in io.census(spark, {"x": spark.range(3), "y": spark.range(0)}).collect()} == {"x": 3, "y": 0}
    assert io.first_enough([spark.range(2), spark.range(5)], 2).count() == 2
    assert io.first_enough([spark.range(1), spark.range(5)], 2).count() == 6


def test_streams(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=10 * i), "k", "view", 1.0) for i in range(12)]
    events = spark.createDataFrame(rows, jobs.ENVELOPE)
    want = {i: True for i in range(12)} | {3: False, 4: False, 5: False, 9: False, 10: False, 11: False}
    assert {r.event_id: r.allowed for r in jobs.limited_batch(events, most=3, seconds=60).collect()} == want
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = []
    jobs.run_available(jobs.tumbling_counts(stream, "1 minute"), lambda df, _: got.extend(df.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert all(r.event_type == "view" for r in got)
    assert sorted(r.n for r in jobs.tumbling_counts(events, "1 minute").collect()) == [6, 6]
    assert jobs.sessions(events).first().n == 12
    assert [r.event_id for r in jobs.last_n(events, 2).collect()] == [11, 10]
    claims = spark.createDataFrame([(1, "in_progress", start), (2, "in_progress", start + timedelta(days=9))], "id int, status string, claimed_at timestamp")
    assert [r.id for r in jobs.stale_claims(claims, start + timedelta(days=9)).collect()] == [1]


def test_reports(spark):
    log = spark.createDataFrame([("ok 1",), ("FAILED test_x",), ("== 3 passed, 1 failed ==",)], "value string")
    got = analytics.log_summary(log, "^FAILED", "passed|failed ==").first()
    assert (got.lines, got.failures, got.summary) == (3, 1, "== 3 passed, 1 failed ==")
    stat = spark.createDataFrame([("3\t1\tsrc/a.py",), ("-\t-\tsrc/b.bin",), ("1\t0\tREADME",)], "value string")
    assert [tuple(r) for r in analytics.change_summary(stat).collect()] == [("src", 2, 3, 1), (".", 1, 1, 0)]


def test_calibration(spark):
    rows = [("g", float(i), 1.0 if i > 4 else 0.0) for i in range(10)]
    got = calibration.calibrated(spark.createDataFrame(rows, "grp string, x double, failed double"), "grp", ["x"], "failed").first()
    assert got.n == 10 and got.adjustment in (-5, 10)
    out = spark.range(1).select(calibration.escalated(F.lit(70), [F.lit(True), F.lit(True), F.lit(False)], F.lit(0)).alias("e"), calibration.phases(F.lit(40), [(20, "E"), (60, "PET"), (100, "RPETD")]).alias("p")).first()
    assert (out.e.score, out.e.fired, out.p) == (100, 2, "PET")


def test_neighbours_of_hubs(spark):
    got = {r.id: r for r in graph.neighbours(spark.range(1, 71).selectExpr("id AS src", "0L AS dst").unionByName(spark.range(1, 71).selectExpr("100L AS src", "id AS dst"))).collect()}
    assert got[0].dependents == list(range(1, 51)) and got[100].dependencies == list(range(1, 71))


def test_pagerank_covers_lineitem(spark):
    from fathom.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    pairs = {(f"p{r.l_partkey}", f"s{r.l_suppkey}") for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()}
    edges = pairs | {(s, p) for p, s in pairs if int(p[1:]) % 3 == 0}
    ids = {x for e in edges for x in e}
    out = {i: [b for a, b in edges if a == i] for i in ids}
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(100):
        lost = sum(rank[i] for i in ids if not out[i])
        new = dict.fromkeys(ids, (0.15 + 0.85 * lost) / len(ids))
        for i in ids:
            for j in out[i]:
                new[j] += 0.85 * rank[i] / len(out[i])
        rank = new
    got = {r.id: r["rank"] for r in QUERIES["pagerank"](spark, sf).collect()}
    assert got.keys() == ids and all(abs(got[i] - rank[i]) < 2e-4 for i in ids)


def test_task_rules(spark):
    rows = [(1, "pending", "in_progress", 0, ["PASS"], "x"), (2, "done", "failed", 3, [], "timeout"), (3, None, "done", None, ["FAIL"], None), (4, "failed", "pending", 1, [], "Connection refused"), (5, "validation", "done", 0, [], "wrong agent"), (6, "deferred", "done", 0, ["PASS"], "")]
    df = spark.createDataFrame(rows, "id int, a string, b string, failures int, states array<string>, notes string")
    got = {r.id: (r.ok, r.kind) for r in df.select("id", tasks.allowed(F.col("a"), F.col("b")).alias("ok"), tasks.failure_class(F.col("failures"), F.col("states"), F.col("notes")).alias("kind")).collect()}
    assert got == {1: (True, "GATE_FAIL"), 2: (False, "SYSTEMIC"), 3: (False, "GATE_FAIL"), 4: (True, "TRANSIENT"), 5: (True, "CAPABILITY_MISMATCH"), 6: (False, "GATE_FAIL")}


def test_gates(spark):
    long = "why this is so, and what it means for all that follows: "
    whole = {"R": long, "P": long, "E": "git checkout -b feat/x", "T": "12 tests passed", "D": "LEARNING: " + long * 3}
    names = ["RPETD_COMPLETE", "R_PHASE_SUBSTANCE", "P_PHASE_SUBSTANCE", "BRANCH_EVIDENCE", "TEST_EVIDENCE", "LEARNING_BLOCK", "PR_URL"]

    def of(phases, code, url):
        column = tasks.gates({p: F.lit(phases.get(p)).cast("string") for p in "RPETD"}, F.lit(code), F.lit(url).cast("string"))
        found = spark.range(1).select(column.alias("g")).first().g
        assert [x.gate for x in found] == names
        return [x.status for x in found]

    assert of(whole, True, "https://h/pull/1") == ["PASS"] * 7
    assert of(whole | {"R": "short", "T": "looks good", "D": "LEARNING: little"}, True, None) == ["PASS", "FAIL", "PASS", "PASS", "FAIL", "FAIL", "FAIL"]
    assert of({}, False, None) == ["FAIL", "SKIP", "SKIP", "SKIP", "FAIL", "FAIL", "SKIP"]


def test_ranks_without_convergence(spark):
    from fathom.operators import graph

    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "b")], "src string, dst string")
    n = e.select(F.col("src").alias("id")).distinct()
    with pytest.raises(RuntimeError, match="still change"):
        graph.pagerank(n, e, rounds=2)
    assert abs(graph.pagerank(n, e).agg(F.sum("rank")).first()[0] - 1) < 1e-9


def test_similar_pairs_brute(spark):
    import random

    from fathom.operators import similarity

    random.seed(4)
    rows = [(i, random.sample("abcdefghij", random.randint(0, 7))) for i in range(60)]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x + y and len({*x} & {*y}) >= 0.6 * len({*x, *y})}
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    pairs = similarity.similar_pairs(df, 0.6)
    assert {(r.a, r.b) for r in pairs.collect()} == want and pairs.count() == len(want)
    leaders: dict = {}
    for i, _ in rows:
        leaders[i] = min((a for a, b in want if b == i and leaders[a] == a), default=i)
    assert {r.id: r.leader for r in similarity.greedy_leaders(df.select("id"), pairs).collect()} == leaders


def test_reports_round_ties_as_their_sql(spark):
    values = [5.54, 13.89, 17.59, 8.73, 10.92, 27.63]  # their mean is 14.05; summed up as doubles 14.049999999999999
    log = spark.createDataFrame([("a", "pass" if i < 201 else "fail", values[i] if i < len(values) else None, 1) for i in range(400)], "agent_id string, outcome string, value double, k int").coalesce(1)
    got = analytics.agent_summary(log).first()
    assert got.avg_minutes == 14.1 and got.pass_rate == 0.502  # 0.5025 * 1000 is less than 502.5 as a double
    assert analytics.agent_metrics(log).first().pass_rate == 0.502
    odd = spark.createDataFrame([("a", "pass", x, 1) for x in (float("inf"), 1.0)] + [("b", "pass", None, 1), ("c", "pass", 0.5, 1), ("c", "pass", 2.5, 1)], "agent_id string, outcome string, value double, k int")
    assert {r.agent_id: r.avg_minutes for r in analytics.agent_summary(odd).collect()} == {"a": float("inf"), "b": None, "c": 1.5}


def test_leaders_and_novel_rows_of_copies(spark, monkeypatch):
    """Copies follow their class's first row, and are never expanded into pairs."""
    draw = random.Random(4)
    base = [frozenset(draw.sample("abcdefghijklmnopqrst", draw.randrange(1, 14))) for _ in range(25)]
    sets = [draw.choice(base) ^ frozenset(draw.choice("abcdefghijklmnopqrst") for _ in range(draw.randrange(2))) for _ in range(300)] + [frozenset()] * 3
    near = lambda x, y: bool(x and y) and len(x & y) >= 0.7 * len(x | y)
    want, heads = {}, []
    for i, x in enumerate(sets):
        want[i] = next((j for j in heads if near(sets[j], x)), i)
        if want[i] == i:
            heads.append(i)
    df = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "id long, tokens array<string>")
    pairs = {(i, j) for j in range(len(sets)) for i in range(j) if near(sets[i], sets[j])}
    assert {(r.a, r.b) for r in similarity.similar_pairs(df, 0.7).collect()} == pairs
    monkeypatch.setattr(similarity, "similar_pairs", None)
    assert {r.id: r.leader for r in similarity.leaders(df.select("id"), df, 0.7).collect()} == want
    new = {i for i in range(0, len(sets), 3) if not any(near(sets[i], sets[j]) for j in range(len(sets)) if j % 3)}
    assert {r.id for r in similarity.novel(df.where("id % 3 = 0"), df.where("id % 3 > 0"), 0.7).collect()} == new


@pytest.mark.parametrize("less", [False, True])
def test_what_is_shuffled_for_similar_sets(spark, monkeypatch, less):
    """Blocks of sketches, hot tokens, parts and groups of any size give the same pairs; a set is sent to a part once, not once for each of its pairs."""
    if less:
        for name, value in {"REPS": 40, "ROWS": 50, "SETS": 7, "HOT": 5, "PAIRS": 11, "LARGE": 6, "GROUP": 9, "MOST": 30}.items():
            monkeypatch.setattr(alike, name, value)
    draw = random.Random(8)
    words = [draw.randrange(-(2**63), 2**63) for _ in range(400)]
    sets = [sorted(draw.sample(words[: draw.choice([12, 400])], draw.randrange(1, 12))) for _ in range(60)]
    first = sorted(draw.sample(words, 200))
    sets += [sorted({*first} - {*draw.sample(first, draw.randrange(40))}) for _ in range(60)]  # all pairs of these meet
    sets = [list(x) for x in dict.fromkeys(map(tuple, sets))]
    want = {(i, j): len({*x} & {*y}) / len({*x, *y}) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if len({*x} & {*y}) >= 0.7 * len({*x, *y})}
    df = storage.stored(spark.createDataFrame(list(enumerate(sets)), "id long, t array<long>"), "sets")
    sent = []
    monkeypatch.setattr(alike, "small", lambda frame: sent.append(frame) or storage.small(frame))
    got = alike.alike(df, 0.7)
    assert {(r.a, r.b): r.similarity for r in got.collect()} == want and got.count() == len(want) > 1000
    if not less:
        assert sent[-1].count() <= len(sets)
    assert alike.alike(df.limit(0), 0.7).count() == 0
