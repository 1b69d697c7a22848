"""Modules, blocks of queries, repeated titles and triggers."""

import difflib

import pytest
from pyspark.sql import functions as F

from fathom.operators import chunking, evaluate, modules, plans_on_disk, store, tasks
from fathom.streaming import jobs


def test_blocks_of_queries(spark):
    rows = spark.range(60).select("id", ((F.col("id") * 37) % 101).cast("double").alias("x"))
    asked = rows.select(F.col("id").alias("query_id"), F.col("x").alias("q"))
    near = lambda block: sorted(map(tuple, evaluate.nearest_per_query(asked, rows, -F.abs(F.col("x") - F.col("q")), 3, block=block).collect()))
    assert near(7) == near(1000)
    assert len(near(7)) == 180
    assert not evaluate.nearest_per_query(asked.limit(0), rows, F.col("q"), 3).count()


def test_repeated_titles(spark):
    titles = ["Fix the login page", "fix login page now", "Write docs for search", "docs search writing", "", None, "the a an", "Index rebuild nightly", "Nightly rebuild index", "x" * 300, "x" * 290 + "y" * 10]
    rows = [(i, ["a", "B", None][i % 3], ["pending", "done", "in_progress", "pending"][i % 4], t) for i, t in enumerate(titles * 4)]
    all_ = spark.createDataFrame(rows, "id int, agent string, status string, title string")
    got = {r.query_id: r.duplicate_of for r in tasks.repeated_titles(all_.select(F.col("id").alias("query_id"), "agent", "title"), all_, block=10).collect()}

    def words(t):
        return {w for w in t.split() if len(w) > 2 and w not in tasks.STOP_WORDS}

    def duplicate(i, agent, title):
        title = (title or "").lower().strip()
        for j, other, status, t in rows:
            if j == i or status not in ("pending", "in_progress") or (agent and (other or "").lower() != agent.lower()):
                continue
            t = (t or "").lower().strip()
            a, b = words(title), words(t)
            if difflib.SequenceMatcher(None, title, t).ratio() >= 0.7 or (a and b and len(a & b) / max(len(a), len(b)) >= 0.6):
                return j
        return None

    assert got == {i: duplicate(i, agent, t) for i, agent, _, t in rows}
    assert sum(v is not None for v in got.values()) > 5


def test_repeated_titles_of_copies(spark, monkeypatch):
    """Equal titles of an agent are compared once, not each of 2,000 writes with each of 2,000 tasks."""
    seen = []
    blocks = tasks.in_blocks
    monkeypatch.setattr(tasks, "in_blocks", lambda queries, work, most: seen.append(queries.count()) or blocks(queries, lambda q: seen.append(work(q).count()) or work(q), most))
    df = spark.range(2000).select("id", F.lit("a").alias("agent"), F.lit("pending").alias("status"), F.concat(F.lit("rebuild index number "), F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("id") % 4 + 1).cast("int"))).alias("title"))
    out = tasks.repeated_titles(df.select(F.col("id").alias("query_id"), "agent", "title"), df)
    assert {r.query_id: r.duplicate_of for r in out.collect()} == {i: 0 if i else 1 for i in range(2000)}
    assert seen == [4, 4]


def test_install_order(spark):
    m = spark.createDataFrame([("a", "1.0.0", 1), ("b", "1.2.0", 2), ("c", "0.0.7", 3)], "name string, version string, at int")
    r = "name string, dep string, spec string"
    ok = spark.createDataFrame([("a", "b", "^1.1.0"), ("b", "c", "^0.0.3"), ("a", "c", "~0.0.1")], r)
    assert {x.name: x.level for x in modules.install_order(m, ok).collect()} == {"c": 0, "b": 1, "a": 2}
    bad = spark.createDataFrame([("a", "z", "1.0.0"), ("a", "b", "2.0.0"), ("c", "b", "^1.0.0"), ("b", "c", "any"), ("a", "c", "any"), (None, "c", "1.0.0")], r)
    problems = sorted((x.kind, x.dep, x.range_a or "", x.range_b or "") for x in modules.module_problems(m, bad).collect())
    assert problems == [("conflict", "b", "2.0.0", "^1.0.0"), ("conflict", "c", "any", "any"), ("missing", "z", "", ""), ("unmet", "b", "2.0.0", "=1.2.0"), ("unmet", "c", "any", "=0.0.7")]
    with pytest.raises(ValueError, match="not installable"):
        modules.install_order(m, bad)
    circle = spark.createDataFrame([("a", "b", "1.2.0"), ("b", "a", "1.0.0")], r)
    with pytest.raises(ValueError, match="circle"):
        modules.install_order(m, circle)
    assert not modules.install_order(m.limit(0), ok.limit(0)).count()


def test_guards(spark):
    t = spark.createDataFrame([(1, "old", "new")], "id int, live string, following string")
    assert modules.swapped(t, "live", "following", 0.8, 0.79, 0.02).first().live == "new"
    with pytest.raises(ValueError, match="refused"):
        modules.swapped(t, "live", "following", 0.8, 0.7, 0.02)
    rows = spark.createDataFrame([(1, None, None, "abcd"), (2, [1.0], "m", "abcd"), (3, [1.0], "n", "abcd")], "id int, vector array<double>, model string, text string")
    assert sorted(r.id for r in store.backfill_pending(rows, "m", F.length("text"), 8).collect()) == [1, 3]
    for budget in (None, 7):
        with pytest.raises(ValueError, match="budget"):
            store.backfill_pending(rows, "m", F.length("text"), budget)


def test_features_of_nothing(spark):
    rows = spark.createDataFrame([(None,), ([],), ([None, "tests/a"],)], "files array<string>").select(tasks.file_features(F.col("files")).alias("f")).select("f.*")
    assert [tuple(r) for r in rows.collect()] == [(0, 0, 0, False, False, 0, 0)] * 2 + [(1, 1, 0, False, False, 0, 1)]


def test_trigger():
    now, done = [0.0], []
    each = jobs.when_over(lambda: 500, done.append, threshold=500, cooldown=300, clock=lambda: now[0])
    each("first", 0)
    now[0] = 299
    each("second", 1)
    now[0] = 300
    each("third", 2)
    jobs.when_over(lambda: 499, done.append)("none", 3)
    assert done == ["first", "third"]


def test_script_chunks_and_dispatch(spark):
    code = "import x\n\nexport async function load(a) {\n  return a\n}\nclass Box {\n  m() {}\n}\nconst f = (a) => a\nconst n = 3\n"
    files = spark.createDataFrame([("a/x.ts", code), ("m.py", "def g():\n    pass\n"), ("q.sql", "\nSELECT 1;\nDELETE FROM t\nWHERE a = 1;\n"), ("r.MD", "# T\nx"), ("n", "a\n\nb"), ("e.md", ""), ("z.py", None)], "path string, text string")
    got = {(r.path, r.label): (r.start_line, r.end_line) for r in chunking.chunked(files).collect()}
    assert got == {
        ("a/x.ts", "preamble"): (1, 2), ("a/x.ts", "load"): (3, 5), ("a/x.ts", "Box"): (6, 8), ("a/x.ts", "f"): (9, 11), ("m.py", "g"): (1, 2),
        ("q.sql", "statement 1"): (2, 2), ("q.sql", "t"): (3, 4), ("r.MD", "T"): (1, 2), ("n", "paragraph 1"): (1, 1), ("n", "paragraph 3"): (3, 3),
    }


def test_roadmaps(spark):
    text = "# Map v1.2\n- [x] **Phase 1: A**\n- [ ] Phase 04\n### Phase 1: A\n**Goal:** g\n## Phase 2A: B (inserted)\n"
    maps = spark.createDataFrame([("r", text), ("null", None), ("empty", "")], "path string, text string")
    phases = plans_on_disk.roadmap_phases(maps)
    assert [tuple(r) for r in phases.orderBy("at").collect()] == [("r", 0, "1", "A", "g", None, True), ("r", 1, "2A", "B", None, None, False)]
    folders = plans_on_disk.phase_folders(spark.createDataFrame([("r", "02A-b", "02A-RESEARCH.md"), ("r", "notes", "x.md"), ("r", "3", "PLAN.md")], "path string, folder string, file string"))
    assert [(r.number, r.state) for r in plans_on_disk.phase_states(phases, folders).orderBy("at").collect()] == [("1", "complete"), ("2A", "researched")]
    got = {(r.number, r.rule) for r in plans_on_disk.drift(phases, plans_on_disk.ticks(maps), folders).collect()}
    assert got == {("4", "box_without_heading"), ("1", "phase_without_folder"), ("3", "folder_without_phase")}


def test_grammar_stripped(spark):
    text = "---\ntitle: The very \"x\" of it\nname: 'an actual the end'\nlist: [the, a]\n\n---\nThe plan, you may want to consider a `the  code` at https://h/the/a and /the/a  now.\n<the>\n```py\nthe code\n```\nit is possible that thé Panda is quite   real\n---\nthe end"
    files = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "```\n---\nthe x\n```\nthe y\n---\nk: the z")], "path int, text string")
    got = {r.path: r.text for r in chunking.grammar_stripped(files).collect()}
    assert got[1] == "---\ntitle: \"x\" of it\nname: 'actual end'\nlist: [the, a]\n\n---\nplan, you `the  code` at https://h/the/a and /the/a now.\n<the>\n```py\nthe code\n```\nthé Panda is real\n---\nend"
    assert (got[2], got[3], got[4]) == (None, "", "```\n---\nthe x\n```\ny\n---\nk: z")


def test_distilled_edges(spark):
    from fathom.operators import similarity

    same = "one two three four five six seven eight nine ten"
    rows = [(1, same, "a", 2, False, [(7, 5)]), (2, same + " more", None, 1, None, [(7, 1), (8, 2), (None, 3)]), (3, same, "distilled", 9, False, []), (4, same, "b", 9, True, []), (5, "else", "a", 0, False, []), (6, None, "a", 0, False, None), (7, "other words here", "a", 0, False, [])]
    schema = "id long, text string, source string, applied_count int, structured boolean, citations array<struct<task_id:bigint,at:bigint>>"
    out = similarity.distilled(spark.createDataFrame(rows, schema)).collect()
    assert [(r.leader, r.n, r.ids, r.applied_count, r.sources, [tuple(c) for c in r.citations], r.kept, r.text) for r in out] == [(1, 2, [1, 2], 3, ["a"], [(1, 7), (2, 8)], 2, f"{same} more\n---\n[merged from a]: {same}")]
    assert similarity.distilled(spark.createDataFrame(rows[:4], schema)).count() == 0  # two entries that count


def test_write_log_of_copies(spark, monkeypatch):
    """Copies are not expanded into pairs, and a copy may follow a row that was added after its own first row was skipped."""
    import random

    from fathom.operators import similarity, store

    most = []

    def counted(df, tag, codec=None, keep=store.stored):
        out = keep(df, tag, codec)
        most.append(out.count())
        return out

    monkeypatch.setattr(store, "stored", counted)
    monkeypatch.setattr(similarity, "stored", counted)
    draw = random.Random(3)
    texts = ["alpha beta gamma", "alpha beta gamm", "alpha beta", "beta gamma", "gamma beta alpha delta", "delta", "", None]
    rows = [(i, draw.choice(["p", "q", None]), draw.choice(texts)) for i in range(600)]

    def grams(project, t):
        return {(project or "", f"  {w} "[i : i + 3]) for w in (t or "").split() for i in range(len(w) + 1)}

    kept, want = [], {}
    for i, project, t in rows:
        mine = grams(project, t)
        near = [(-len(mine & g) / len(mine | g), j) for j, g in kept if mine & g and len(mine & g) >= 0.6 * len(mine | g)]
        if near:
            minus, other = min(near)
            want[i] = ("SKIP", other, round(-minus, 4))
        else:
            kept.append((i, mine))
            want[i] = ("ADD", None, None)
    got = {r.id: (r.op, r.other_id, r.similarity) for r in store.write_log(spark.createDataFrame(rows, "id long, project string, text string")).collect()}
    assert got == want
    assert max(most) <= len(rows)


def test_grammar_stripped_stays_in_its_row(spark):
    """Fences and front matter against a walk through the lines; nothing is shuffled."""
    import random

    draw = random.Random(5)
    texts = ["\n".join(draw.choices(["```", " ``` ", "---", "--- ", "the x", "k: the y", "<the>", ""], k=draw.randrange(14))) for _ in range(400)]

    def walked(text):
        lines, parity, first = text.split("\n"), 0, None
        for i, x in enumerate(lines):
            if x.strip().startswith("```"):
                parity ^= 1
            elif x.strip() == "---" and not parity and first is None:
                first = i
        last = next((i for i, x in enumerate(lines) if first is not None and i > first and x.strip() == "---"), len(lines))
        out, coded = [], False
        for i, x in enumerate(lines):
            if first is not None and i in (first, last):
                out.append(x)
            elif first is not None and first < i < last:
                out.append("k: y" if x == "k: the y" else x)
            elif x.strip().startswith("```"):
                coded = not coded
                out.append(x)
            else:
                out.append(x if coded or x == "<the>" else x.replace("the ", "").strip())
        return "\n".join(out)

    files = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    got = chunking.grammar_stripped(files)
    assert {r.path: r.text for r in got.collect()} == {i: walked(t) for i, t in enumerate(texts)}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
