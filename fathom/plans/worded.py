"""What notes, tags, versions and task texts say: the column functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import scalars
from fathom.operators import calibration
from fathom.operators import tasks as engine

from .base import query, table
from .views import AS_OF_S, EVENTS, MEMORY, TASKS, events, memory, tasks

#: Openings of the notes, by doc_id modulo their number; the document's text follows.
OPENINGS = [
    "Gate 2 failed", "no branch given", "PR not merged", "project is fine", "branch: feat/x-1 see https://h.example/o/r/pull/1207", "commit 0a1b2c3d4e of fix/y_2, again 0a1b2c3d4e", "Missing learning",
    "## LEARNING: Use indexes\nWHY: faster\nCATEGORY: Query\nTAGS: db, Perf", "Certainly! Here is a brief overview of it: ", "Great question. Based on my research, ", "As an AI model I guess: sure. Well: ",
]


def _notes(spark, d):
    """Documents as notes; every 12th has none."""
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), (F.col("doc_id") % len(OPENINGS) + 1).cast("int"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 12 != 0, F.concat(opening, F.lit("\n"), "text")).alias("note"), "text", "lang", "n_chars")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NOTES = f"""notes AS (SELECT doc_id AS id, CASE WHEN doc_id % 12 <> 0 THEN ([{", ".join(map(_quoted, OPENINGS))}])[doc_id % {len(OPENINGS)} + 1] || chr(10) || text END AS note, text, lang, n_chars FROM documents)"""


@query(
    f"""WITH {_NOTES}, l AS (SELECT id, lower(note) AS n FROM notes)
SELECT id, CASE WHEN contains(n, 'branch_evidence') OR contains(n, 'gate 1') THEN 'BRANCH_EVIDENCE' WHEN contains(n, 'learning_block') OR contains(n, 'gate 2') THEN 'LEARNING_BLOCK'
  WHEN contains(n, 'test_evidence') OR contains(n, 'gate 3') THEN 'TEST_EVIDENCE' WHEN contains(n, 'pr_url') OR contains(n, 'gate 4') THEN 'PR_URL'
  WHEN contains(n, 'no branch') OR contains(n, 'branch evidence') OR contains(n, 'missing branch') THEN 'BRANCH_EVIDENCE' WHEN contains(n, 'no learning') OR contains(n, 'missing learning') THEN 'LEARNING_BLOCK'
  WHEN contains(n, 'no test') OR contains(n, 'test evidence') OR contains(n, 'test output') THEN 'TEST_EVIDENCE'
  WHEN contains(n, 'no pr') OR contains(n, 'pr url') OR contains(n, 'pull request') OR contains(n, 'not merged') THEN 'PR_URL' ELSE 'UNKNOWN' END AS gate FROM l"""
)
def failed_gates(spark, d):
    return _notes(spark, d).select("id", scalars.failed_gate("note").alias("gate"))


@query(
    rf"""WITH {_NOTES} SELECT id, nullif(regexp_extract(note, 'https?://[^\s)]+/pull/[0-9]+'), '') AS pr_url, CAST(nullif(regexp_extract(note, '/pull/([0-9]+)', 1), '') AS INTEGER) AS pr_number,
  coalesce(nullif(regexp_extract(note, '(?i)(?:branch:\s*|checkout -b\s+)([A-Za-z0-9._/-]+)', 1), ''), nullif(regexp_extract(note, '\b(?:feat|fix|chore|docs|refactor|test)/[A-Za-z0-9._-]+'), '')) AS branch,
  CAST(list_unique(regexp_extract_all(note, '\b[0-9a-f]{{7,40}}\b')) AS BIGINT) AS n_shas, list_contains(regexp_extract_all(note, '\b[0-9a-f]{{7,40}}\b'), '0a1b2c3d4e') AS has_sha FROM notes"""
)
def note_evidence(spark, d):
    note = F.col("note")
    shas = scalars.commit_shas(note)
    return _notes(spark, d).select("id", scalars.pr_url(note).alias("pr_url"), scalars.pr_number(note).alias("pr_number"), scalars.branch_name(note).alias("branch"), F.when(note.isNotNull(), F.size(shas)).cast("long").alias("n_shas"), F.array_contains(shas, "0a1b2c3d4e").alias("has_sha"))


_FIELD = r"nullif(trim(regexp_extract(block, '(?m)^\W*{0}\W*:\s*(.+)$', 1)), '')"


@query(
    rf"""WITH {_NOTES}, b AS (SELECT id, regexp_extract(note, '(?s)(?:^|\n)#*\s*LEARNING:?\s*(.*)', 1) AS block FROM notes)
SELECT id, coalesce({_FIELD.format("WHAT")}, nullif(trim(regexp_extract(block, '^([^\n]*)', 1)), '')) AS what, {_FIELD.format("WHY")} AS why, coalesce(lower({_FIELD.format("CATEGORY")}), 'pattern') AS category,
  array_to_string(list_filter(list_transform(string_split(coalesce({_FIELD.format("TAGS")}, ''), ','), lambda t: lower(trim(t))), lambda t: t <> ''), ',') AS tags FROM b WHERE trim(block) <> ''"""
)
def learning_blocks(spark, d):
    found = _notes(spark, d).select("id", scalars.learning_block(F.col("note")).alias("b")).where("b IS NOT NULL")
    return found.select("id", "b.what", "b.why", "b.category", F.array_join("b.tags", ",").alias("tags"))


@query(
    f"""WITH {_NOTES} SELECT id, md5(regexp_replace(regexp_replace(note, {_quoted(scalars.PREAMBLE)}, ''), '^\\s+|\\s+$', '', 'g')) AS digest,
  length(regexp_replace(regexp_replace(note, {_quoted(scalars.PREAMBLE)}, ''), '^\\s+|\\s+$', '', 'g')) AS n FROM notes"""
)
def preambles_stripped(spark, d):
    left = scalars.stripped_preamble(F.col("note"))
    return _notes(spark, d).select("id", F.md5(left.cast("binary")).alias("digest"), F.length(left).cast("long").alias("n"))


SCRUBS = [("token", r"(sk|ghp)[-_][A-Za-z0-9]{16,}", "[TOKEN]"), ("mail", r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]{2,}", "[MAIL]"), ("number", r"[0-9]{3}-[0-9]{3,4}-[0-9]{4}", "[NUMBER]")]


@query(
    f"""WITH a AS (SELECT doc_id, text AS t0, regexp_replace(text, '{SCRUBS[0][1]}', '{SCRUBS[0][2]}', 'g') AS t1 FROM documents), b AS (SELECT *, regexp_replace(t1, '{SCRUBS[1][1]}', '{SCRUBS[1][2]}', 'g') AS t2 FROM a)
SELECT doc_id, md5(regexp_replace(t2, '{SCRUBS[2][1]}', '{SCRUBS[2][2]}', 'g')) AS digest, concat_ws(',', CASE WHEN regexp_matches(t0, '{SCRUBS[0][1]}') THEN 'token' END, CASE WHEN regexp_matches(t1, '{SCRUBS[1][1]}') THEN 'mail' END,
  CASE WHEN regexp_matches(t2, '{SCRUBS[2][1]}') THEN 'number' END) AS names FROM b"""
)
def scrubbed_texts(spark, d):
    text, names = scalars.scrubbed("text", SCRUBS)
    return table(spark, d, "documents").select("doc_id", F.md5(text.cast("binary")).alias("digest"), F.array_join(names, ",").alias("names"))


HINTS = {"security": ["password", "token", "secret"], "web": ["http", "www"], "legal": ["license", "copyright"]}


@query(
    f"""SELECT doc_id, concat_ws(',', {", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{h}')" for h in some) + f" THEN '{tag}' END" for tag, some in HINTS.items())}) AS tags FROM documents"""
)
def domain_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(scalars.domain_tags(F.col("text"), HINTS), ",").alias("tags"))


@query(
    f"""WITH {MEMORY}, c AS (SELECT id, list_distinct(list_filter(list_transform(tags, lambda t: lower(trim(t))), lambda t: t <> '')) AS u, list_filter(list_transform(tags, lambda t: lower(trim(t))), lambda t: t <> '') AS l FROM memory),
r AS (SELECT id, list_transform(l, lambda t: CASE t WHEN 'pg' THEN 'postgresql' WHEN 'py' THEN 'python' WHEN 'en' THEN 'english' ELSE t END) AS l FROM c),
k AS (SELECT id, unnest(l) AS tag, unnest(range(len(l))) AS place FROM r), o AS (SELECT id, tag, min(place) AS place, CASE tag WHEN 'python' THEN 0 WHEN 'postgresql' THEN 1 ELSE 9 END AS tier FROM k WHERE tag <> 'misc' GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, place) AS rn FROM o)
SELECT m.id, coalesce(string_agg(tag, ',' ORDER BY rn), '') AS tags FROM memory m LEFT JOIN w ON w.id = m.id AND rn <= 3 GROUP BY 1"""
)
def tags_normalized(spark, d):
    tags = scalars.normalized_tags(F.col("tags"), {"pg": "postgresql", "py": "python", "en": "english"}, ["misc"], {"python": 0, "postgresql": 1}, 3)
    return memory(spark, d).select("id", F.array_join(tags, ",").alias("tags"))


@query(f"""WITH {MEMORY} SELECT id, left(nullif(trim(CASE WHEN id % 7 = 0 THEN '   ' ELSE '  ' || project_id || repeat('x', CAST(id % 200 AS INTEGER)) END), ''), 128) AS project FROM memory""")
def project_ids(spark, d):
    raw = F.when(F.col("id") % 7 == 0, "   ").otherwise(F.concat(F.lit("  "), "project_id", F.repeat(F.lit("x"), (F.col("id") % 200).cast("int"))))
    return memory(spark, d).select("id", scalars.project_id(raw).alias("project"))


@query(
    f"""WITH {TASKS} SELECT t.id, CASE WHEN who IN ('agent3', 'agent4') THEN 'non-code' WHEN who <> '' THEN 'code' WHEN regexp_matches(lower(title), 'research|report|analysis|spec|strategy|audit') THEN 'non-code' ELSE 'code' END AS lane,
  concat_ws(',', CASE WHEN trim(coalesce(description, '')) = '' THEN 'missing_description' END, CASE WHEN trim(coalesce(sprint, '')) = '' THEN 'missing_details' END, CASE WHEN trim(coalesce(project_id, '')) = '' THEN 'missing_test_strategy' END,
    CASE WHEN coalesce(len(dependencies), 0) < 1 THEN 'missing_success_criteria' END, 'missing_doc_refs') AS gaps
FROM (SELECT *, CASE WHEN id % 5 > 0 THEN lower(assigned_to) ELSE '' END AS who, type || CASE WHEN id % 2 = 0 THEN ' Audit' ELSE ' of it' END AS title, CASE WHEN id % 9 = 0 THEN ' ' ELSE priority END AS description FROM tasks) t"""
)
def task_lanes(spark, d):
    owner = F.when(F.col("id") % 5 > 0, F.concat(F.lit(" "), F.initcap("assigned_to")))
    title = F.concat("type", F.when(F.col("id") % 2 == 0, " Audit").otherwise(" of it"))
    gaps = scalars.hygiene_gaps(F.when(F.col("id") % 9 == 0, " ").otherwise(F.col("priority")), F.col("sprint"), F.col("project_id"), F.col("dependencies"), F.lit(None).cast("array<string>"))
    return tasks(spark, d).select("id", scalars.lane(owner, title, ["agent1"], ["agent3", "agent4"]).alias("lane"), F.array_join(gaps, ",").alias("gaps"))


@query(
    f"""WITH {EVENTS}, s AS (SELECT id, CASE WHEN k % 10 > 0 THEN ({AS_OF_S} - at_s) // (k * k + 1) END AS s FROM log)
SELECT id, CASE WHEN s IS NULL THEN '' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS age FROM s"""
)
def age_labels(spark, d):
    k = F.col("k").cast("long")
    seconds = F.when(k % 10 > 0, F.expr(f"({AS_OF_S} - at_s) DIV (CAST(k AS BIGINT) * k + 1)"))
    return events(spark, d).select("id", scalars.age_label(seconds).alias("age"))


@query(
    f"""WITH {EVENTS}, r AS (SELECT id, CASE id % 5 WHEN 0 THEN k || '.0' WHEN 1 THEN k || '.1' WHEN 2 THEN 'NaN' WHEN 3 THEN ' ' || k || ' ' ELSE 'x' || k END AS raw FROM log)
SELECT id, CASE WHEN id % 5 IN (0, 1, 3) THEN regexp_replace(CAST(CAST(trim(raw) AS DECIMAL(12,3)) AS VARCHAR), '\\.?0+$', '') END AS phase FROM r"""
)
def phase_labels(spark, d):
    k, n = F.col("k").cast("string"), F.col("id") % 5
    raw = F.when(n == 0, F.concat(k, F.lit(".0"))).when(n == 1, F.concat(k, F.lit(".1"))).when(n == 2, "NaN").when(n == 3, F.concat(F.lit(" "), k, F.lit(" "))).otherwise(F.concat(F.lit("x"), k))
    return events(spark, d).select("id", scalars.phase_label(raw).alias("phase"))


@query(
    f"""WITH {EVENTS}, m AS (SELECT id, json_merge_patch(CASE WHEN id % 3 > 0 THEN props END::JSON, ('{{"n":' || id || ',"tags":["a","b"]' || CASE WHEN id % 2 = 0 THEN ',"k":"' || event_type || '"' ELSE '' END || '}}')::JSON) AS j,
  CASE WHEN id % 3 > 0 THEN props END AS old, ('{{"n":' || id || ',"tags":["a","b"]' || CASE WHEN id % 2 = 0 THEN ',"k":"' || event_type || '"' ELSE '' END || '}}') AS patch FROM log)
SELECT id, '{{' || CASE WHEN coalesce(json_extract(patch, '$.k'), json_extract(old, '$.k')) IS NULL THEN '' ELSE '"k":' || coalesce(json_extract(patch, '$.k'), json_extract(old, '$.k')) || ',' END || '"n":' || id || ',"tags":["a","b"]}}' AS merged FROM m"""
)
def metadata_merged(spark, d):
    patch = F.concat(F.lit('{"n":'), F.col("id").cast("string"), F.lit(',"tags":["a","b"]'), F.when(F.col("id") % 2 == 0, F.concat(F.lit(',"k":"'), "event_type", F.lit('"'))).otherwise(""), F.lit("}"))
    return events(spark, d).select("id", scalars.json_merge(F.when(F.col("id") % 3 > 0, F.col("props")), patch).alias("merged"))


BUCKETS = [(20, "E"), (40, "P,E"), (70, "R,P,E,T"), (100, "R,P,E,T,D")]


@query(
    f"""WITH {TASKS}, p AS (SELECT id, least(urgency * 6, 20) / 20 * 20 + least(id % 700, 500) / 500 * 15 + least(importance * 3, 10) / 10 * 10 + least(id % 13, 10) / 10 * 15 + CASE WHEN id % 4 = 0 THEN 15 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 10 ELSE 0 END + least(id % 11, 10) / 10 * 15 AS total,
  CAST(id % 4 AS INTEGER) AS done, CASE WHEN status = 'failed' THEN 1 ELSE 0 END + CASE WHEN urgency = 5 THEN 1 ELSE 0 END AS fired FROM tasks), s AS (SELECT *, CAST(greatest(0, least(100, round_even(total, 0))) AS INTEGER) AS score FROM p)
SELECT id, score, CASE WHEN score <= 20 THEN 'E' WHEN score <= 40 THEN 'P,E' WHEN score <= 70 THEN 'R,P,E,T' ELSE 'R,P,E,T,D' END AS phases, CASE WHEN done >= 2 THEN score ELSE least(100, score + 20 * fired) END AS raised, fired, done >= 2 AND fired > 0 AS cap_hit FROM s"""
)
def complexity_phases(spark, d):
    n = F.col("id")
    score = scalars.complexity_score(F.col("urgency") * 6, n % 700, F.col("importance") * 3, n % 13, n % 4 == 0, n % 3 == 0, n % 11)
    rows = tasks(spark, d).withColumn("score", score)
    up = calibration.escalated(F.col("score"), [F.col("status") == "failed", F.col("urgency") == 5], n % 4)
    return rows.select("id", "score", calibration.phases(F.col("score"), BUCKETS).alias("phases"), up["score"].alias("raised"), up["fired"].alias("fired"), up["cap_hit"].alias("cap_hit"))


@query(
    f"""WITH {TASKS}, n AS (SELECT upper(type) AS prefix, id FROM tasks WHERE id % 10 > 0)
SELECT prefix, prefix || '-' || CASE WHEN max(id) + 1 < 10000 THEN lpad(CAST(max(id) + 1 AS VARCHAR), 4, '0') ELSE CAST(max(id) + 1 AS VARCHAR) END AS next_id FROM n GROUP BY 1"""
)
def next_ids(spark, d):
    """Names are TYPE-number; every tenth task has another form and doesn't count."""
    name = F.concat(F.upper("type"), F.when(F.col("id") % 10 > 0, "-").otherwise("_"), F.col("id").cast("string"))
    return engine.next_ids(tasks(spark, d).select(name.alias("name")))


_TEXTS = {"R": "looked at it", "P": "plan: do this, then that, and in the end the other thing as well", "E": "git checkout -b x", "T": "12 passed", "D": "LEARNING: "}


@query(
    f"""WITH {TASKS}, t AS (SELECT id, status, priority, CASE WHEN id % 7 > 0 THEN 'looked at it' END AS r, CASE WHEN id % 5 > 0 THEN 'plan: do this, then that, and in the end the other thing as well' ELSE '  ' END AS p,
  CASE WHEN id % 2 = 0 THEN 'git checkout -b x' ELSE 'nothing' END AS e, CASE WHEN id % 3 = 0 THEN '12 passed' ELSE 'tried' END AS t, 'LEARNING: ' || repeat('w', CAST(id % 200 AS INTEGER)) AS d, id % 4 > 0 AS code, id % 6 = 0 AS url FROM tasks),
g AS (SELECT *, CASE WHEN r IS NULL OR trim(p) = '' THEN 'FAIL' ELSE 'PASS' END AS g1, CASE WHEN r IS NULL THEN 'SKIP' ELSE 'FAIL' END AS g2, CASE WHEN trim(p) = '' THEN 'SKIP' ELSE 'PASS' END AS g3, CASE WHEN NOT code THEN 'SKIP' WHEN id % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS g4,
  CASE WHEN code AND id % 3 = 0 THEN 'PASS' ELSE 'FAIL' END AS g5, CASE WHEN id % 200 >= 100 THEN 'PASS' ELSE 'FAIL' END AS g6, CASE WHEN NOT code THEN 'SKIP' WHEN url THEN 'PASS' ELSE 'FAIL' END AS g7 FROM t)
SELECT id, 'RPETD_COMPLETE:' || g1 || ',R_PHASE_SUBSTANCE:' || g2 || ',P_PHASE_SUBSTANCE:' || g3 || ',BRANCH_EVIDENCE:' || g4 || ',TEST_EVIDENCE:' || g5 || ',LEARNING_BLOCK:' || g6 || ',PR_URL:' || g7 AS gates FROM g"""
)
def task_gates(spark, d):
    n = F.col("id")
    phases = {
        "R": F.when(n % 7 > 0, _TEXTS["R"]), "P": F.when(n % 5 > 0, _TEXTS["P"]).otherwise("  "), "E": F.when(n % 2 == 0, _TEXTS["E"]).otherwise("nothing"), "T": F.when(n % 3 == 0, _TEXTS["T"]).otherwise("tried"),
        "D": F.concat(F.lit(_TEXTS["D"]), F.repeat(F.lit("w"), (n % 200).cast("int"))),
    }
    found = engine.gates(phases, n % 4 > 0, F.when(n % 6 == 0, F.lit("https://h.example/o/r/pull/1")))
    return tasks(spark, d).select("id", F.array_join(F.transform(found, lambda g: F.concat_ws(":", g["gate"], g["status"])), ",").alias("gates"))


_ENDS = ["pending", "in_progress", "validation", "done", "failed", "deferred", "escalated"]
_FAILS = ["Timeout after 30 s", "needs a specialist: wrong agent", "it just broke", None]


@query(
    f"""WITH {TASKS}, m AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in engine.TRANSITIONS)}) v(a, b)),
t AS (SELECT id, status, (['{"','".join(_ENDS)}'])[id % 7 + 1] AS next, id % 5 AS failures, CASE id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'wrong agent' WHEN 2 THEN 'broke' END AS says, CASE id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'PASS' ELSE 'FAIL' END AS gate FROM tasks)
SELECT id, m.a IS NOT NULL AS allowed, CASE WHEN failures >= 3 THEN 'SYSTEMIC' WHEN gate = 'FAIL' THEN 'GATE_FAIL' WHEN says = 'wrong agent' THEN 'CAPABILITY_MISMATCH' WHEN says = 'timeout' THEN 'TRANSIENT' WHEN gate <> 'none' THEN 'GATE_FAIL' ELSE 'CAPABILITY_MISMATCH' END AS failure
FROM t LEFT JOIN m ON m.a = t.status AND m.b = t.next"""
)
def task_moves(spark, d):
    n = F.col("id")
    after = F.element_at(F.array(*map(F.lit, _ENDS)), (n % 7 + 1).cast("int"))
    notes = F.element_at(F.array(*map(F.lit, _FAILS)), (n % 4 + 1).cast("int"))
    states = F.when(n % 3 == 0, F.array().cast("array<string>")).when(n % 3 == 1, F.array(F.lit("PASS"), F.lit("SKIP"))).otherwise(F.array(F.lit("PASS"), F.lit("FAIL")))
    return tasks(spark, d).select("id", engine.allowed(F.col("status"), after).alias("allowed"), engine.failure_class(n % 5, states, notes).alias("failure"))
