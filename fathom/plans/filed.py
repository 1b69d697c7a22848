"""Files and their chunks, findings in them, logs and listings, and roadmaps."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from fathom.functions import text as words
from fathom.operators import analytics, chunking, plans_on_disk, store
from fathom.streaming import jobs

from .base import query, table
from .views import AS_OF_S, EVENTS, TASKS, events, tasks

MOST = 300
KINDS = ["md", "sql", "txt", "rst"]


def _files(spark, d):
    """Documents as files: every fourth is Markdown, every fourth SQL."""
    n = F.col("doc_id")
    body = F.when(n % 4 == 0, F.concat(F.lit("# Head "), n.cast("string"), F.lit(" #\n"), "text", F.lit("\n## End\nbye"))).when(n % 4 == 1, F.concat(F.lit("\nINSERT INTO t1 VALUES (1);\n"), F.regexp_replace("text", r"\.\n", ";\n"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select(F.concat(F.lit("f"), n.cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, KINDS)), (n % 4 + 1).cast("int"))).alias("path"), body.alias("text"))


_FILES = f"""files AS (SELECT 'f' || doc_id || '.' || (['{"','".join(KINDS)}'])[doc_id % 4 + 1] AS path, CASE WHEN doc_id % 4 = 0 THEN '# Head ' || doc_id || ' #' || chr(10) || text || chr(10) || '## End' || chr(10) || 'bye'
  WHEN doc_id % 4 = 1 THEN chr(10) || 'INSERT INTO t1 VALUES (1);' || chr(10) || regexp_replace(text, '\\.\\n', ';' || chr(10), 'g') ELSE text END AS text FROM documents)"""
_LINES = """lines AS (SELECT path, unnest(regexp_split_to_array(text, '\\r?\\n')) AS line, unnest(range(len(regexp_split_to_array(text, '\\r?\\n')))) AS nr FROM files)"""
_PARAGRAPHS = """pl AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY nr) AS block FROM lines),
paragraphs AS (SELECT path, 'paragraph ' || (min(nr) + 1) AS label, CAST(min(nr) + 1 AS INTEGER) AS start_line, CAST(max(nr) + 1 AS INTEGER) AS end_line, string_agg(line, chr(10) ORDER BY nr) AS text FROM pl WHERE trim(line) <> '' GROUP BY path, block)"""
_SECTIONS = """sl AS (SELECT *, regexp_extract(line, '^#{1,6}\\s+(.+?)\\s*#*\\s*$', 1) AS head FROM lines), sp AS (SELECT *, sum(CASE WHEN head <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY nr) AS part FROM sl),
sm AS (SELECT path, max(head) AS head, CAST(min(nr) + 1 AS INTEGER) AS start_line, CAST(max(nr) + 1 AS INTEGER) AS end_line, string_agg(line, chr(10) ORDER BY nr) AS text FROM sp GROUP BY path, part),
sections AS (SELECT path, CASE WHEN head = '' THEN 'preamble' ELSE head END AS label, start_line, end_line, text FROM sm WHERE trim(text) <> '')"""
_STATEMENTS = """tr AS (SELECT path, regexp_extract_all(text, '(?s).+?(?:;[ \\t]*(?:\\r?\\n|\\z)|\\z)') AS l FROM files), tp AS (SELECT path, unnest(l) AS raw, unnest(range(len(l))) AS nr FROM tr),
tb AS (SELECT *, length(raw) - length(replace(raw, chr(10), '')) AS breaks, regexp_extract(raw, '^\\s*') AS lead, regexp_replace(regexp_replace(raw, ';[ \\t]*(?:\\r?\\n)?$', ''), '^\\s+|\\s+$', '', 'g') AS text FROM tp),
ts AS (SELECT *, CAST(sum(breaks) OVER (PARTITION BY path ORDER BY nr) - breaks + length(lead) - length(replace(lead, chr(10), '')) + 1 AS INTEGER) AS start_line,
  regexp_extract(text, '(?is)^\\s*(?:--[^\\n]*\\n\\s*)*(create|alter|insert|update|delete|select|drop|with)\\b[^;]*?\\b(?:table|index|view|into|from|update)\\s+(?:if\\s+(?:not\\s+)?exists\\s+)?([A-Za-z_][\\w.]*)', 2) AS name FROM tb),
statements AS (SELECT path, CASE WHEN name <> '' THEN name ELSE 'statement ' || (nr + 1) END AS label, start_line, CAST(start_line + length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS end_line, text FROM ts WHERE text <> '')"""
_DIGEST = "path, label, start_line, end_line, md5(text) AS digest"


def _digest(chunks):
    return chunks.select("path", "label", "start_line", "end_line", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"WITH {_FILES}, {_LINES}, {_PARAGRAPHS} SELECT {_DIGEST} FROM paragraphs")
def file_paragraphs(spark, d):
    return _digest(chunking.paragraphs(_files(spark, d)))


@query(f"WITH {_FILES}, {_LINES}, {_SECTIONS} SELECT {_DIGEST} FROM sections")
def file_sections(spark, d):
    return _digest(chunking.sections(_files(spark, d)))


@query(f"WITH {_FILES}, {_STATEMENTS} SELECT {_DIGEST} FROM statements")
def file_statements(spark, d):
    return _digest(chunking.statements(_files(spark, d)))


@query(
    f"""WITH {_FILES}, {_LINES}, {_PARAGRAPHS}, {_SECTIONS}, {_STATEMENTS}, chunks AS (SELECT * FROM paragraphs WHERE path LIKE '%.txt' OR path LIKE '%.rst' UNION ALL SELECT * FROM sections WHERE path LIKE '%.md' UNION ALL SELECT * FROM statements WHERE path LIKE '%.sql'),
long AS (SELECT path, label, start_line, string_split(text, chr(10)) AS l FROM chunks WHERE length(text) > {MOST}), ll AS (SELECT path, label, start_line, unnest(l) AS line, unnest(range(len(l))) AS nr FROM long),
le AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY path, label, start_line ORDER BY nr) - length(line) - 1 AS at_char FROM ll), lp AS (SELECT *, at_char // {MOST} AS part FROM le),
lm AS (SELECT path, label, start_line, part, min(nr) AS a, max(nr) AS b, string_agg(line, chr(10) ORDER BY nr) AS text FROM lp GROUP BY 1, 2, 3, 4)
SELECT {_DIGEST} FROM (SELECT * FROM chunks WHERE length(text) <= {MOST} UNION ALL SELECT path, label || ' (part ' || row_number() OVER (PARTITION BY path, label, start_line ORDER BY part) || ')', CAST(start_line + a AS INTEGER), CAST(start_line + b AS INTEGER), text FROM lm)"""
)
def file_chunks(spark, d):
    return _digest(chunking.chunked(_files(spark, d), MOST))


_STATE = """now AS (SELECT 'f' || doc_id AS path, CAST(doc_id % 7 AS DOUBLE) AS mtime, n_chars AS size, sha256(text) AS sha FROM documents), old AS (SELECT CASE WHEN doc_id % 50 = 1 THEN 'g' ELSE 'f' END || doc_id AS path,
  CASE WHEN doc_id % 3 = 0 THEN -1.0 ELSE CAST(doc_id % 7 AS DOUBLE) END AS mtime, n_chars AS size, CASE WHEN doc_id % 6 = 0 THEN 'other' ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 10 > 0)"""


@query(
    f"""WITH {_STATE} SELECT coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NULL THEN 'vanished' WHEN o.path IS NULL THEN 'new' WHEN n.mtime = o.mtime AND n.size = o.size THEN 'same' WHEN n.sha = o.sha THEN 'same' ELSE 'changed' END AS state FROM now n FULL JOIN old o ON n.path = o.path"""
)
def file_states(spark, d):
    n, docs = F.col("doc_id"), table(spark, d, "documents")
    name = lambda p: F.concat(p, n.cast("string")).alias("path")
    sha = F.sha2(F.col("text").cast("binary"), 256)
    now = docs.select(name(F.lit("f")), (n % 7).cast("double").alias("mtime"), F.col("n_chars").alias("size"), sha.alias("sha256"))
    old = docs.where(n % 10 > 0).select(name(F.when(n % 50 == 1, "g").otherwise("f")), F.when(n % 3 == 0, -1.0).otherwise((n % 7).cast("double")).alias("mtime"), F.col("n_chars").alias("size"), F.when(n % 6 == 0, "other").otherwise(sha).alias("sha256"))
    return store.stale_files(now, old).select("path", "state")


RULES = [("mail", "privacy", "low", "[a-z]+@[a-z.]+"), ("license", "legal", "medium", "[Ll]icen[sc]e"), ("digits", "noise", "low", "[0-9]{4}")]


@query(
    f"""WITH rules AS (SELECT * FROM (VALUES {", ".join(str(r) for r in RULES)}) v(rule_id, domain, severity, pattern)), hits AS (SELECT rule_id, domain, severity, 'f' || doc_id AS path, rule_id || ':' || sha1('f' || doc_id) AS dedup_key, doc_id FROM documents, rules WHERE regexp_matches(text, pattern)),
known AS (SELECT 'mail:' || sha1('f' || doc_id) AS dedup_key FROM documents WHERE doc_id % 3 < 2) SELECT rule_id, domain, severity, path, dedup_key FROM hits WHERE dedup_key NOT IN (SELECT dedup_key FROM known)"""
)
def new_findings(spark, d):
    """The table of known findings: every document's mail finding, open, ticketed or closed. Files come twice, findings once."""
    files = table(spark, d, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), "text")
    rules = spark.createDataFrame(RULES, "rule_id string, domain string, severity string, pattern string")
    status = F.element_at(F.array(F.lit("open"), F.lit("ticketed"), F.lit("closed")), (F.col("doc_id") % 3 + 1).cast("int"))
    known = table(spark, d, "documents").select(F.concat(F.lit("mail:"), F.sha1(F.concat(F.lit("f"), F.col("doc_id").cast("string")).cast("binary"))).alias("dedup_key"), status.alias("status"))
    return chunking.new_findings(chunking.findings(files.unionByName(files), rules), known)


@query(f"""WITH {TASKS} SELECT id, 'pending' AS status FROM tasks WHERE status = 'in_progress' AND id % 72 > 48 AND id % 5 > 0""")
def stale_claims(spark, d):
    n = F.col("id")
    claimed = tasks(spark, d).select("id", "status", F.timestamp_seconds(F.lit(AS_OF_S) - n % 72 * 3600).alias("claimed_at"), F.when(n % 5 == 0, "hold: WATCHDOG_EXEMPT").when(n % 7 > 0, "started").alias("notes"))
    return jobs.stale_claims(claimed, datetime.fromtimestamp(AS_OF_S, UTC)).select("id", "status")


@query(
    f"""WITH {EVENTS}, l AS (SELECT agent_id, id, CASE event_type WHEN 'error' THEN 'FAILED t' || id WHEN 'purchase' THEN '=== ' || k || ' passed, ' || id || ' failed ===' ELSE 'ok ' || id END AS v FROM log)
SELECT agent_id, count(*) AS lines, count(*) FILTER (v LIKE 'FAILED%') AS failures, arg_min(v, id) FILTER (v LIKE '=== %') AS summary FROM l GROUP BY 1"""
)
def log_summaries(spark, d):
    n = F.col("id").cast("string")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("FAILED t"), n)).when(F.col("event_type") == "purchase", F.concat(F.lit("=== "), F.col("k").cast("string"), F.lit(" passed, "), n, F.lit(" failed ==="))).otherwise(F.concat(F.lit("ok "), n))
    return analytics.log_summary(events(spark, d).select("agent_id", "id", line.alias("value")), "^FAILED", r"^={3,}.*\b\d+ (passed|failed|error|skipped)\b.*={3,}\s*$", keys=["agent_id"], at="id")


@query(f"""WITH {TASKS} SELECT assigned_to, count(*) FILTER (id % 5 IN (0, 1)) AS staged, count(*) FILTER (id % 5 IN (0, 2)) AS unstaged, count(*) FILTER (id % 5 = 3) AS untracked, count(*) FILTER (id % 5 = 4) AS ignored FROM tasks GROUP BY 1""")
def status_summaries(spark, d):
    start = F.element_at(F.array(F.lit("1 MM N... 1 2 3 4 5 "), F.lit("2 R. N... 1 2 3 4 5 R100 "), F.lit("1 .D N... 1 2 3 4 5 "), F.lit("? "), F.lit("! ")), (F.col("id") % 5 + 1).cast("int"))
    return analytics.status_summary(tasks(spark, d).select("assigned_to", F.concat(start, F.lit("src/f"), F.col("id").cast("string")).alias("value")), ["assigned_to"])


_ROWS = ["-rw-r--r-- 1 a b 12 Jan 3 10:00 file 1.py", "drwxr-xr-x 2 a b 4096 Jan 3 2024 src", "lrwxrwxrwx 1 a b 3 Jan 3 10:00 now -> old", "-rw-r--r--@ 1 a b 0 Jan 3 10:00 .profile", "-rw-r--r-- 1 a b 0 Jan 3 10:00 Makefile", "total 12", "drwxr-xr-x 2 a b 0 Jan 3 10:00 .."]


def _listed(spark, d):
    return tasks(spark, d).select("assigned_to", F.element_at(F.array(*map(F.lit, _ROWS)), (F.col("id") % len(_ROWS) + 1).cast("int")).alias("value"))


@query(f"""WITH {TASKS} SELECT assigned_to, count(*) FILTER (id % 7 IN (0, 3, 4)) AS files, count(*) FILTER (id % 7 = 1) AS folders, count(*) FILTER (id % 7 = 2) AS links FROM tasks WHERE id % 7 < 5 GROUP BY 1""")
def listing_counts(spark, d):
    return analytics.listing_summary(_listed(spark, d), ["assigned_to"])[0]


@query(f"""WITH {TASKS} SELECT assigned_to, CASE WHEN id % 7 = 0 THEN 'py' ELSE '(none)' END AS extension, count(*) AS n FROM tasks WHERE id % 7 IN (0, 3, 4) GROUP BY 1, 2""")
def listing_extensions(spark, d):
    return analytics.listing_summary(_listed(spark, d), ["assigned_to"])[1]


def _roadmaps(spark, d):
    """Each document with check boxes and phase headings after its text."""
    n = F.col("doc_id")
    boxes = F.concat(F.when(n % 2 == 0, "\n- [x] **Phase 1: A**").otherwise("\n- [ ] **Phase 1: A**"), F.lit("\n- [X] Phase 2\n- [ ] Phase 2\n- [ ] then **Phase 9B**\n"))
    heads = F.concat(F.lit("## Phase 1: Start (INSERTED)\n**Goal:** go "), n.cast("string"), F.lit("\ntext\n### Phase 2: Next\n**Depends on:** Phase 1\n#### Phase 3.1 : Third \nmore"))
    return table(spark, d, "documents").select(n.alias("path"), F.concat("text", boxes, heads).alias("text"))


def _folders(spark, d):
    """Files of folders 01-a (as many plans as the id modulo 3, one summary), 02-b (a context) and 07 (a plan, two summaries)."""
    n = F.col("doc_id")
    files = F.array(*[F.struct(F.lit(a).alias("folder"), F.lit(b).alias("file"), when.alias("there")) for a, b, when in [
        ("01-a", "01-1-PLAN.md", n % 3 > 0), ("01-a", "01-2-PLAN.md", n % 3 > 1), ("01-a", "01-1-SUMMARY.md", n % 5 > 0), ("02-b", "02-CONTEXT.md", n % 4 > 0), ("07", "PLAN.md", n % 6 == 0), ("07", "SUMMARY.md", n % 6 == 0), ("07", "x-SUMMARY.md", n % 6 == 0),
    ]])
    rows = table(spark, d, "documents").select(n.alias("path"), F.explode(files).alias("f")).where("f.there")
    return plans_on_disk.phase_folders(rows.select("path", "f.folder", "f.file"))


@query(
    """WITH p AS (SELECT doc_id AS path, *, CAST(doc_id % 3 AS BIGINT) AS p1, CAST(CASE WHEN doc_id % 5 > 0 THEN 1 ELSE 0 END AS BIGINT) AS s1 FROM documents WHERE text IS NOT NULL)
SELECT path, '1' AS number, 'Start' AS name, 'go ' || doc_id AS goal, NULL::VARCHAR AS depends_on, doc_id % 2 = 0 AS ticked, p1 AS plans, s1 AS summaries,
  CASE WHEN doc_id % 2 = 0 THEN 'complete' WHEN p1 + s1 = 0 THEN 'no_directory' WHEN s1 >= p1 AND p1 > 0 THEN 'complete' WHEN s1 > 0 THEN 'partial' ELSE 'planned' END AS state FROM p
UNION ALL SELECT path, '2', 'Next', NULL, 'Phase 1', true, 0, 0, 'complete' FROM p UNION ALL SELECT path, '3.1', 'Third', NULL, NULL, false, 0, 0, 'no_directory' FROM p"""
)
def roadmap_states(spark, d):
    phases = plans_on_disk.roadmap_phases(_roadmaps(spark, d))
    return plans_on_disk.phase_states(phases, _folders(spark, d)).drop("at")


@query(
    """WITH p AS (SELECT doc_id AS path, doc_id FROM documents WHERE text IS NOT NULL)
SELECT path, '9B' AS number, 'box_without_heading' AS rule FROM p UNION ALL SELECT path, '1', 'phase_without_folder' FROM p WHERE doc_id % 3 = 0 AND doc_id % 5 = 0 UNION ALL SELECT path, '2', 'phase_without_folder' FROM p WHERE doc_id % 4 = 0
UNION ALL SELECT path, '3.1', 'phase_without_folder' FROM p UNION ALL SELECT path, '7', 'folder_without_phase' FROM p WHERE doc_id % 6 = 0 UNION ALL SELECT path, '1', 'plan_without_summary' FROM p WHERE doc_id % 3 = 2 AND doc_id % 5 > 0
UNION ALL SELECT path, '1', 'summary_without_plan' FROM p WHERE doc_id % 3 = 0 AND doc_id % 5 > 0 UNION ALL SELECT path, '7', 'summary_without_plan' FROM p WHERE doc_id % 6 = 0"""
)
def roadmap_drift(spark, d):
    maps = _roadmaps(spark, d)
    return plans_on_disk.drift(plans_on_disk.roadmap_phases(maps), plans_on_disk.ticks(maps), _folders(spark, d))


_PLAIN = "|".join(h.split("(")[0] for h in words.HEDGES)
_TOKEN = rf"`[^`]+`|(?:https?|ftp)://\S+|^(?:\.{{1,2}}/|/|~/)\S+|\s(?:\.{{1,2}}/|/|~/)\S+|(?i:{_PLAIN})\b|[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]"
_IDLE = "|".join([*(h.split("(")[0] for h in words.HEDGES), *words.ARTICLES, *words.FILLERS])


@query(
    f"""WITH src AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Please note that the very ~/a/the x ' || text ELSE text END AS text, doc_id % 4 = 1 AS coded FROM documents), lines AS (SELECT doc_id, coded, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS nr FROM src),
s AS (SELECT doc_id, nr, CASE WHEN coded OR regexp_matches(line, '^\\s*<[^>]+>\\s*$') THEN line ELSE regexp_replace(regexp_replace(array_to_string(list_filter(regexp_extract_all(line, '{_TOKEN}'), lambda t: NOT regexp_full_match(lower(t), '{_IDLE}')), ''), '[ \\t]+([ \\t])', '\\1', 'g'), '^\\s+|\\s+$', '', 'g') END AS line FROM lines)
SELECT doc_id, md5(CASE WHEN doc_id % 4 = 1 THEN '```' || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY nr)) AS digest FROM s GROUP BY 1"""
)
def grammar_stripped(spark, d):
    """A fence is opened before every fourth document and never closed, so it stays as it is."""
    n = F.col("doc_id")
    text = F.when(n % 3 == 0, F.concat(F.lit("Please note that the very ~/a/the x "), "text")).otherwise(F.col("text"))
    files = table(spark, d, "documents").select(n.alias("path"), F.when(n % 4 == 1, F.concat(F.lit("```\n"), text)).otherwise(text).alias("text"))
    return chunking.grammar_stripped(files).select(F.col("path").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("digest"))
