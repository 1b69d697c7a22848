"""The task engine: priorities, gating, queues, reconciliation."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.storage import BLOCK, in_blocks, small, stored

COOLDOWN_S, STALE_S = 20 * 60, 48 * 3600
# Allowed moves between states.
MOVES = {
    "pending": ["in_progress", "deferred", "failed"],
    "in_progress": ["validation", "failed", "deferred", "pending"],
    "validation": ["done", "failed", "in_progress", "pending"],
    "done": ["pending"],
    "failed": ["pending", "in_progress", "deferred"],
    "deferred": ["pending", "in_progress"],
    "escalated": ["pending", "in_progress"],
}
TRANSITIONS = [(a, b) for a, some in MOVES.items() for b in some]
# What notes of failures say.
FAILURES_TO_ESCALATE = 3
MISMATCHES = ["outside my capability", "cannot handle", "domain mismatch", "wrong agent", "re-route", "specialist needed", "not qualified", "unfamiliar with"]
TRANSIENTS = ["timeout", "connection refused", "econnreset", "network error", "rate limit", "429", "503", "service unavailable", "temporary", "retry", "intermittent", "flaky"]
PHASES, SUBSTANCE, LEARNING_SIZE = "RPETD", 50, 100
BRANCH = r"(?i)git\s+checkout\s+-b|\bbranch\b\s*[:=]|\b(?:feat|fix|chore|hotfix|refactor|release)/"
TESTED = r"(?i)exit\s*(?:code\s*)?[:=]?\s*0\b|\b\d+\s+(?:tests?\s+)?passed\b|\b0\s+failed\b|all tests passed|build\s+(?:pass|successful)|lint\s+pass|checks\s*green|\$\s|>>>\s|PASS\s+\S"


def with_dependency_pressure(tasks: DataFrame) -> DataFrame:
    """Adds dependents: how often any task, done ones included, names this one as a dependency."""
    named = tasks.select(F.explode("dependencies").alias("id")).groupBy("id").agg(F.count("*").alias("dependents"))
    return tasks.join(named, "id", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)))


def priority_score(importance: Column, urgency: Column, dependents: Column, priority: Column, due_s: Column, now_s: int) -> Column:
    """0.4 importance + 0.3 urgency + 0.3 dependents (5 at most); critical adds to importance, a near due date to urgency."""
    clamp = lambda c: F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(c, F.lit(3))))
    imp, urg = clamp(importance), clamp(urgency)
    imp = F.when(priority == "critical", F.least(F.lit(5), imp + 1)).otherwise(imp)
    left = F.floor((due_s - now_s) / 86400)
    urg = F.when(left <= 0, 5).when(left <= 1, F.least(F.lit(5), urg + 2)).when(left <= 3, F.least(F.lit(5), urg + 1)).otherwise(urg)
    return F.round(imp * 0.4 + urg * 0.3 + F.least(F.lit(5), dependents) * 0.3, 2)


def scored(tasks: DataFrame, now_s: int) -> DataFrame:
    return with_dependency_pressure(tasks).withColumn("score", priority_score(F.col("importance"), F.col("urgency"), F.col("dependents"), F.col("priority"), F.col("due_s"), now_s))


def with_deps_met(tasks: DataFrame) -> DataFrame:
    """Adds deps_met and blocking: whether all dependencies are done (a missing one counts as done), and how many aren't."""
    wanted = tasks.select("id", F.explode("dependencies").alias("dep"))
    state = tasks.select(F.col("id").alias("dep"), F.col("status").alias("dep_status"))
    open_ = wanted.join(state, "dep").where("dep_status <> 'done'").groupBy("id").agg(F.count("*").alias("blocking"))
    return tasks.join(open_, "id", "left").withColumn("blocking", F.coalesce("blocking", F.lit(0))).withColumn("deps_met", F.col("blocking") == 0)


def next_tasks(tasks: DataFrame, now_s: int) -> DataFrame:
    """Each agent's next task: its best pending one with dependencies met and not cooling down, else its best failed one."""
    rows = with_deps_met(scored(tasks, now_s))
    cooling = F.coalesce(F.lit(now_s) - F.col("gate_fail_s") < COOLDOWN_S, F.lit(False)) if "gate_fail_s" in tasks.columns else F.lit(False)
    tier = F.when((F.col("status") == "pending") & F.col("deps_met") & ~cooling, 0).when(F.col("status") == "failed", 1)
    best = F.min(F.struct("tier", (-F.col("score")).alias("minus"), "created_s", "id")).alias("best")
    out = rows.withColumn("tier", tier).where("tier IS NOT NULL").groupBy("assigned_to").agg(best)
    return out.select("assigned_to", "best.id", (-F.col("best.minus")).alias("score"), F.when(F.col("best.tier") == 0, "next").otherwise("retry").alias("kind"))


def queue_heads(tasks: DataFrame, agents: DataFrame, now_s: int, validator: str = "validator") -> DataFrame:
    """(agent, kind, id, score, cooling) of every agent (agent distinct): what it is told when it asks for work.

    kind: next (a pending task with dependencies met that doesn't cool down after a failed gate), else retry (a failed one), else, for the validator,
    validate (any agent's task that awaits it), else empty, with the number of its tasks that cool down. Of several the best score, the earliest and the least id. Names are compared in lower case.
    """
    rows = with_deps_met(scored(tasks, now_s))
    cooling = F.coalesce(F.lit(now_s) - F.col("gate_fail_s") < COOLDOWN_S, F.lit(False)) if "gate_fail_s" in tasks.columns else F.lit(False)
    rows = rows.withColumn("agent", F.lower(F.coalesce("assigned_to", F.lit("")))).withColumn("cooling", cooling & (F.col("status") == "pending"))
    tier = F.when((F.col("status") == "pending") & F.col("deps_met") & ~F.col("cooling"), 0).when(F.col("status") == "failed", 1)
    order = F.struct("tier", (-F.col("score")).alias("minus"), "created_s", "id")
    own = rows.withColumn("tier", tier).groupBy("agent").agg(F.min(F.when(F.col("tier").isNotNull(), order)).alias("best"), F.count_if(F.col("cooling")).alias("cooling"))
    waiting = rows.where("status = 'validation'").withColumn("tier", F.lit(2)).agg(F.min(order).alias("waiting"))  # one row
    asked = agents.select("agent", F.lower("agent").alias("_agent"))
    found = asked.join(own, F.col("_agent") == own["agent"], "left").drop(own["agent"]).crossJoin(F.broadcast(waiting))
    own, queue = F.col("best").isNotNull(), (F.col("_agent") == validator) & F.col("waiting").isNotNull()
    kind = F.when(own, F.when(F.col("best.tier") == 0, "next").otherwise("retry")).when(queue, "validate").otherwise("empty")
    pick = lambda name: F.when(own, F.col(f"best.{name}")).when(queue, F.col(f"waiting.{name}"))
    return found.select("agent", kind.alias("kind"), pick("id").alias("id"), (-pick("minus")).alias("score"), F.coalesce("cooling", F.lit(0)).alias("cooling"))


def board(tasks: DataFrame, now_s: int, limit: int = 5) -> DataFrame:
    """Per state its count and share of complete tasks, and its best tasks in order."""
    rows = scored(tasks, now_s)
    totals = rows.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg(F.col("rpetd_complete").cast("int")), 4).alias("complete_ratio"))
    place = F.row_number().over(Window.partitionBy("status").orderBy(F.desc("score"), "id"))
    return rows.withColumn("place", place).where(F.col("place") <= limit).join(F.broadcast(totals), "status").select("status", "n", "complete_ratio", "place", "id", "score")


def stats(tasks: DataFrame) -> DataFrame:
    """Counts by type, state, agent, sprint and project in one pass (grouping sets)."""
    dims = ["type", "status", "assigned_to", "sprint", "project_id"]
    rows = tasks.select(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in dims], (F.col("status") == "done").cast("int").alias("done"))
    sets = rows.groupingSets([[F.col(c)] for c in dims], *[F.col(c) for c in dims]).agg(F.count("*").alias("n"), F.sum("done").alias("done"))
    return sets.select(F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in dims]).alias("dimension"), F.coalesce(*dims).alias("key"), "n", "done")


def reconciled(left: DataFrame, right: DataFrame, fields: list[str]) -> DataFrame:
    """Differences of two copies: rows that one side lacks, and fields that differ (null equals blank). (id, kind, field, left, right)"""
    text = lambda side, c: F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit(""))
    both = left.alias("l").join(right.alias("r"), F.col("l.id") == F.col("r.id"), "full")
    kind = F.when(F.col("r.id").isNull(), "missing").when(F.col("l.id").isNull(), "extra")
    cells = F.array(*[F.struct(F.lit(c).alias("field"), text("l", c).alias("left"), text("r", c).alias("right")) for c in fields])
    differ = F.filter(cells, lambda s: s["left"] != s["right"])
    lone = F.array(F.struct(F.lit("").alias("field"), F.lit("").alias("left"), F.lit("").alias("right")))
    rows = both.select(F.coalesce("l.id", "r.id").alias("id"), kind.alias("kind"), F.explode(F.when(kind.isNotNull(), lone).otherwise(differ)).alias("d"))
    return rows.select("id", F.coalesce("kind", F.lit("differs")).alias("kind"), "d.field", "d.left", "d.right")


def archived(tasks: DataFrame, now_s: int, days: int) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): done tasks not touched for so many days go, and their ids leave the others' dependencies."""
    old = (F.col("status") == "done") & (F.col("created_s") < now_s - days * 86400)
    gone, kept = tasks.where(old), tasks.where(~F.coalesce(old, F.lit(False)))
    pairs = kept.select("id", F.posexplode("dependencies").alias("at", "dep")).join(gone.select(F.col("id").alias("dep")), "dep", "left_anti")
    left = pairs.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "dep"))), lambda s: s["dep"]).alias("left"))
    return kept.join(left, "id", "left").withColumn("dependencies", F.coalesce("left", F.array().cast("array<bigint>"))).drop("left"), gone


def upserted(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """changes replace rows of the same id and are added otherwise."""
    return tasks.join(changes.select("id"), "id", "left_anti").unionByName(changes, allowMissingColumns=True)


def next_ids(tasks: DataFrame, id_col: str = "name") -> DataFrame:
    """The next free id of each prefix, padded to four digits."""
    prefix, number = F.regexp_extract(id_col, "^([A-Z]+)-[0-9]+$", 1), F.regexp_extract(id_col, "^[A-Z]+-([0-9]+)$", 1).cast("long")
    rows = tasks.where(F.col(id_col).rlike("^[A-Z]+-[0-9]+$")).groupBy(prefix.alias("prefix")).agg((F.max(number) + 1).alias("next"))
    return rows.select("prefix", F.concat("prefix", F.lit("-"), F.lpad(F.col("next").cast("string"), F.greatest(F.lit(4), F.length(F.col("next").cast("string"))), "0")).alias("next_id"))


def tree(tasks: DataFrame) -> DataFrame:
    """(id, root, depth, path) of the parent-child forest, level by level until no child is left. A cycle is never entered."""
    level = tasks.where("parent IS NULL").select("id", F.col("id").alias("root"), F.lit(0).alias("depth"), F.lpad(F.col("id").cast("string"), 12, "0").alias("path"))
    level = stored(level, "level")
    out, depth = level, 0
    while True:
        level = tasks.join(level.select(F.col("id").alias("parent"), "root", F.col("path").alias("up")), "parent").select("id", "root", F.lit(depth + 1).alias("depth"), F.concat_ws("/", "up", F.lpad(F.col("id").cast("string"), 12, "0")).alias("path"))
        level = stored(level, "level")
        if level.isEmpty():
            return out
        out, depth = out.unionByName(level), depth + 1


def circuit_breakers(outcomes: DataFrame, limit: int = 3) -> DataFrame:
    """Per agent its failures since its last success, and whether that opens its breaker. (agent_id, id ascending in time, outcome)"""
    last = outcomes.groupBy("agent_id").agg(F.max(F.when(F.col("outcome") == "pass", F.col("id"))).alias("last"))
    since = outcomes.join(last, "agent_id").groupBy("agent_id").agg(F.count(F.when((F.col("outcome") == "fail") & (F.col("last").isNull() | (F.col("id") > F.col("last"))), 1)).alias("failures"))
    return since.withColumn("open", F.col("failures") >= limit)


def allowed(before: Column, after: Column) -> Column:
    """Whether a task may go from one state to another."""
    moves = F.create_map(*[x for a, some in MOVES.items() for x in (F.lit(a), F.array(*map(F.lit, some)))])
    return F.coalesce(F.array_contains(moves[before], after), F.lit(False))


def gates(phases: dict[str, Column], code: Column, pr_url: Column) -> Column:
    """The validation gates of a task as an array of (gate, status): PASS, FAIL, or SKIP where the gate doesn't apply."""
    text = {p: F.trim(F.coalesce(phases[p], F.lit(""))) for p in PHASES}
    brief = lambda p: F.when(text[p] == "", "SKIP").when(F.length(text[p]) >= SUBSTANCE, "PASS").otherwise("FAIL")
    full = F.when(F.array_contains(F.array(*text.values()), ""), "FAIL").otherwise("PASS")
    only = lambda ok: F.when(~code, "SKIP").when(ok, "PASS").otherwise("FAIL")
    tested = F.when(F.when(code, text["T"].rlike(TESTED)).otherwise(F.length(text["T"]) >= SUBSTANCE), "PASS").otherwise("FAIL")
    learned = F.length(F.trim(F.regexp_extract(text["D"], r"(?is)LEARNING\s*:\s*(.+)", 1))) >= LEARNING_SIZE
    found = {"RPETD_COMPLETE": full, "R_PHASE_SUBSTANCE": brief("R"), "P_PHASE_SUBSTANCE": brief("P"), "BRANCH_EVIDENCE": only(text["E"].rlike(BRANCH)), "TEST_EVIDENCE": tested, "LEARNING_BLOCK": F.when(learned, "PASS").otherwise("FAIL"), "PR_URL": only(pr_url.isNotNull())}
    return F.array(*[F.struct(F.lit(k).alias("gate"), v.alias("status")) for k, v in found.items()])


def failure_class(failures: Column, gate_status: Column, notes: Column) -> Column:
    """SYSTEMIC after repeated failures, GATE_FAIL if any of the gates' states says so, else by what the notes say. gate_status: array of states, empty if no gate ran."""
    low = F.lower(F.coalesce(notes, F.lit("")))
    says = lambda words: F.array_contains(F.array(*[low.contains(w) for w in words]), True)
    by_notes = F.when(says(MISMATCHES), "CAPABILITY_MISMATCH").when(says(TRANSIENTS), "TRANSIENT").when(F.size(gate_status) > 0, "GATE_FAIL").otherwise("CAPABILITY_MISMATCH")
    return F.when(F.coalesce(failures, F.lit(0)) >= FAILURES_TO_ESCALATE, "SYSTEMIC").when(F.array_contains(gate_status, "FAIL"), "GATE_FAIL").otherwise(by_notes)


# Fixed values of the features: least security score beneath a folder, and paths that stand for an interface.
SECURITY_FLOORS = {"services/": 3, "agents/": 3, "migrations/": 4, "specs/": 2}
INTERFACE = r"services/[^/]*daemon\.py$|^api/|/router\.py$|/routes\.py$"


def file_features(files: Column) -> Column:
    """Features of a list of paths: how many, test impact and depth (10 at most), migrations, interfaces, security, and different top folders."""
    files = F.filter(F.coalesce(files, F.array().cast("array<string>")), lambda f: f.isNotNull())
    floor = lambda f: F.greatest(F.lit(0), *[F.when(f.startswith(p), s).otherwise(0) for p, s in SECURITY_FLOORS.items()])
    parts = F.transform(files, lambda f: F.split(F.replace(f, F.lit("\\"), F.lit("/")), "/"))
    tops = F.array_distinct(F.transform(F.filter(parts, lambda p: (F.size(p) >= 2) & (F.get(p, 0) != "")), lambda p: F.get(p, 0)))
    return F.struct(
        F.size(files).alias("files_expected"),
        F.least(F.size(F.filter(files, lambda f: f.startswith("tests/"))), F.lit(10)).alias("test_impact"),
        F.least(F.floor(F.size(files) / 3).cast("int"), F.lit(10)).alias("dependency_depth"),
        F.exists(files, lambda f: f.rlike(r"migrations/[^/]+\.sql$")).alias("has_migration"),
        F.exists(files, lambda f: f.rlike(INTERFACE)).alias("has_api_change"),
        F.coalesce(F.array_max(F.transform(files, floor)), F.lit(0)).alias("security_sensitivity"),
        F.size(tops).alias("top_level_dir_width"),
    )


def classified(items: DataFrame, checkouts: list[str], aliases: dict[str, str], owners: DataFrame) -> DataFrame:
    """(id, project, rule, path_ambiguous, plan_ambiguous) of items (id, project_id, tags, title, blob); the first rule that applies decides.

    repo_tag: the first tag repo:<name> that names a checkout, itself or by alias. repo_path: the only checkout whose path occurs in
    blob. plan_owner: the first plan:NN-MM tag whose plan has one owner in owners (plan, checkout). title_prefix: an alias as
    [name] or name: before the title. Items with a project of their own are already_set, the rest unchanged; both keep it.
    """
    known, alias = F.array(*map(F.lit, checkouts)), F.create_map(*[F.lit(x) for kv in (aliases or {"": ""}).items() for x in kv])
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    names = F.transform(F.filter(tags, lambda t: F.lower(t).startswith("repo:")), lambda t: F.trim(F.trim(F.regexp_replace(t, r"^[^:]*:", "")), F.lit('"')))
    by_tag = F.get(F.filter(F.transform(names, lambda n: F.coalesce(alias[n], n)), lambda n: F.array_contains(known, n)), 0)
    paths = F.transform(F.regexp_extract_all(F.coalesce("blob", F.lit("")), F.lit(r"/Users/[A-Za-z0-9._-]+/Code/([A-Za-z0-9._-]+)"), 1), lambda n: F.rtrim(n, F.lit(".")))
    paths = F.array_intersect(F.array_distinct(paths), known)
    prefix = lambda p: F.lower(F.regexp_extract(F.coalesce("title", F.lit("")), p, 1))
    titled = [F.when(F.array_contains(known, alias[prefix(p)]), alias[prefix(p)]) for p in (r"^\[([A-Za-z0-9][A-Za-z0-9._-]{1,30})\]", r"^([A-Za-z0-9][A-Za-z0-9._-]{1,30}):\s")]
    plans = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r'^plan:"?(\d{2}-\d{2})"?$', 1)), lambda p: p != "")
    rows = items.select("id", F.coalesce(F.nullif(F.trim("project_id"), F.lit("")), F.lit("default")).alias("old"), by_tag.alias("by_tag"), paths.alias("paths"), F.coalesce(*titled).alias("by_title"), plans.alias("plans"))
    owned = small(stored(owners.groupBy("plan").agg(F.count_distinct("checkout").alias("n"), F.min("checkout").alias("owner")), "owners"))
    open_ = rows.where("old = 'default'")
    each = open_.select("id", F.posexplode("plans").alias("at", "plan")).join(owned, "plan")
    best = each.groupBy("id").agg(F.min(F.when(F.col("n") == 1, F.struct("at", "owner"))).alias("first"), F.min(F.when(F.col("n") > 1, F.col("at"))).alias("doubtful"))
    rows = rows.join(best, "id", "left")
    by_plan, one = F.col("first.owner"), F.when(F.size("paths") == 1, F.get("paths", F.lit(0)))
    is_open = F.col("old") == "default"
    rule = F.when(~is_open, "already_set").when(F.col("by_tag") != "default", "repo_tag").when(one != "default", "repo_path").when(by_plan != "default", "plan_owner").when(F.col("by_title") != "default", "title_prefix").otherwise("unchanged")
    project = F.when(is_open, F.coalesce(*[F.nullif(c, F.lit("default")) for c in (F.col("by_tag"), one, by_plan, F.col("by_title"))], F.col("old"))).otherwise(F.col("old"))
    untagged = is_open & F.col("by_tag").isNull()
    return rows.select(
        "id", project.alias("project"), rule.alias("rule"), (untagged & (F.size("paths") > 1)).alias("path_ambiguous"),
        F.coalesce(untagged & one.isNull() & (F.col("doubtful") < F.coalesce(F.col("first.at"), F.lit(2**31 - 1))), F.lit(False)).alias("plan_ambiguous"),
    )


STOP_WORDS = "the a an and or for to in on of is it with fix task blocker unblock resolve issue check pr due".split()  # fixed values
LEAST_RATIO, LEAST_OVERLAP = 0.70, 0.60


def _title_words(c: Column) -> Column:
    words = F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    return F.array_distinct(words)


def repeated_titles(writes: DataFrame, tasks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(query_id, duplicate_of): the first open task (least id) of a write's agent that has nearly its title, or null.

    writes: query_id (distinct), agent, title; tasks: id, agent, status, title. Nearly: the ratio of matching blocks of both titles is
    0.7 or more, or 0.6 of the longer one's words (without stop words) are in both. Titles without words or text overlap with none.
    Agents are compared in lower case; a write without an agent is compared with all. Pairs whose lengths rule the ratio out are left to the words.
    Equal titles of an agent are compared once, each by its two first tasks: one of them is no write's own.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        met: dict[tuple[str, str], float] = {}  # a title meets another for many agents
        out, last, match = [], None, difflib.SequenceMatcher()
        for pair in zip(a, b, strict=True):
            if (r := met.get(pair)) is None:
                if pair[1] != last:
                    match.set_seq2(last := pair[1])
                match.set_seq1(pair[0])
                r = met[pair] = match.ratio() if match.quick_ratio() >= LEAST_RATIO else 0.0
            out.append(r)
        return pd.Series(out, dtype=float)

    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    open_ = tasks.where(F.col("status").isin("pending", "in_progress")).select("id", F.lower(F.coalesce("agent", F.lit(""))).alias("agent"), clean("title").alias("title"))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    first = open_.withColumn("n", place("agent", "title")).where("n <= 2").groupBy("agent", "title").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    first = stored(first.withColumn("words", _title_words(F.col("title"))), "titles")
    asked = stored(writes.select("query_id", F.lower(F.coalesce("agent", F.lit(""))).alias("q_agent"), clean("title").alias("q_title")), "asked")
    kinds = asked.groupBy("q_agent", "q_title").agg(F.min("query_id").alias("query_id")).withColumn("q_words", _title_words(F.col("q_title")))

    def search(queries: DataFrame) -> DataFrame:
        own, any_ = first.join(queries, F.col("q_agent") == F.col("agent")).where("q_agent <> ''"), first.join(queries, F.col("q_agent") == "")
        pairs = own.unionByName(any_)
        most = F.greatest(F.size("words"), F.size("q_words"))
        pairs = pairs.withColumn("alike", F.coalesce((F.size("words") > 0) & (F.size("q_words") > 0) & (F.size(F.array_intersect("words", "q_words")) / F.greatest(most, F.lit(1)) >= LEAST_OVERLAP), F.lit(False)))
        lengths = F.length("title") + F.length("q_title")
        near = pairs.where(~F.col("alike") & ((lengths == 0) | (2 * F.least(F.length("title"), F.length("q_title")) / F.greatest(lengths, F.lit(1)) >= LEAST_RATIO)))
        near = near.where(ratio("q_title", "title") >= LEAST_RATIO)
        each = pairs.where("alike").select("q_agent", "q_title", F.explode("ids").alias("id")).unionByName(near.select("q_agent", "q_title", F.explode("ids").alias("id")))
        return each.withColumn("n", place("q_agent", "q_title")).where("n <= 2").groupBy("q_agent", "q_title").agg(F.array_sort(F.collect_list("id")).alias("ids"))

    found = asked.join(in_blocks(kinds, search, block), ["q_agent", "q_title"], "left")
    return found.select("query_id", F.get(F.filter("ids", lambda i: i != F.col("query_id")), F.lit(0)).alias("duplicate_of"))
