"""Reports over agents, audit trails, caches and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import scalars


def tag_histogram(rows: DataFrame, top: int, tags: str = "tags") -> DataFrame:
    """The commonest tags, with the number of all different tags beside each."""
    counts = rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    kinds = counts.agg(F.count("*").alias("distinct_tags"))
    return counts.orderBy(F.desc("n"), "tag").limit(top).crossJoin(F.broadcast(kinds))  # kinds is one row


def exact_mean(column: str) -> Column:
    """The mean of a column of doubles as ten-digit decimals, so that a tie in what is rounded doesn't hang on the order of the sum; in double precision where a value is no such decimal."""
    exact = F.expr(f"try_cast({column} AS DECIMAL(28, 10))")
    same = F.count(column) == F.count_if(exact.cast("double") == F.col(column))
    return F.when(same, (F.try_sum(exact) / F.count(column)).cast("double")).otherwise(F.avg(column))


def share_of(part: Column) -> Column:
    """part of all rows of a group, to three digits; rounded as a double, as the SQL does, and not by its decimal digits."""
    return F.round(part / F.count("*") * 1000) / 1000


def agent_summary(log: DataFrame) -> DataFrame:
    passed = F.count_if(F.col("outcome") == "pass")
    return log.groupBy("agent_id").agg(F.count("*").alias("total"), passed.alias("passed"), F.count_if(F.col("outcome") == "fail").alias("failed"), F.round(exact_mean("value"), 1).alias("avg_minutes"), share_of(passed).alias("pass_rate"))


def agent_metrics(log: DataFrame) -> DataFrame:
    share = lambda what: share_of(F.count_if(F.col("outcome") == what))
    return log.groupBy("agent_id").agg(F.count("*").alias("n"), F.round(exact_mean("value")).cast("int").alias("avg_time"), F.round(F.avg("k")).cast("int").alias("avg_tokens"), share("fail").alias("error_rate"), share("pass").alias("pass_rate"))


def coverage(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count(column).alias("embedded"), F.round(100.0 * F.count(column) / F.greatest(F.count("*"), F.lit(1)), 1).alias("pct"))


def tally(rows: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def other_models(rows: DataFrame, column: str, model: str) -> DataFrame:
    """Rows whose vectors are not of the model, null included, by model, with the tokens that embedding them anew would take."""
    return rows.where(~F.col(column).eqNullSafe(model)).groupBy(F.col(column).alias("model")).agg(F.count("*").alias("n"), F.sum(scalars.token_estimate("text")).alias("tokens"))


def drift(rows: DataFrame, key: str, value: str, order: list[str], last: int = 3, margin: float = 15.0) -> DataFrame:
    """Each key's newest value against the mean of the `last` ones before it."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    recent = rows.withColumn("_place", place).where(F.col("_place") <= last + 1).groupBy(key)
    mean, now = F.avg(F.when(F.col("_place") > 1, F.col(value))), F.max(F.when(F.col("_place") == 1, F.col(value)))
    return recent.agg(F.round(mean, 4).alias("rolling"), now.alias("current"), F.coalesce(now > mean + margin, F.lit(False)).alias("warn"))


def since_last(rows: DataFrame, key: str, event: Column, order: str = "id") -> DataFrame:
    """How many rows each key has after its last event (all, if it has none)."""
    last = rows.groupBy(key).agg(F.max(F.when(event, F.col(order))).alias("_last"))
    return rows.join(last, key).groupBy(key).agg(F.count_if(F.col(order) > F.coalesce("_last", F.lit(-1))).alias("since"))


def budget_verdict(rows: DataFrame, key: str, tokens: str, order: list[str], ceiling: int, warn: int) -> DataFrame:
    spent = F.sum(tokens).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    return rows.withColumn("spent", spent).withColumn("verdict", F.when(F.col("spent") > ceiling, "over").when(F.col("spent") > warn, "warn").otherwise("ok"))


def adjacent_repeats(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Runs of equal neighbouring lines of each text: (key, island, line, times). Islands count from 1."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    order = Window.partitionBy(key).orderBy("at")
    marked = lines.withColumn("new", F.when(F.col("line") == F.lag("line").over(order), 0).otherwise(1))
    return marked.withColumn("island", F.sum("new").over(order)).groupBy(key, "island").agg(F.first("line").alias("line"), F.count("*").alias("times"))


def log_summary(lines: DataFrame, failure: str, summary: str, text: str = "value", keys: list[str] | None = None, at: str | None = None) -> DataFrame:
    """Of each test log: its lines, those that report failures, and the first summary line. at: what orders the lines; without it, as they were read."""
    hit = F.col(text).rlike(summary)
    order = F.col(at) if at else F.monotonically_increasing_id()
    rows = lines.withColumn("_order", order)
    return rows.groupBy(*(keys or [])).agg(F.count("*").alias("lines"), F.count_if(F.col(text).rlike(failure)).alias("failures"), F.min_by(text, F.when(hit, F.col("_order"))).alias("summary"))


def status_summary(records: DataFrame, keys: list[str], text: str = "value") -> DataFrame:
    """Of records of a working tree's state (`1 XY ... path`, `2 ...` for renames, `? path`, `! path`): staged, unstaged, untracked and ignored ones."""
    kind, xy = F.left(text, F.lit(1)), F.split_part(F.col(text), F.lit(" "), F.lit(2))
    changed = kind.isin("1", "2")
    return records.groupBy(*keys).agg(
        F.count_if(changed & F.substring(xy, 1, 1).rlike("[MADRC]")).alias("staged"), F.count_if(changed & F.substring(xy, 2, 1).rlike("[MD]")).alias("unstaged"),
        F.count_if(kind == "?").alias("untracked"), F.count_if(kind == "!").alias("ignored"),
    )


def listing_summary(lines: DataFrame, keys: list[str], text: str = "value") -> tuple[DataFrame, DataFrame]:
    """Of long listings (mode bits first): (files, folders and links of each key; its files by extension, `(none)` without one). Other lines, `.` and `..` don't count."""
    row = r"^([-dlbcps])[-rwxsStT]{9}\S*\s+\d+\s+\S+\s+\S+\s+\S+\s+\S+\s+\S+\s+\S+\s+(.+)$"
    kind, name = F.regexp_extract(text, row, 1), F.regexp_extract(text, row, 2)
    rows = lines.select(*keys, kind.alias("kind"), F.when(kind == "l", F.substring_index(name, " -> ", 1)).otherwise(name).alias("name")).where("kind <> '' AND name NOT IN ('.', '..')")
    counts = rows.groupBy(*keys).agg(F.count_if(~F.col("kind").isin("d", "l")).alias("files"), F.count_if(F.col("kind") == "d").alias("folders"), F.count_if(F.col("kind") == "l").alias("links"))
    extension = F.regexp_extract("name", r"[^/]\.([^./]*)$", 1)
    dotted = F.col("name").rlike(r"[^/]\.[^./]*$")
    return counts, rows.where("kind NOT IN ('d', 'l')").groupBy(*keys, F.when(dotted, extension).otherwise("(none)").alias("extension")).agg(F.count("*").alias("n"))


def change_summary(numstat: DataFrame, text: str = "value", top: int = 5) -> DataFrame:
    """Of `added<TAB>deleted<TAB>path` lines: churn by top-level folder, the largest first."""
    part = F.split(text, "\t")
    rows = numstat.select(part[0].try_cast("int").alias("added"), part[1].try_cast("int").alias("deleted"), F.when(part[2].contains("/"), F.substring_index(part[2], "/", 1)).otherwise(".").alias("folder"))
    out = rows.groupBy("folder").agg(F.count("*").alias("files"), F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"))
    return out.orderBy(F.desc(F.col("added") + F.col("deleted")), "folder").limit(top)


def snapshots_to_prune(snapshots: DataFrame, now_s: int, keep_auto: int = 7, keep_least: int = 3, days: int = 30) -> DataFrame:
    """Of (id, reason, created_s, verified): which to prune. Manual ones stay, and the newest verified one of each reason."""
    place = F.row_number().over(Window.partitionBy("reason").orderBy(F.desc("created_s"), F.desc("id")))
    newest = snapshots.where("verified").groupBy("reason").agg(F.max(F.struct("created_s", "id")).alias("best")).select("reason", F.col("best.id").alias("best_id"))
    rows = snapshots.withColumn("place", place).join(newest, "reason", "left")
    old = F.when(F.col("reason") == "auto", F.col("place") > keep_auto).when(F.col("reason") == "manual", F.lit(False)).otherwise((F.col("place") > keep_least) & (F.col("created_s") < now_s - days * 86400))
    return rows.where(old & ~F.coalesce(F.col("id") == F.col("best_id"), F.lit(False))).select("id", "reason")


def rate_limited(log: DataFrame, key: str, at: str, most: int = 60, seconds: int = 60) -> DataFrame:
    """Adds over: whether more than `most` rows of the key fall into the seconds up to and with this one."""
    window = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds + 1, 0)
    return log.withColumn("over", F.count("*").over(window) > most)
