"""Modules that need each other by version ranges: what keeps a set of them from being installed, and in which order they go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import scalars
from fathom.operators import graph
from fathom.storage import stored


def module_problems(modules: DataFrame, requires: DataFrame) -> DataFrame:
    """(kind, dep, module_a, range_a, module_b, range_b, n) of modules (name, version, at) and what they require (name, dep, spec).

    duplicate: a later row of a name, against the first by `at`, which counts. missing: a required name that isn't there (n: by
    how many rows). conflict: two ranges of one dependency that no version meets, with the least name that asks for each; rows
    that ask for the same range stand together (n: pairs of rows), so a dependency of many gives pairs of different ranges only.
    unmet: a range that the version there isn't in (n: rows). A range that can't be read meets nothing, a version that can't be
    read is not compared. Rows without a name are left out.
    """
    first = stored(modules.where("name IS NOT NULL").groupBy("name").agg(F.min(F.struct("at", "version")).alias("first")), "modules")
    first = first.select("name", F.col("first.at").alias("first_at"), F.col("first.version").alias("first_version"))
    none = F.lit(None).cast("string")
    row = lambda kind, dep, a, ra, b, rb, n: [F.lit(kind).alias("kind"), dep.alias("dep"), a.alias("module_a"), ra.alias("range_a"), b.alias("module_b"), rb.alias("range_b"), n.cast("long").alias("n")]
    col = F.col
    again = modules.join(first, "name").where("at > first_at").select(*row("duplicate", none, col("name"), col("first_version"), col("name"), col("version"), F.lit(1)))
    asked = requires.where("name IS NOT NULL AND dep IS NOT NULL").groupBy("dep", "spec").agg(F.count("*").alias("n"), F.min("name").alias("module"))
    asked = stored(asked.withColumn("r", graph.version_range(col("spec"), zero_minor=False)), "asked")
    missing = asked.groupBy("dep").agg(F.sum("n").alias("n")).join(first.select(col("name").alias("dep")), "dep", "left_anti").select(*row("missing", col("dep"), none, none, none, none, col("n")))
    a, b = asked.alias("a"), asked.alias("b")
    meet = F.coalesce((col("a.r.low") < col("b.r.high")) & (col("b.r.low") < col("a.r.high")), F.lit(False))
    pairs = a.join(b, (col("a.dep") == col("b.dep")) & (col("a.spec") < col("b.spec")) & ~meet)
    clash = pairs.select(*row("conflict", col("a.dep"), col("a.module"), col("a.spec"), col("b.module"), col("b.spec"), col("a.n") * col("b.n")))
    alone = asked.where("r IS NULL AND n > 1").select(*row("conflict", col("dep"), col("module"), col("spec"), col("module"), col("spec"), col("n") * (col("n") - 1) / 2))
    there = asked.join(first.select(col("name").alias("dep"), "first_version"), "dep").withColumn("v", scalars.semver(col("first_version"))).where("v IS NOT NULL")
    inside = F.coalesce((col("r.low") <= col("v")) & (col("v") < col("r.high")), F.lit(False))
    unmet = there.where(~inside).select(*row("unmet", col("dep"), col("module"), col("spec"), col("dep"), F.concat(F.lit("="), col("first_version")), col("n")))
    return again.unionByName(missing).unionByName(clash).unionByName(alone).unionByName(unmet)


def install_order(modules: DataFrame, requires: DataFrame) -> DataFrame:
    """(name, level): modules of a level need lower levels only, so they install by level and name. Raises if anything is wrong or runs in a circle."""
    problem = module_problems(modules, requires).first()
    if problem:
        raise ValueError(f"not installable: {problem.asDict()}")
    nodes = modules.select(F.col("name").alias("id"))
    placed = graph.levels(nodes, requires.select(F.col("name").alias("src"), F.col("dep").alias("dst")))
    placed = stored(placed, "levels")
    if placed.count() < nodes.distinct().count():
        raise ValueError("not installable: modules need each other in a circle")
    return placed.withColumnRenamed("id", "name")


def registry_ranked(index: DataFrame, query: str) -> DataFrame:
    """Entries (name, maintainer, version, ...) with tier: 0 the name itself or no query, 1 within the name, 2 within the maintainer; newest versions first."""
    q, name = query.strip().lower(), F.lower("name")
    tier = F.lit(0) if not q else F.when(name == q, 0).when(name.contains(q), 1).when(F.lower("maintainer").contains(q), 2)
    rows = index.withColumn("tier", tier).where("tier IS NOT NULL").withColumn("_v", scalars.semver(F.col("version")))
    return rows.orderBy("tier", F.desc_nulls_last("_v"), "name").drop("_v")


def swapped(table: DataFrame, live: str, next_: str, mrr_live: float, mrr_next: float, tolerance: float = 0.0) -> DataFrame:
    """The table with its live and its next column exchanged; a second call takes it back. Refused if the next one ranks worse beyond the tolerance."""
    if mrr_next < mrr_live - tolerance:
        raise ValueError(f"refused: {mrr_next} is below {mrr_live} - {tolerance}")
    other = {live: next_, next_: live}
    return table.select(*[F.col(other.get(c, c)).alias(c) for c in table.columns])


def next_step(step: Column, chosen: Column, steps: list[str], always: set[str], phase_of: dict[str, str]) -> Column:
    """The first step after `step` that always runs, has no phase, or has one of the chosen phases (all if none is chosen); null at the end or for an unknown step."""
    wanted = F.transform(F.coalesce(chosen, F.array().cast("array<string>")), lambda p: F.upper(p))
    out = F.lit(None).cast("string")
    for i in range(len(steps) - 1):
        free = [s for s in steps[i + 1 :] if s in always or s not in phase_of]
        runs = F.filter(F.array(*map(F.lit, steps[i + 1 :])), lambda s: (F.size(wanted) == 0) | s.isin(free) | F.array_contains(wanted, F.coalesce(F.create_map(*[F.lit(x) for kv in phase_of.items() for x in kv])[s], F.lit(""))))  # noqa: B023
        out = F.when(step == steps[i], F.get(runs, 0)).otherwise(out)
    return out
