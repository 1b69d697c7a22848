"""Running sums over keys of any size, and what is built on them: pruned conversations, batches cut by size.

A window over a key puts all its rows into one task. Here rows are range-partitioned by key and order, summed up within
each partition, and a key's partitions are summed up beside each other: as many rows a key as it has partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.storage import small, stored


def running_sums(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """rows with running sums (inclusive) of columns: sums has new names and the columns. Nulls in those count as 0; null keys are keys.

    The order must be total within a key, or rows that tie are summed up in any order. rows is stored.
    """
    by = [F.col(k) for k in keys]
    parts = stored(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_part", F.spark_partition_id()), "running")
    value = {name: F.coalesce(F.col(c), F.lit(0)) for name, c in sums.items()}
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = parts.groupBy("_part", *keys).agg(*[F.sum(v).alias(f"_{name}") for name, v in value.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums])
    # Only a key that goes on from an earlier partition has something before: one key a partition.
    offsets = stored(offsets.where(" OR ".join(f"_{name} <> 0" for name in sums)), "offsets")
    summed = parts.select("*", *[F.sum(v).over(within).alias(name) for name, v in value.items()])
    same = summed["_part"] == offsets["_part"]
    for i, k in enumerate(keys):
        same &= summed[k].eqNullSafe(offsets[f"_k{i}"])
    out = summed.join(small(offsets), same, "left")
    return out.select(*[summed[c] for c in rows.columns], *[(F.col(name) + F.coalesce(F.col(f"_{name}"), F.lit(0))).alias(name) for name in sums])


def pruned_turns(turns: DataFrame, budget: int, key: str = "conv_id", order: str = "turn", full: str = "full", bare: str = "bare") -> DataFrame:
    """The newest turns that fit a budget of tokens: rows with cost, stripped (tool blocks left out) and spent (with all newer turns).

    From the newest turn on, a turn costs `full` tokens until the turns before have spent more than half of the budget; later
    ones cost `bare` tokens, without tool blocks. The first turn that would go beyond the budget ends it. What was spent before a turn of the first
    kind is the sum of full costs, so a running sum tells the kind; the second running sum is over the costs themselves.
    """
    first = running_sums(turns, [key], [F.desc(order)], {"_all": full})
    late = F.col("_all") - F.coalesce(F.col(full), F.lit(0)) > budget / 2
    priced = first.withColumn("stripped", late).withColumn("cost", F.coalesce(F.when(late, F.col(bare)).otherwise(F.col(full)), F.lit(0))).drop("_all")
    return running_sums(priced, [key], [F.desc(order)], {"spent": "cost"}).where(F.col("spent") <= budget)


def compaction_fallback(turns: DataFrame, phase: str, key: str = "conv_id", order: str = "turn", last: int = 3) -> DataFrame:
    """One row per conversation (key, role, text): original_intent (500 characters of the first user turn, or a fixed text), completed_work (200 characters of each of the last assistant turns that aren't blank, oldest first), next_actions."""
    said = lambda role: F.col("role") == role
    text = F.coalesce("text", F.lit(""))
    intent = F.min(F.when(said("user"), F.struct(F.col(order).alias("at"), F.substring(text, 1, 500).alias("text"))))
    place = F.row_number().over(Window.partitionBy(key, "role").orderBy(F.desc(order)))
    work = turns.where(said("assistant")).withColumn("_place", place).where(F.col("_place") <= last).where(F.trim(F.substring(text, 1, 200)) != "")
    work = work.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.concat(F.lit(f"{phase}: "), F.substring(text, 1, 200)).alias("text")))).alias("_work"))
    rows = turns.groupBy(key).agg(F.coalesce(intent["text"], F.lit("Unknown intent")).alias("original_intent")).join(work, key, "left")
    return rows.select(key, "original_intent", F.coalesce(F.transform("_work", lambda w: w["text"]), F.array().cast("array<string>")).alias("completed_work"), F.array(F.lit(f"Continue {phase}-phase execution")).alias("next_actions"))


def batches(rows: DataFrame, most_rows: int, most_tokens: int, id_col: str = "id", tokens: str = "tokens") -> DataFrame:
    """rows with batch (from 0, in the order of ids): each has most_rows rows and most_tokens tokens at most, or one larger row alone.

    Rows are cut at multiples of half of both bounds: a row belongs to the pair of halves in which its running sums begin, and one with
    more than half of the tokens is a batch of its own. So every batch is known from sums alone, without walking through the rows; batches may be smaller
    than the bounds allow, but never larger, except for rows that are larger themselves.
    """
    half_rows, half_tokens = max(1, most_rows // 2), max(1, most_tokens // 2)
    keyed = rows.withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1))
    summed = running_sums(keyed, ["_all"], [F.col(id_col)], {"_rows": "_one", "_tokens": tokens})
    cut = F.struct(F.floor((F.col("_rows") - 1) / half_rows).alias("r"), F.floor((F.col("_tokens") - F.coalesce(F.col(tokens), F.lit(0))) / half_tokens).alias("t"), (F.coalesce(F.col(tokens), F.lit(0)) > half_tokens).alias("large"))
    cuts = summed.select(cut.alias("c")).distinct()
    numbered = stored(cuts.select("c", (F.row_number().over(Window.orderBy("c")) - 1).alias("batch")), "cuts")  # a row per batch
    return summed.withColumn("_c", cut).join(small(numbered), F.col("_c") == F.col("c")).drop("_all", "_one", "_rows", "_tokens", "_c", "c")
