"""Calibration of complexity scores from finished tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS, RATE, L2 = 50, 0.05, 0.01


def logistic(x: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = RATE, l2: float = L2) -> np.ndarray:
    """Weights and bias by plain gradient descent on features divided by their maximum."""
    x = np.column_stack([x / np.maximum(np.abs(x).max(axis=0), 1e-12), np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - y) / len(y)
        g[:-1] += l2 * w[:-1]
        w -= rate * g
    return w


def calibrated(completions: DataFrame, group: str, features: list[str], label: str) -> DataFrame:
    """(group, n, failure_probability, adjustment) of each group of finished tasks, each fitted within one task; +10 if failures are likely, else -5. Groups are the k nearest of a task, so they are small."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame[features].to_numpy(dtype=float), frame[label].to_numpy(dtype=float)
        w = logistic(x, y)
        p = float(np.mean(1 / (1 + np.exp(-(np.column_stack([x / np.maximum(np.abs(x).max(axis=0), 1e-12), np.ones(len(x))]) @ w)))))
        return pd.DataFrame({group: [frame[group].iloc[0]], "n": [len(frame)], "failure_probability": [p], "adjustment": [10 if p > 0.5 else -5]})

    kind = completions.schema[group].dataType.simpleString()
    return completions.groupBy(group).applyInPandas(fit, f"{group} {kind}, n long, failure_probability double, adjustment int")


def escalated(score: Column, triggers: list[Column], done: Column) -> Column:
    """20 more for each trigger that fires, 100 at most; after two escalations the score stays: (score, fired, cap_hit)."""
    fired = sum((F.when(t, 1).otherwise(0) for t in triggers), F.lit(0))
    capped = done >= 2
    return F.struct(F.when(capped, score).otherwise(F.least(F.lit(100), score + 20 * fired)).alias("score"), fired.alias("fired"), (capped & (fired > 0)).alias("cap_hit"))


def phases(score: Column, buckets: list[tuple[int, str]]) -> Column:
    """The phases of the first bucket (most, phases) that holds the score."""
    out = F
    for most, names in buckets[:-1]:
        out = out.when(score <= most, names)
    return out.otherwise(buckets[-1][1])


#: A task is compared with so many completions; with fewer, or less alike ones on average, its score moves up to the next bucket.
NEIGHBOURS, LEAST_NEIGHBOURS, LEAST_SIMILARITY, LEAST_COMPLETIONS = 20, 3, 0.5, 10
SURE, UNSURE, DOWN, UP = 0.7, 0.3, -5, 10


def batched_probabilities(x: np.ndarray, y: np.ndarray, n: np.ndarray, target: np.ndarray, steps: int = STEPS, rate: float = RATE, l2: float = L2) -> np.ndarray:
    """For each task, the probability that it passes: x (tasks, neighbours, features) and y (tasks, neighbours), of which the first n rows count, are fitted by gradient descent, all tasks at once."""
    live = np.arange(x.shape[1])[None, :] < n[:, None]
    x = np.where(live[:, :, None], x, 0.0)
    most = np.where(live[:, :, None], x, -np.inf).max(axis=1)
    most[most == 0] = 1.0
    x, count = x / most[:, None, :], n[:, None].astype(np.float64)
    w = np.zeros((len(x), x.shape[2]))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.einsum("tnf,tf->tn", x, w), -500, 500)))
        error = np.where(live, p - y, 0.0)
        w -= rate * (np.einsum("tnf,tn->tf", x, error) / count + l2 / count * w)
    return 1 / (1 + np.exp(-np.clip((target / most * w).sum(axis=1), -500, 500)))


def calibrated_scores(tasks: DataFrame, completions: DataFrame, near: DataFrame, buckets: list[int], k: int = NEIGHBOURS, least_similarity: float = LEAST_SIMILARITY, least_completions: int = LEAST_COMPLETIONS) -> DataFrame:
    """(query_id, calibrated_score, confidence, neighbour_count, cold_start, adjustment) of tasks (query_id, raw_score, features) by completions (id, features, passed).

    near: (query_id, id, similarity, rank), as vectors.search gives it, k for each task at most. Few completions in all, few neighbours or distant ones
    mean a cold start: the score moves to the begin of the next bucket (buckets: the largest score of each). Else the neighbours' outcomes are fitted on their features: +10 where tasks like this fail, -5 where they pass.
    All tasks of a batch are fitted together, whatever task they are of; no group is gathered in pandas. Null features count as 0.
    """
    numbers = lambda c: F.transform(F.col(c), lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    total = completions.count()
    rows = near.where(F.col("rank") <= k).join(completions.select("id", numbers("features").alias("x"), F.coalesce(F.col("passed").cast("double"), F.lit(0.0)).alias("y")), "id")
    sets = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("similarity").alias("mean"), F.array_sort(F.collect_list(F.struct("rank", "x", "y"))).alias("rows"))  # k rows at most
    joined = tasks.select("query_id", F.col("raw_score").cast("int").alias("raw_score"), numbers("features").alias("target")).join(sets, "query_id", "left")
    cold = F.lit(total < least_completions) | (F.coalesce("n", F.lit(0)) < LEAST_NEIGHBOURS) | (F.coalesce("mean", F.lit(0.0)) < least_similarity)
    flat = joined.select("query_id", "raw_score", F.coalesce("n", F.lit(0)).cast("int").alias("n"), cold.alias("cold"), "target", F.flatten(F.transform("rows", lambda r: r["x"])).alias("x"), F.transform("rows", lambda r: r["y"]).alias("y"))

    def fit(batches):
        for b in batches:
            out = np.zeros(b.num_rows)
            warm = np.flatnonzero(~b.column("cold").to_numpy(zero_copy_only=False))
            for a in range(0, len(warm), 4096):
                some = b.take(pa.array(warm[a : a + 4096]))
                n = some.column("n").to_numpy()
                target = np.array(some.column("target").to_pylist(), dtype=np.float64)
                x, y = np.zeros((len(n), int(n.max()), target.shape[1])), np.zeros((len(n), int(n.max())))
                at, place = np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(m) for m in n])
                x[at, place] = some.column("x").flatten().to_numpy().reshape(-1, target.shape[1])
                y[at, place] = some.column("y").flatten().to_numpy()
                out[warm[a : a + 4096]] = batched_probabilities(x, y, n, target)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("query_id", "raw_score", "n", "cold")), pa.array(out)], names=["query_id", "raw_score", "neighbour_count", "cold_start", "confidence"])

    fitted = flat.mapInArrow(fit, f"query_id {tasks.schema['query_id'].dataType.simpleString()}, raw_score int, neighbour_count int, cold_start boolean, confidence double")
    shifted = F.col("raw_score")
    for most in reversed(buckets[:-1]):
        shifted = F.when(F.col("raw_score") <= most, F.lit(most + 1)).otherwise(shifted)
    moved = F.when(F.col("confidence") > SURE, F.greatest(F.col("raw_score") + DOWN, F.lit(0))).when(F.col("confidence") < UNSURE, F.least(F.col("raw_score") + UP, F.lit(100))).otherwise(F.col("raw_score"))
    score = F.when(F.col("cold_start"), shifted).otherwise(moved).cast("int")
    return fitted.select("query_id", score.alias("calibrated_score"), "confidence", "neighbour_count", "cold_start", (score - F.col("raw_score")).cast("int").alias("adjustment"))
