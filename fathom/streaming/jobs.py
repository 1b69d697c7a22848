"""Streaming forms of the store's watchdogs and logs. Each takes and returns a streaming (or batch) DataFrame."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ENVELOPE = "event_id long, ts timestamp, key string, event_type string, value double"


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and event type; events later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "key").agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_each(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Without repetitions of the keys within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


class Limiter(StatefulProcessor):
    """Lets `most` events of a key through in any `seconds`; refused ones don't count. The state is the times let through."""

    def __init__(self, most: int = 60, seconds: int = 60):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "at double")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 (names that Spark asks for)
        past = [t for (t,) in self.times.get()]
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        allowed = []
        for at in frame["ts"].map(lambda t: t.timestamp()):
            past = [t for t in past if t > at - self.seconds]
            allowed.append(len(past) < self.most)
            if allowed[-1]:
                past.append(at)
        self.times.put([(t,) for t in past])
        yield pd.DataFrame({"event_id": frame["event_id"], "key": key[0], "allowed": allowed})

    def close(self) -> None:
        pass


def rate_limited(events: DataFrame, most: int = 60, seconds: int = 60) -> DataFrame:
    """Exact sliding-window limit by key: (event_id, key, allowed)."""
    return events.groupBy("key").transformWithStateInPandas(statefulProcessor=Limiter(most, seconds), outputStructType="event_id long, key string, allowed boolean", outputMode="append", timeMode="none")


def limited_batch(events: DataFrame, most: int = 60, seconds: int = 60) -> DataFrame:
    """The same over a finished log: a key's events come in order of time, batch by batch, and only the times let through are held."""

    def run(frames):
        key, past = None, []
        for frame in frames:
            allowed = []
            for k, at in zip(frame["key"], frame["ts"].map(lambda t: t.timestamp()), strict=True):
                if k != key:
                    key, past = k, []
                past = [t for t in past if t > at - seconds]
                allowed.append(len(past) < most)
                if allowed[-1]:
                    past.append(at)
            yield pd.DataFrame({"event_id": frame["event_id"], "key": frame["key"], "allowed": allowed})

    ordered = events.select("event_id", "key", "ts").repartition("key").sortWithinPartitions("key", "ts", "event_id")
    return ordered.mapInPandas(run, "event_id long, key string, allowed boolean")


def last_n(events: DataFrame, n: int) -> DataFrame:
    """The ring buffer of a batch: its n newest events."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


EXEMPT = "WATCHDOG_EXEMPT"


def stale_claims(tasks: DataFrame, now, hours: int = 48) -> DataFrame:
    """Tasks in progress that were claimed too long ago, as the watchdog sends them back. Those whose notes (text, if there is such a column) say EXEMPT stay."""
    late = (F.col("status") == "in_progress") & (F.col("claimed_at") < F.lit(now) - F.make_dt_interval(hours=F.lit(hours)))
    if "notes" in tasks.columns:
        late &= ~F.coalesce(F.col("notes").contains(EXEMPT), F.lit(False))
    return tasks.where(late).withColumn("status", F.lit("pending"))


def run_available(stream: DataFrame, each, checkpoint: str):
    """Works off all that is there with foreachBatch, exactly once per batch id, and stops."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def when_over(count, action, threshold: int = 500, cooldown: float = 300.0, clock=time.monotonic):
    """A function for foreachBatch: action(batch) if count() has reached the threshold and the last action is `cooldown` seconds past.

    Off unless a stream is started with it. An action that fails ends the stream, and starts no cooldown.
    """
    last = None

    def each(batch: DataFrame, batch_id: int) -> None:
        nonlocal last
        if (last is None or clock() - last >= cooldown) and count() >= threshold:
            action(batch)
            last = clock()

    return each
