"""Stateful streams by transformWithState: the store's write path, its watchdog, retention and ring buffer.

All need a state store with column families (RocksDB; `with_rocksdb` sets it). Rows of a key that come in one batch are worked off in
their own order, so results don't depend on where batches are cut, as long as a batch has no row that belongs before one of an earlier batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fathom.functions import text

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000
EXEMPT = "WATCHDOG_EXEMPT"


def with_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> Iterable:
    """The rows that a key has in this batch, in their own order."""
    frames = [f for f in rows if len(f)]
    return pd.concat(frames).sort_values(by, kind="stable").itertuples(index=False) if frames else ()


# ---------------------------------------------------------------- the write path

#: What happens with a write that is near to rows without being a duplicate: its text and those rows (id, similarity), nearest first, to (op, id).
Classify = Callable[[str, list[tuple[int, float]]], tuple[str, int | None]]


def adds(written: str, near: list[tuple[int, float]]) -> tuple[str, int | None]:
    """The classifier without a model: whatever is no duplicate is added."""
    return "ADD", None


class Writer(StatefulProcessor):
    """Writes of a project, one after another: a duplicate of a valid row is skipped, others are added, supersede a row or delete it.

    State: the trigram hashes of each valid row, and for each of the first hashes of a row (in the order of the hashes, so many that two sets that are `least`
    alike share one of theirs) the rows that have it; a write reads the lists of its own first hashes, never all rows.
    """

    def __init__(self, duplicate: float, least: float, candidates: int, classify: Classify):
        self.duplicate, self.least, self.candidates, self.classify = duplicate, least, candidates, classify

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sets = handle.getMapState("sets", "id long", "grams array<long>")
        self.listed = handle.getMapState("listed", "gram long", "ids array<long>")

    def _first(self, grams: list[int]) -> list[int]:
        n = len(grams)
        return grams[: n - -(-int(n * self.least * 1_000_000) // 1_000_000) + 1]  # n - ceil(n * least) + 1, or one more

    def _near(self, grams: list[int]) -> list[tuple[int, float]]:
        ids = {i for g in self._first(grams) if self.listed.containsKey((g,)) for i in self.listed.getValue((g,))[0]}
        mine, out = set(grams), []
        for i in ids:
            if self.sets.containsKey((i,)):
                other = self.sets.getValue((i,))[0]
                common = len(mine.intersection(other))
                if common and (alike := common / (len(mine) + len(other) - common)) >= self.least:
                    out.append((i, alike))
        return sorted(out, key=lambda r: (-r[1], r[0]))[: self.candidates]

    def _invalidate(self, i: int | None) -> None:
        """The row counts no more; lists still name it and are passed over."""
        if i is not None and self.sets.containsKey((i,)):
            self.sets.removeKey((i,))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 (names that Spark asks for)
        out = []
        for r in in_order(rows, ["id"]):
            grams = sorted(r.grams)
            near = self._near(grams)
            if near and near[0][1] >= self.duplicate:
                out.append((r.id, "SKIP", near[0][0], round(near[0][1], 4)))
                continue
            op, target = self.classify(r.text, near) if near else ("ADD", None)
            if op == "NOOP":
                out.append((r.id, op, near[0][0] if target is None else target, None))
                continue
            if op in ("UPDATE", "DELETE"):
                self._invalidate(target)
            out.append((r.id, op, target, None))
            if op != "DELETE":
                self.sets.updateValue((r.id,), (grams,))
                for g in self._first(grams):
                    had = self.listed.getValue((g,))[0] if self.listed.containsKey((g,)) else []
                    self.listed.updateValue((g,), ([*had, r.id],))
        if out:
            frame = pd.DataFrame(out, columns=["id", "op", "other_id", "similarity"]).astype({"other_id": "Int64", "similarity": "float64"})
            frame.insert(0, "project", key[0])
            yield frame

    def close(self) -> None:
        pass


def written(writes: DataFrame, duplicate: float = 0.6, least: float = 0.3, candidates: int = 3, classify: Classify = adds) -> DataFrame:
    """(project, id, op, other_id, similarity) of writes (project, id, text), in the order of their ids within a project; a null project is one too.

    op: ADD, SKIP (a duplicate of other_id), NOOP, UPDATE (supersedes other_id, which is invalid from then on) or DELETE (of other_id; nothing is added).
    Similarity is that of the sets of trigrams. Texts without any are always added.
    """
    grams = F.transform(text.trigrams(F.coalesce("text", F.lit(""))), lambda t: F.xxhash64(t))
    rows = writes.select(F.coalesce("project", F.lit("")).alias("project"), F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.array_distinct(grams).alias("grams"))
    processor = Writer(duplicate, least, candidates, classify)
    return rows.groupBy("project").transformWithStateInPandas(processor, "project string, id long, op string, other_id long, similarity double", "append", "none")


def versions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, valid_from, invalid_at) of all rows that writes added: rows (id, at) and decisions as written() gives them. A row ends when one that supersedes or deletes it comes."""
    ends = decisions.where("op IN ('UPDATE', 'DELETE')").join(rows.select("id", F.col("at").alias("end")), "id").groupBy(F.col("other_id").alias("id")).agg(F.min("end").alias("invalid_at"))
    return decisions.where("op IN ('ADD', 'UPDATE')").select("id").join(rows.select("id", F.col("at").alias("valid_from")), "id").join(ends, "id", "left")


# ---------------------------------------------------------------- timers and bounded state


class Watchdog(StatefulProcessor):
    """Sends a task back to pending if it stays in progress too long: a timer for each claim, taken away by any other state."""

    def __init__(self, hours: float):
        self.wait = int(hours * HOUR_MS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.claim = handle, handle.getValueState("claim", "at long, exempt boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for r in in_order(rows, ["at_ms", "seq"]):
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if r.status == "in_progress":
                self.claim.update((int(r.at_ms), bool(r.exempt)))
                self.handle.registerTimer(int(r.at_ms) + self.wait)
            else:
                self.claim.clear()
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.claim.exists():
            at, exempt = self.claim.get()
            self.claim.clear()
            if not exempt:
                yield pd.DataFrame({"task_id": [key[0]], "status": ["pending"], "claimed_ms": [at], "reverted_ms": [expiredTimerInfo.getExpiryTimeInMs()]})

    def close(self) -> None:
        pass


def reverted_claims(moves: DataFrame, hours: float = 48, late: str = "0 seconds") -> DataFrame:
    """(task_id, status, claimed_ms, reverted_ms) of tasks that no move takes out of progress within `hours`, when the watermark passes that.

    moves: task_id, ts, seq (their order where times are equal), status, notes; notes with EXEMPT keep a task where it is.
    """
    exempt = F.coalesce(F.col("notes").contains(EXEMPT), F.lit(False))
    rows = moves.withWatermark("ts", late).select("task_id", "ts", F.col("seq").alias("seq"), "status", F.unix_millis("ts").alias("at_ms"), exempt.alias("exempt"))
    return rows.groupBy("task_id").transformWithStateInPandas(Watchdog(hours), "task_id long, status string, claimed_ms long, reverted_ms long", "append", "eventTime")


class Retention(StatefulProcessor):
    """Tells when a row has outlived the days of its tier; writing or using it anew starts them again."""

    def __init__(self, days: dict[str, int], default: int):
        self.days, self.default = days, default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.row = handle, handle.getValueState("row", "source string, at long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for r in in_order(rows, ["at_ms"]):
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.row.update((r.source, int(r.at_ms)))
            self.handle.registerTimer(int(r.at_ms) + self.days.get(r.source, self.default) * 24 * HOUR_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.row.exists():
            source, at = self.row.get()
            self.row.clear()
            yield pd.DataFrame({"id": [key[0]], "source": [source], "last_ms": [at], "expired_ms": [expiredTimerInfo.getExpiryTimeInMs()]})

    def close(self) -> None:
        pass


def expired_rows(uses: DataFrame, days: dict[str, int], default: int = 180, late: str = "0 seconds") -> DataFrame:
    """(id, source, last_ms, expired_ms) of rows (id, ts, source) that nothing has touched for the days of their source, when the watermark passes that."""
    rows = uses.withWatermark("ts", late).select("id", "ts", F.coalesce("source", F.lit("")).alias("source"), F.unix_millis("ts").alias("at_ms"))
    return rows.groupBy("id").transformWithStateInPandas(Retention(days, default), "id long, source string, last_ms long, expired_ms long", "append", "eventTime")


class Ring(StatefulProcessor):
    """Keeps a key's n newest events; nothing else is in the state."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "at_ms long, event_id long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        new = [(int(r.at_ms), int(r.event_id)) for r in in_order(rows, ["at_ms", "event_id"])]
        kept = sorted([*((int(a), int(i)) for a, i in self.kept.get()), *new])[-self.n :]
        self.kept.put(kept)
        yield pd.DataFrame({"key": [key[0]] * len(kept), "event_id": [i for _, i in kept], "place": range(len(kept), 0, -1)}).astype({"event_id": "int64", "place": "int64"})

    def close(self) -> None:
        pass


def ring_buffer(events: DataFrame, n: int) -> DataFrame:
    """(key, event_id, place): after each batch, the n newest events (ts, event_id) of the keys that it has; place 1 is the newest."""
    rows = events.select(F.coalesce("key", F.lit("")).alias("key"), "event_id", F.unix_millis("ts").alias("at_ms"))
    return rows.groupBy("key").transformWithStateInPandas(Ring(n), "key string, event_id long, place long", "update", "none")
