"""Keyed state with timers: retention, task registry, chat sessions and retry budgets over event streams.

Each processor keeps what its key needs and no more: event-time timers drop it when the watermark has passed. Rows of a
batch are taken in the order (ts, event_id); rows later than the watermark don't reach a processor.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from chronolex.sources.shared import new_folder

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR, DAY = 3_600_000, 86_400_000


@contextmanager
def _rocksdb(spark: SparkSession):
    """State variables and timers need the RocksDB state store; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def run(events: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, late: str = "1 hour") -> DataFrame:
    """Run ``processor`` over all of the stream ``events`` (ts is its time) and return its rows with a batch number."""
    spark = events.sparkSession
    root = new_folder(spark, "stateful")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{root}/out")

    timed = events.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    stream = timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "Update", "EventTime")
    with _rocksdb(spark):
        query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    return spark.read.schema(f"{schema}, batch int").parquet(f"{root}/out")


def ordered(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, str, float, str]]:
    """(ms, event_id, event_type, value, props) of a key's rows in this batch, in their order."""
    for part in rows:
        cut = part[["ms", "event_id", "event_type", "value", "props"]]
        yield from cut.itertuples(index=False, name=None)


class Retention(StatefulProcessor):
    """Turns of a conversation, each for ``keep`` milliseconds; a purge leaves an audit row and the parent's new figures.

    Out: (user_id, kind, turns, last_id, purged). ``parent`` rows carry what is kept, ``audit`` rows how many went.
    """

    schema = "user_id long, kind string, turns long, last_id long, purged long"

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "event_id long", "ms long")

    def _parent(self, key: tuple, kept: dict[int, int], purged: int | None = None) -> Iterator[pd.DataFrame]:
        last = max(kept.items(), key=lambda x: (x[1], x[0]))[0] if kept else None
        row = {"user_id": [key[0]], "kind": ["parent"], "turns": [len(kept)], "last_id": pd.array([last], "Int64"), "purged": [0]}
        yield pd.DataFrame(row)
        if purged:
            yield pd.DataFrame(row | {"kind": ["audit"], "purged": [purged]})

    def _all(self) -> dict[int, int]:
        return {k[0]: v[0] for k, v in self.turns.iterator()}

    def handleInputRows(self, key, rows, timerValues):
        for part in rows:
            for event, ms in zip(part["event_id"].tolist(), part["ms"].tolist(), strict=True):
                self.turns.updateValue((event,), (ms,))
        kept = self._all()
        self._wake(min(kept.values()) + self.keep)
        yield from self._parent(key, kept)

    def _wake(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, kept = timerValues.getCurrentWatermarkInMs(), self._all()
        gone = [event for event, ms in kept.items() if ms + self.keep <= now]
        for event in gone:
            self.turns.removeKey((event,))
            del kept[event]
        if kept:
            self.handle.registerTimer(min(kept.values()) + self.keep)
        yield from self._parent(key, kept, len(gone))

    def close(self) -> None:
        pass


class Registry(StatefulProcessor):
    """The active tasks of each owner: begun or touched last, not ended, and touched within ``idle`` milliseconds.

    A task is the ``k`` of an event's props, modulo ``tasks``; ``alive`` events begin or touch it, others end it. Out:
    (user_id, active, ended_idle): the active tasks in order, and how many have gone idle so far.
    """

    schema = "user_id long, active string, ended_idle long"

    def __init__(self, idle: int, tasks: int, alive: tuple[str, ...] = ("click", "view")):
        self.idle, self.tasks, self.alive = idle, tasks, alive

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getMapState("active", "task int", "ms long, event_id long, alive boolean")
        self.ended = handle.getValueState("ended", "n long")

    def _said(self, key: tuple) -> Iterator[pd.DataFrame]:
        names = sorted(k[0] for k, v in self.active.iterator() if v[2])
        yield pd.DataFrame({"user_id": [key[0]], "active": [",".join(map(str, names))], "ended_idle": [self.ended.get()[0] if self.ended.exists() else 0]})

    def handleInputRows(self, key, rows, timerValues):
        import json

        newest: dict[int, tuple[int, int, bool]] = {}
        for ms, event, kind, _, props in ordered(rows):
            task = json.loads(props)["k"] % self.tasks
            newest[task] = max(newest.get(task, (-1, -1, False)), (ms, event, kind in self.alive))
        for task, mark in newest.items():
            before = self.active.getValue((task,)) if self.active.containsKey((task,)) else None
            if before is None or tuple(before)[:2] < mark[:2]:
                self.active.updateValue((task,), mark)
                # ended tasks stay as long, so that a late event can't revive them
                self.handle.registerTimer(mark[0] + self.idle)
        yield from self._said(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, gone = timerValues.getCurrentWatermarkInMs(), 0
        for k, v in list(self.active.iterator()):
            if v[0] + self.idle <= now:
                self.active.removeKey(k)
                gone += v[2]
        if gone:
            self.ended.update(((self.ended.get()[0] if self.ended.exists() else 0) + gone,))
        yield from self._said(key)

    def close(self) -> None:
        pass


class ChatSession(StatefulProcessor):
    """pending from a question on; complete by an answer within ``patience`` milliseconds, error, or stopped.

    Kinds: view is a question, purchase an answer, error an error, signup a stop; others say nothing. A question that gets no
    answer in time is stopped by a timer, and an answer after that leaves it stopped. Out: (user_id, state, answered).
    """

    schema = "user_id long, state string, answered long"
    KINDS = {"view": "pending", "purchase": "complete", "error": "error", "signup": "stopped"}

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, since long, answered long")

    def _put(self, key: tuple, state: str, since: int, answered: int) -> pd.DataFrame:
        self.now.update((state, since, answered))
        return pd.DataFrame({"user_id": [key[0]], "state": [state], "answered": [answered]})

    def handleInputRows(self, key, rows, timerValues):
        state, since, answered = self.now.get() if self.now.exists() else ("idle", 0, 0)
        for ms, _, kind, *_ in sorted(r for r in ordered(rows) if r[2] in self.KINDS):
            if kind == "purchase":
                in_time = state == "pending" and ms - since <= self.patience
                state, answered = ("complete", answered + 1) if in_time else ("stopped" if state in ("pending", "stopped") else state, answered)
            else:
                state = self.KINDS[kind]
            since = ms
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if state == "pending":
            self.handle.registerTimer(since + self.patience + 1)
        yield self._put(key, state, since, answered)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state, since, answered = self.now.get()
        if state == "pending" and since + self.patience < timerValues.getCurrentWatermarkInMs():
            yield self._put(key, "stopped", since, answered)

    def close(self) -> None:
        pass


class RetryBudget(StatefulProcessor):
    """Attempts at one request (user and day) until one ends it: at most ``most``, each cut off at ``each`` seconds, ``overall`` in all.

    purchase is a success and signup a failure that isn't tried again; error, and whatever takes longer than ``each``, may be.
    What comes after the end is ignored. A request is dropped ``forget`` milliseconds after its last attempt. Out: (user_id, day,
    attempts, elapsed, outcome).
    """

    schema = "user_id long, day date, attempts long, elapsed double, outcome string"

    def __init__(self, most: int = 3, each: float = 55.0, overall: float = 170.0, forget: int = 2 * DAY):
        self.most, self.each, self.overall, self.forget = most, each, overall, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.request = handle.getValueState("request", "attempts long, elapsed double, outcome string")

    def after(self, now: tuple[int, float, str], kind: str, seconds: float) -> tuple[int, float, str]:
        """The request after one more attempt."""
        attempts, elapsed, outcome = now
        if outcome != "open":
            return now
        attempts, elapsed = attempts + 1, elapsed + min(seconds, self.each)
        if kind == "purchase" and seconds <= self.each:
            return attempts, elapsed, "success"
        if kind == "signup" and seconds <= self.each:
            return attempts, elapsed, "refused"
        if attempts >= self.most:
            return attempts, elapsed, "exhausted"
        return attempts, elapsed, "too long" if elapsed >= self.overall else "open"

    def handleInputRows(self, key, rows, timerValues):
        now, last = self.request.get() if self.request.exists() else (0, 0.0, "open"), 0
        for ms, _, kind, value, _ in sorted(r for r in ordered(rows) if r[2] in ("error", "signup", "purchase")):
            now, last = self.after(tuple(now), kind, value), ms
        if last:
            self.request.update(tuple(now))
            self.handle.registerTimer(last + self.forget)
            yield pd.DataFrame({"user_id": [key[0]], "day": [key[1]], "attempts": [now[0]], "elapsed": [now[1]], "outcome": [now[2]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not list(self.handle.listTimers()):
            self.request.clear()
        yield from ()

    def close(self) -> None:
        pass
