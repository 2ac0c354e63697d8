"""Timers by key over a stream: retries with a back-off that starts anew on progress, and due intervals. The clock is the events' own time, so a replay gives the same rows.

Both keep a few numbers for each key in the stream's state store and one timer at a time; a timer goes off when the watermark passes it. Events of a key that come in one batch are taken in order of time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Attempts without progress after which a transfer is given up, and the first back-off.
FRUITLESS, FIRST_MS = 5, 1000
HOUR_MS = 3_600_000

# Times are milliseconds since the epoch inside, so no time zone plays a part.
RETRY = "key string, ms long, action string, fruitless int, due long"
DUE = "key string, ms long, action string"


def _rows(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    frames = list(rows)
    return pd.concat(frames).sort_values(["ms", "ord"], kind="stable") if frames else pd.DataFrame()


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split(" ")[0] for f in schema.split(", ")])


class Retries(StatefulProcessor):
    """State: attempts without progress, bytes when the last one began, and when the next is due."""

    def __init__(self, most: int = FRUITLESS, first_ms: int = FIRST_MS):
        self.most, self.first_ms = most, first_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("retry", "fruitless int, bytes long, due long")

    def _disarm(self) -> None:
        if self.state.exists() and (due := self.state.get()[2]) >= 0:
            self.handle.deleteTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for e in _rows(rows).itertuples():
            fruitless, held, _ = self.state.get() if self.state.exists() else (0, 0, -1)
            now = int(e.ms)
            self._disarm()
            if e.kind != "failed":  # done, or cancelled: never retried
                self.state.clear()
                out.append((key[0], now, "done" if e.kind == "done" else "cancelled", fruitless, None))
                continue
            fruitless = 0 if e.bytes > held else fruitless + 1
            if fruitless >= self.most:
                self.state.clear()
                out.append((key[0], now, "give-up", fruitless, None))
                continue
            due = now + self.first_ms * 2**fruitless
            self.state.update((fruitless, int(e.bytes), due))
            self.handle.registerTimer(due)
            out.append((key[0], now, "wait", fruitless, due))
        yield _frame(out, RETRY).astype({"due": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fruitless, held, due = self.state.get()
        self.state.update((fruitless, held, -1))
        yield _frame([(key[0], due, "retry", fruitless, None)], RETRY).astype({"due": "Int64"})

    def close(self) -> None:
        pass


class Intervals(StatefulProcessor):
    """State: hours of the interval (0: off), when the last run was over, and when the timer goes off."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("interval", "hours double, last long, due long")

    def _arm(self, hours: float, last: int, now: int) -> None:
        due = now + int(hours * HOUR_MS) if hours > 0 else -1
        self.state.update((hours, last, due))
        if due >= 0:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """``settings`` sets the hours (null or none: off), ``ran`` is a run that is over; both arm the timer anew."""
        for e in _rows(rows).itertuples():
            hours, last, due = self.state.get() if self.state.exists() else (0.0, -1, -1)
            if due >= 0:
                self.handle.deleteTimer(due)
            if e.kind == "settings":
                hours = float(e.hours) if e.hours is not None and e.hours == e.hours else 0.0
            elif e.kind == "ran":
                last = int(e.ms)
            self._arm(hours, last, int(e.ms))
        yield _frame([], DUE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        hours, last, due = self.state.get()
        self._arm(hours, last, due)
        if last < 0 or due - last >= hours * HOUR_MS:
            yield _frame([(key[0], due, "due")], DUE)

    def close(self) -> None:
        pass


def with_timers(spark: SparkSession) -> None:
    """Timers need this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def retries(events: DataFrame, late: str = "0 seconds", most: int = FRUITLESS, first_ms: int = FIRST_MS) -> DataFrame:
    """(key, at, action, fruitless, due) of a stream of attempts (key, at, ord, kind failed | done | cancelled, bytes on disk): ``wait`` with when the next attempt is due, ``retry`` when it is, ``give-up``,
    ``done``, ``cancelled``."""
    with_timers(events.sparkSession)
    keyed = events.withColumn("ms", F.unix_millis("at")).withWatermark("at", late).groupBy("key")
    out = keyed.transformWithStateInPandas(Retries(most, first_ms), RETRY, "Append", "EventTime")
    return out.select("key", F.timestamp_millis("ms").alias("at"), "action", "fruitless", F.timestamp_millis("due").alias("due"))


def due_runs(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(key, at, action) of a stream of (key, at, ord, kind settings | ran, hours): when a run is due."""
    with_timers(events.sparkSession)
    keyed = events.withColumn("ms", F.unix_millis("at")).withWatermark("at", late).groupBy("key")
    return keyed.transformWithStateInPandas(Intervals(), DUE, "Append", "EventTime").select("key", F.timestamp_millis("ms").alias("at"), "action")
