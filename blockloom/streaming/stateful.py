"""Keyed state on streams in event time: debounced alerts and lock-outs.

Rows wait in a list per key until the watermark has passed them, and are then walked in order of their times (and
ids), so the result depends neither on how rows are split into micro-batches nor on the order in which they
arrive; only rows later than the watermark's delay are lost. One event-time timer per key wakes it. What a key
holds is the rows of the delay and one or two numbers, and the numbers go once they can no longer matter.

Rows wait while no later row moves the watermark. `heartbeat` marks rows that only do that, as a source without
alerts sends them now and then, or once at its end. Keyed state is one task per key and micro-batch; for one-off
runs over history use the batch operators, which split keys of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from blockloom.streaming.streams import WATERMARK

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """Keyed state below needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _InOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed them, then hands them on in order.

    `fields` are the columns a row waits with, its time in microseconds first.
    """

    fields = "at long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", self.fields)
        self._alarm = handle.getValueState("alarm", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [field.split()[0] for field in self.fields.split(",")]
        for frame in rows:
            arrived = frame.loc[~frame["beat"], names]
            if len(arrived):
                self._waiting.appendList([tuple(row) for row in arrived.astype(object).itertuples(index=False)])
                self._wake(int(arrived["at"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(row) for row in self._waiting.get()) if self._waiting.exists() else []
        due = [row for row in rows if row[0] <= passed]
        rest = rows[len(due) :]
        self._alarm.clear()
        if rest:
            self._waiting.put(rest)
            self._wake(rest[0][0])
        elif due:
            self._waiting.clear()
        out = self.walk(key[0], due)
        if not rest:
            until = self.idle(passed)
            if until is not None:
                self._wake(until)
        if out is not None:
            yield out

    def _wake(self, at: int) -> None:
        """Set the key's one timer to a time, unless it is set to an earlier one."""
        ms = at // 1000 + 1
        if self._alarm.exists():
            (before,) = self._alarm.get()
            if before <= ms:
                return
            self._handle.deleteTimer(before)
        self._handle.registerTimer(ms)
        self._alarm.update((ms,))

    def walk(self, key, due: list[tuple]) -> pd.DataFrame | None:
        """Use rows in order."""
        raise NotImplementedError

    def idle(self, passed: int) -> int | None:
        """Called when no row waits: forget what no longer matters, or name the time from which it will not."""
        return None

    def close(self) -> None:
        pass


class _Debounce(_InOrder):
    def __init__(self, micros: int):
        self._micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._last = handle.getValueState("last", "at long")

    def walk(self, key, due):
        last = self._last.get()[0] if self._last.exists() else None
        fired = []
        for (at,) in due:
            if last is None or at - last >= self._micros:
                last = at
                fired.append(at)
        if not fired:
            return None
        self._last.update((last,))
        return pd.DataFrame({"key": [key] * len(fired), "at": fired})

    def idle(self, passed):
        if not self._last.exists():
            return None
        until = self._last.get()[0] + self._micros
        if passed < until:
            return until
        self._last.clear()  # whatever comes now fires
        return None


def debounce(stream: DataFrame, key: str, ts: str, seconds: int = 10, delay: str = WATERMARK, heartbeat: Column | None = None) -> DataFrame:
    """Alerts that fire at least `seconds` after the last one of their key that fired."""
    use_rocksdb(stream.sparkSession)
    out = _keyed(stream, key, ts, delay, heartbeat).transformWithStateInPandas(
        statefulProcessor=_Debounce(seconds * 1_000_000),
        outputStructType="key string, at long",
        outputMode="Append",
        timeMode="EventTime",
    )
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias(ts))


def _keyed(stream: DataFrame, key: str, ts: str, delay: str, heartbeat: Column | None, **more: Column):
    """The columns that the state needs, with their watermark, grouped by key as text."""
    beat = F.lit(False) if heartbeat is None else F.coalesce(heartbeat, F.lit(False))
    timed = stream.select(
        F.col(key).cast("string").alias("key"),
        F.col(ts).cast("timestamp").alias("ts"),
        beat.alias("beat"),
        *[column.alias(name) for name, column in more.items()],
    )
    return timed.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts")).groupBy("key")


class _Lockout(_InOrder):
    fields = "at long, event_id long, failed boolean"

    def __init__(self, limit: int, micros: int, forget: int | None):
        self._limit, self._micros, self._forget = limit, micros, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._streak = handle.getValueState("streak", "failures long, at long")

    def walk(self, key, due):
        streak, last = self._streak.get() if self._streak.exists() else (0, None)
        out = []
        for at, event_id, failed in due:
            if self._forget is not None and last is not None and at - last > self._forget:
                streak = 0
            streak, last = streak + 1 if failed else 0, at
            locked = streak >= self._limit
            out.append((key, event_id, streak, locked, at + self._micros if locked else None))
        if not out:
            return None
        if streak:
            self._streak.update((streak, last))
        else:
            self._streak.clear()
        return pd.DataFrame(out, columns=["key", "event_id", "failures", "locked", "until"]).astype({"until": "Int64"})

    def idle(self, passed):
        if self._forget is None or not self._streak.exists():
            return None
        until = self._streak.get()[1] + self._forget
        if passed <= until:
            return until + 1
        self._streak.clear()
        return None


def lockout(
    stream: DataFrame,
    user: str,
    ts: str,
    failed: Column,
    limit: int = 3,
    seconds: int = 300,
    delay: str = WATERMARK,
    heartbeat: Column | None = None,
    forget: int | None = None,
) -> DataFrame:
    """Consecutive failures per user in event time; from `limit` on the user is locked for `seconds`.

    Rows of equal time go by `event_id`. A streak ends with a success, or, if `forget` is given, after that many
    seconds without a row; state is kept only for users with a streak.
    """
    use_rocksdb(stream.sparkSession)
    rows = _keyed(stream, user, ts, delay, heartbeat, event_id=F.col("event_id"), failed=F.coalesce(failed, F.lit(False)))
    out = rows.transformWithStateInPandas(
        statefulProcessor=_Lockout(limit, seconds * 1_000_000, None if forget is None else forget * 1_000_000),
        outputStructType="key string, event_id long, failures long, locked boolean, until long",
        outputMode="Append",
        timeMode="EventTime",
    )
    return out.select(
        F.col("key").alias(user),
        "event_id",
        F.col("failures").alias("consecutive_failures"),
        "locked",
        F.timestamp_micros("until").alias("locked_until"),
    )
