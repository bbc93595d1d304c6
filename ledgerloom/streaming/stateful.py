"""Streams with state of their own: rolling baselines, alerts after failures in a row, and bounded histories.

``InOrder`` holds the rows of a key until the watermark has passed them and hands them on by event time, so that rows that
arrive late, or in another order in another batch, give what the table gives; rows behind the watermark are lost, as the
delay says.  A key's state ends by a timer when nothing is in it that a later row could need.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..sources.shared import ship, shared_folder
from .streams import timed

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_US = 86_400_000_000
PENDING = "at bigint, tie bigint, value double"


class InOrder(StatefulProcessor):
    """Hands the rows (at, tie, value) of each key to ``step`` in order, once no earlier one can come."""

    #: Schema of what ``step`` keeps of a key, and the columns it gives for a row besides key, at and tie.
    kept, given = "", ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", PENDING)
        self.state = handle.getValueState("state", self.kept)

    def step(self, state: tuple | None, at: int, tie: int, value: float | None) -> tuple[tuple, tuple | None]:
        """The new state, and what a row gives, if anything."""
        raise NotImplementedError

    def forgotten(self, state: tuple) -> int:
        """The time from which a state says nothing any more, or only what ``remains`` of it."""
        raise NotImplementedError

    def remains(self, state: tuple) -> tuple | None:
        return None

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(a), int(t), None if pd.isna(v) else float(v)) for df in rows for a, t, v in zip(df["at"], df["tie"], df["value"], strict=True)]
        self.pending.appendList(new)
        self.wake([a for a, _, _ in new])
        return iter(())

    def wake(self, times: list[int]) -> None:
        """A timer for the earliest of these; timers are in milliseconds, rounded up."""
        if times:
            self.handle.registerTimer(-(-min(times) // 1000) + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((r[0], r[1], r[2]) for r in self.pending.get()) if self.pending.exists() else []
        due = [r for r in rows if r[0] < now]
        state = self.state.get() if self.state.exists() else None
        out = []
        for at, tie, value in due:
            state, given = self.step(state, at, tie, value)
            if given is not None:
                out.append((*key, at, tie, *given))
        if due:
            left = rows[len(due) :]
            self.pending.put(left) if left else self.pending.clear()
            self.state.update(state)
            self.wake([at for at, _, _ in left] or [self.forgotten(state)])
        elif not rows and state is not None and self.forgotten(state) < now:
            left = self.remains(state)
            self.state.clear() if left is None else self.state.update(left)
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "tie", *self.given])

    def close(self) -> None:
        pass


class Baseline(InOrder):
    """The median of the samples of the last days, and whether a sample is above it by more than the margin."""

    kept, given = "first bigint, times array<bigint>, values array<double>", ("samples", "baseline", "alarm")

    def __init__(self, days: int, margin: float):
        self.window, self.margin = days * DAY_US, margin

    def step(self, state: tuple | None, at: int, tie: int, value: float | None) -> tuple[tuple, tuple | None]:
        first, times, values = (at, [], []) if state is None else (state[0], list(state[1]), list(state[2]))
        begin = bisect_left(times, at - self.window)
        times, values = times[begin:], values[begin:]
        known = sorted(v for t, v in zip(times, values, strict=True) if t < at)
        n = len(known)
        baseline = (known[(n - 1) // 2] + known[n // 2]) / 2 if n else None
        warm = at - first >= self.window
        alarm = bool(warm and value is not None and baseline is not None and value > baseline + self.margin)
        if value is not None:
            times, values = [*times, at], [*values, value]
        return (first, times, values), (n, baseline, alarm)

    def forgotten(self, state: tuple) -> int:
        return (state[1][-1] if len(state[1]) else state[0]) + self.window

    def remains(self, state: tuple) -> tuple | None:
        """When the source was first seen: it doesn't warm up again."""
        return state[0], [], []


class Failures(InOrder):
    """Alerts of so many failures in a row; none within the cooldown after another."""

    kept, given = "failures int, alerted bigint, last bigint", ("failures",)

    def __init__(self, least: int, cooldown_us: int, low: float):
        self.least, self.cooldown, self.low = least, cooldown_us, low

    def step(self, state: tuple | None, at: int, tie: int, value: float | None) -> tuple[tuple, tuple | None]:
        failures, alerted = (0, None) if state is None else (state[0], state[1])
        failures = failures + 1 if value is not None and value < self.low else 0
        cooling = alerted is not None and not pd.isna(alerted) and at - alerted < self.cooldown
        fires = failures >= self.least and not cooling
        return (failures, at if fires else alerted, at), (failures,) if fires else None

    def forgotten(self, state: tuple) -> int:
        """A run of failures is kept while it lasts: only a key without one, and without a cooldown, is forgotten."""
        return state[2] + self.cooldown if not state[0] else 1 << 52


class History(StatefulProcessor):
    """Each key's latest distinct items, at most ``longest``, with the number of the update."""

    def __init__(self, longest: int):
        self.longest = longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("items", "updates bigint, items array<string>, times array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        updates, seen = 0, {}
        if self.state.exists():
            updates, items, times = self.state.get()
            seen = dict(zip(items, times, strict=True))
        best: list[tuple[int, str]] = sorted((int(t), i) for i, t in seen.items())
        for df in rows:
            for item, at in zip(df["item"], df["at"], strict=True):
                if item is None or (item in seen and seen[item] >= at):
                    continue
                if item in seen:
                    best.remove((seen[item], item))
                seen[item] = int(at)
                insort(best, (int(at), item))
                if len(best) > self.longest:  # what was cut can't come back but by a later time
                    del seen[best.pop(0)[1]]
        best.reverse()
        state = (int(updates) + 1, [i for _, i in best], [t for t, _ in best])
        self.state.update(state)
        yield pd.DataFrame([(*key, *state)], columns=["key", "updates", "items", "times"])

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, which states of this kind need, while a stream runs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def replayed(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream with such a state over what there is; the rows of all batches as a table."""
    spark, root = df.sparkSession, shared_folder(df.sparkSession, "stream")

    def put(batch: DataFrame, epoch: int) -> None:  # a batch that is run again replaces itself
        batch.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")

    with rocks(spark):
        query = df.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/check").outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out/*")


def kept_in_order(df: DataFrame, key: str, time: str, tie: str, value: str, delay: str, processor: InOrder, given: str) -> DataFrame:
    ship(df.sparkSession)
    rows = timed(df, time, delay)
    rows = rows.select(F.col(key).alias("key"), F.col(time).alias("_time"), F.unix_micros(time).alias("at"), F.col(tie).cast("long").alias("tie"), F.col(value).cast("double").alias("value"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = StructType.fromDDL(f"key {kind}, at bigint, tie bigint, {given}")
    out = rows.groupBy("key").transformWithStateInPandas(processor, schema, "append", "eventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias(time), F.col("tie").alias(tie), *processor.given)


def rolling_baseline(df: DataFrame, key: str, time: str, tie: str, rate: str, days: int = 7, margin: float = 0.15, delay: str = "1 day") -> DataFrame:
    """Each sample with the median of its key's ``days`` before, and whether it is above it by more than the margin.

    A key's first ``days`` don't alarm.  The state is the samples of so many days.
    """
    return kept_in_order(df, key, time, tie, rate, delay, Baseline(days, margin), "samples int, baseline double, alarm boolean")


def failure_alerts(df: DataFrame, key: str, time: str, tie: str, value: str, low: float, least: int = 3, cooldown_hours: int = 24, delay: str = "1 day") -> DataFrame:
    """A row for each alert: ``least`` values under ``low`` in a row and no alert of the key within the cooldown before.

    The state is three numbers a key.
    """
    return kept_in_order(df, key, time, tie, value, delay, Failures(least, cooldown_hours * 3_600_000_000, low), "failures int")


def bounded_history(df: DataFrame, key: str, item: str, time: str, longest: int = 100) -> DataFrame:
    """Updates of each key's latest distinct items, newest first: key, updates (their number), items and times.

    The state is at most ``longest`` items a key, whatever the order in which they come.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(item).cast("string").alias("item"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"))
    schema = StructType.fromDDL(f"key {rows.schema['key'].dataType.simpleString()}, updates bigint, items array<string>, times array<bigint>")
    return rows.groupBy("key").transformWithStateInPandas(History(longest), schema, "update", "none").withColumnRenamed("key", key)
