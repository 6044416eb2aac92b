"""Folds over the rows of a key as stream state: debounce, lockout, and high-water marks.

Each keeps one small state variable a key with ``transformWithState``, in RocksDB (``use_rocksdb``), so state grows with keys
and not with rows. Rows come one by one and not as a frame a key, as most keys have few in a micro-batch, and each asks the store once.
Rows of a key within one micro-batch are folded in order of time; across
micro-batches they are taken as they come, so a stream that is replayed in order of time gives what the batch form gives, however it
is cut into batches and however often it is restarted. The debounce sets a timer for each accepted trigger: once the
watermark is past the gap, the next trigger is accepted anyway, and the key's state is dropped.

Rows with a null key or time take no part, as in the batch forms.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Failures that close an account, and for how many seconds.
FAILURES, CLOSED_SECONDS = 5, 900


def use_rocksdb(spark: SparkSession) -> None:
    """``transformWithState`` needs this store; a session that has another is changed for streams started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Debounce(StatefulProcessor):
    """Accepts a trigger if the key's last accepted one is ``gap`` microseconds before it at least."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "micros long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        was = self.last.get()
        last = was[0] if was else None
        for t in sorted(r[-1] for r in rows):  # a key's rows of one micro-batch, whose size the trigger bounds
            if last is None or t - last >= self.gap:
                last = t
                yield Row(key=key[0], micros=t)
        if was is None or last != was[0]:
            self.last.update((last,))
            self.handle.registerTimer(-(-(last + self.gap) // 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        last = self.last.get()
        if last and -(-(last[0] + self.gap) // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def lockout_step(failed: int, closed_until: int | None, at: int, right: bool, most: int, closed_for: int) -> tuple[str, int, int | None]:
    """Outcome of one attempt (ok, invalid or locked), and the state after it. Failures are counted until one attempt is right, so each failure after a lock locks again."""
    if closed_until is not None and closed_until > at:
        return "locked", failed, closed_until
    if right:
        return "ok", 0, None
    failed += 1
    return "invalid", failed, at + closed_for if failed >= most else closed_until


class Lockout(StatefulProcessor):
    """Outcomes of attempts, by failures in a row and the time until which the account is closed."""

    def __init__(self, most: int, closed_for: int) -> None:
        self.most, self.closed_for = most, closed_for

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("attempts", "failed int, closed_until long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        was = self.state.get()
        now = failed, closed = tuple(was) if was else (0, None)
        for _, t, order, right in sorted(rows, key=itemgetter(1, 2)):  # a key's rows of one micro-batch, whose size the trigger bounds
            outcome, failed, closed = lockout_step(failed, closed, t, right, self.most, self.closed_for)
            yield Row(key=key[0], micros=t, ord=order, outcome=outcome)
        if (failed, closed) == (0, None):
            if was:
                self.state.clear()  # as good as no state
        elif (failed, closed) != now:
            self.state.update((failed, closed))

    def close(self) -> None:
        pass


class AboveMark(StatefulProcessor):
    """Rows without a number, or above the highest number of the micro-batches before; all rows of a key's first micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "value long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        was = self.mark.get()
        top = mark = was[0] if was else None
        for row in rows:  # no order is needed, so a micro-batch's rows are not held
            number = row[-1]
            if number is not None and (top is None or number > top):
                top = number
            if number is None or mark is None or number > mark:
                yield row
        if top is not None and top != mark:
            self.mark.update((top,))

    def close(self) -> None:
        pass


def debounced(stream: DataFrame, key: str, at: str, gap_seconds: int = 10, delay: str = "1 hour") -> DataFrame:
    """key and at of accepted triggers of a stream; triggers more than ``delay`` behind the latest are late and do not count."""
    kinds = dict(stream.dtypes)
    rows = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), F.unix_micros(F.col(at).cast("timestamp")).alias("micros"))
    out = rows.withWatermark("at", delay).groupBy("key").transformWithState(Debounce(gap_seconds * 1_000_000), f"key {kinds[key]}, micros long", "Append", "EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("micros").cast(kinds[at]).alias(at))


def lockouts(stream: DataFrame, key: str, at: str, ok: str, order: str, most: int = FAILURES, closed_seconds: int = CLOSED_SECONDS) -> DataFrame:
    """key, at, order and outcome of each attempt of a stream. order: tells attempts of one time apart."""
    kinds = dict(stream.dtypes)
    rows = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("micros"), F.col(order).alias("ord"), F.coalesce(F.col(ok), F.lit(False)).alias("ok"))
    out = rows.groupBy("key").transformWithState(Lockout(most, closed_seconds * 1_000_000), f"key {kinds[key]}, micros long, ord {kinds[order]}, outcome string", "Append", "None")
    return out.select(F.col("key").alias(key), F.timestamp_micros("micros").cast(kinds[at]).alias(at), F.col("ord").alias(order), "outcome")


def above_marks_stream(stream: DataFrame, key: str, value: str) -> DataFrame:
    """The rows of a stream that ``ingest.above_marks`` keeps of each micro-batch, marks being those of the micro-batches before."""
    rows = stream.where(F.col(key).isNotNull()).withColumn("number", F.col(value).cast("long"))
    return rows.groupBy(F.col(key)).transformWithState(AboveMark(), rows.schema, "Append", "None").drop("number")


def lockouts_batch(df: DataFrame, key: str, at: str, ok: str, order: str, most: int = FAILURES, closed_seconds: int = CLOSED_SECONDS) -> DataFrame:
    """``lockouts`` of a table: rows are dealt by key and sorted by Spark, and a worker keeps one account's state."""
    kinds = dict(df.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, failed, closed = None, 0, None
        for some in frames:
            outcomes = []
            for k, t, right in zip(some["key"], some["micros"], some["ok"], strict=True):
                if k != current:
                    current, failed, closed = k, 0, None
                outcome, failed, closed = lockout_step(failed, closed, int(t), bool(right), most, closed_seconds * 1_000_000)
                outcomes.append(outcome)
            yield pd.DataFrame({"key": some["key"], "micros": some["micros"], "ord": some["ord"], "outcome": outcomes})

    rows = df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("micros"), F.col(order).alias("ord"), F.coalesce(F.col(ok), F.lit(False)).alias("ok"))
    out = rows.repartition("key").sortWithinPartitions("key", "micros", "ord").mapInPandas(run, f"key {kinds[key]}, micros long, ord {kinds[order]}, outcome string")
    return out.select(F.col("key").alias(key), F.timestamp_micros("micros").cast(kinds[at]).alias(at), F.col("ord").alias(order), "outcome")
