"""Queries that replay the events as a stream, in slices of time with a restart after each, and read the sink's table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.operators.folders import shared_folder
from gazette.plans.base import Query, table
from gazette.streaming import keyed_state

CUTS = ("2024-01-08 00:00:00", "2024-01-16 00:00:00", "2024-01-22 00:00:00")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def replayed(spark: SparkSession, rows: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over rows gives; each slice of time arrives as files, is read by a query of its own, and that query ends."""
    path, ts, cuts = shared_folder(spark, "replay"), F.col("ts"), [F.lit(c).cast("timestamp") for c in CUTS]
    was = spark.conf.get(_PROVIDER)
    keyed_state.use_rocksdb(spark)
    try:
        for part in (ts < cuts[0], *((ts >= a) & (ts < b) for a, b in zip(cuts, cuts[1:], strict=False)), ts >= cuts[-1]):
            rows.where(part).write.mode("append").parquet(f"{path}/in")
            stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
            make(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, was)
    return spark.read.parquet(f"{path}/out")


def t10_stream(spark: SparkSession, d: str) -> DataFrame:
    """Triggers of each user at least an hour after the last accepted one, from a stream."""
    return replayed(spark, table(spark, d, "events").select("user_id", "ts"), lambda s: keyed_state.debounced(s, "user_id", "ts", 3600, "1 day"))


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "ts", F.col("event_type").isin("purchase", "signup").alias("ok"))


def t14_stream(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of log-ins, from a stream: purchases and sign-ups are right, three wrong ones in a row close an account for two days."""
    return replayed(spark, _attempts(spark, d), lambda s: keyed_state.lockouts(s, "user_id", "ts", "ok", "event_id", 3, 172_800)).select("event_id", "user_id", "outcome")


def t14_lockout(spark: SparkSession, d: str) -> DataFrame:
    """The same from the table."""
    return keyed_state.lockouts_batch(_attempts(spark, d), "user_id", "ts", "ok", "event_id", 3, 172_800).select("event_id", "user_id", "outcome")


def t1_stream(spark: SparkSession, d: str) -> DataFrame:
    """Posts above their board's mark, from a stream: numbers are cents of the value, boards are users."""
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.round(F.col("value") * 100).cast("long")).alias("number_of_post"))
    return replayed(spark, rows, lambda s: keyed_state.above_marks_stream(s, "user_id", "number_of_post")).select("event_id", "user_id")


_DEBOUNCED = "with recursive a as (select user_id, min(ts) as ts from events group by 1 union all select e.user_id, min(e.ts) as ts from a join events e on e.user_id = a.user_id and e.ts >= a.ts + interval 1 hour group by 1) select user_id, ts from a"
_LOCKED = """with recursive e as (select event_id, user_id, ts, event_type in ('purchase', 'signup') as good, row_number() over (partition by user_id order by ts, event_id) as n from events),
  s as (select event_id, user_id, n, case when good then 'ok' else 'invalid' end as outcome, case when good then 0 else 1 end as failed, null::timestamp as closed from e where n = 1
    union all select e.event_id, e.user_id, e.n, case when s.closed > e.ts then 'locked' when e.good then 'ok' else 'invalid' end, case when s.closed > e.ts then s.failed when e.good then 0 else s.failed + 1 end,
      case when s.closed > e.ts then s.closed when e.good then null when s.failed + 1 >= 3 then (e.ts + interval 2 day)::timestamp else s.closed end
    from s join e on e.user_id = s.user_id and e.n = s.n + 1) select event_id, user_id, outcome from s"""
_ABOVE = """with e as (select event_id, user_id, (ts >= timestamp '2024-01-08 00:00:00')::int + (ts >= timestamp '2024-01-16 00:00:00')::int + (ts >= timestamp '2024-01-22 00:00:00')::int as slice, case when event_type <> 'error' then round(value * 100)::bigint end as number from events)
  select event_id, user_id from e where number is null or number > coalesce((select max(p.number) from e p where p.user_id = e.user_id and p.slice < e.slice), -1)"""
QUERIES: dict[str, Query] = {"t10_stream": (t10_stream, _DEBOUNCED), "t14_stream": (t14_stream, _LOCKED), "t14_lockout": (t14_lockout, _LOCKED), "t1_stream": (t1_stream, _ABOVE)}
