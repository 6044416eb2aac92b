"""Queries that write events to keyed tables in several changes and read the current version back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.operators.folders import shared_folder
from gazette.operators.keyed_table import KeyedTable
from gazette.plans.base import Query, table

CUTS = ("2024-01-08 00:00:00", "2024-01-16 00:00:00", "2024-01-22 00:00:00")
BUCKETS = 16


def _batches(spark: SparkSession, d: str) -> list[DataFrame]:
    """The events before the first cut, between the cuts, and from the last cut on."""
    ts, cuts = F.col("ts"), [F.lit(c).cast("timestamp") for c in CUTS]
    e = table(spark, d, "events")
    return [e.where(ts < cuts[0]), *(e.where((ts >= a) & (ts < b)) for a, b in zip(cuts, cuts[1:], strict=False)), e.where(ts >= cuts[-1])]


def _table(spark: SparkSession, name: str, ddl: str, keys: list[str]) -> KeyedTable:
    return KeyedTable(spark, shared_folder(spark, name), spark.createDataFrame([], ddl).schema, keys, BUCKETS)


def s20_upsert_table(spark: SparkSession, d: str) -> DataFrame:
    """Latest event of each user and type, and when it was first seen; the third batch comes twice, as after a restart."""
    out = _table(spark, "upserts", "user_id long, event_type string, event_id long, ts timestamp, first_seen timestamp", ["user_id", "event_type"])
    rows = [x.withColumn("first_seen", F.col("ts")) for x in _batches(spark, d)]
    for n, some in enumerate([*rows[:3], rows[2], rows[3]]):
        out.upsert(some.withColumn("event_id", F.col("event_id").cast("long")), "ts", ["first_seen"], writer="intake", batch=min(n, 2) if n < 4 else 3)
    return out.read().select("user_id", "event_type", "event_id", "first_seen")


def s21_insert_table(spark: SparkSession, d: str) -> DataFrame:
    """First batch of each user and type wins; within a batch the latest event."""
    out = _table(spark, "inserts", "user_id long, event_type string, event_id long, ts timestamp", ["user_id", "event_type"])
    for some in _batches(spark, d):
        out.insert_absent(some, "ts")
    return out.read().select("user_id", "event_type", "event_id")


def s22_range_table(spark: SparkSession, d: str) -> DataFrame:
    """All events by id; then the crawled ones (views and clicks) of the days from 10 to 12 January become the purchases of those days, others stay."""
    out = _table(spark, "ranges", "event_id long, event_type string, day date", ["event_id"])
    e = table(spark, d, "events").select("event_id", "event_type", F.to_date("ts").alias("day"))
    out.upsert(e, "event_id")
    days = F.col("day").between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-12").cast("date"))
    fresh = e.where(days & (F.col("event_type") == "purchase")).select((-F.col("event_id") - 1).alias("event_id"), F.lit("click").alias("event_type"), "day")
    out.replace_range(fresh, days & F.col("event_type").isin("view", "click"))
    return out.read()


def s23_diff_table(spark: SparkSession, d: str) -> DataFrame:
    """Days with events of each user: a later batch of a user replaces all the user's days, users without one keep theirs."""
    out = _table(spark, "diffs", "user_id long, day date, n long, last_id long", ["user_id", "day"])
    for some in _batches(spark, d):
        out.diff_replace(some.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id")), ["user_id"], "last_id")
    return out.read()


_BATCH = "(ts >= timestamp '2024-01-08 00:00:00')::int + (ts >= timestamp '2024-01-16 00:00:00')::int + (ts >= timestamp '2024-01-22 00:00:00')::int"
QUERIES: dict[str, Query] = {
    "s20_upsert_table": (s20_upsert_table, "select user_id, event_type, arg_max(event_id, ts) as event_id, min(ts) as first_seen from events group by 1, 2"),
    "s21_insert_table": (s21_insert_table, f"select user_id, event_type, arg_max(event_id, ts) as event_id from (select *, {_BATCH} as b, min({_BATCH}) over (partition by user_id, event_type) as first_b from events) where b = first_b group by 1, 2"),
    "s22_range_table": (s22_range_table, "with e as (select event_id, event_type, ts::date as day, ts::date between date '2024-01-10' and date '2024-01-12' as hit from events) select event_id, event_type, day from e where not (hit and event_type in ('view', 'click')) union all select -event_id - 1, 'click', day from e where hit and event_type = 'purchase'"),
    "s23_diff_table": (s23_diff_table, f"select user_id, ts::date as day, count(*) as n, max(event_id) as last_id from (select *, {_BATCH} as b, max({_BATCH}) over (partition by user_id) as last_b from events) where b = last_b group by 1, 2"),
}
