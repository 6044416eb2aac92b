"""Queries on calendars: orders stand for events, customers for notices, the latest event of each user and kind for a translation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.operators import calendar
from gazette.plans.base import Query, table


def j6_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Events of all orders as a Vietnamese reader sees them."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    events = table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 7 != 0, F.col("o_custkey")).alias("notice_id"), F.col("o_orderpriority").alias("title"), day.alias("event_date"), F.when(k % 3 != 0, F.date_add(day, (k % 5).cast("int") - 1)).alias("end_date"),
        F.array(F.when(k % 2 == 0, "event").otherwise("deadline")).alias("event_kinds"), F.concat(F.lit("room "), "o_orderstatus").alias("location"),
    )
    c = F.col("c_custkey")
    notices = table(spark, d, "customer").select(c.alias("id"), F.when(c % 4 == 0, " ").when(c % 4 == 1, None).otherwise(F.concat(F.lit("## "), "c_name")).alias("title"), F.lit(None).cast("string").alias("summary"), F.create_map(F.lit("vi"), F.when(c % 3 == 0, F.concat(F.lit("# tóm tắt "), c.cast("string"), F.lit("\nhai")))).alias("summaries"))
    latest = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("e")).select("user_id", "event_type", "e.event_id", "e.value")
    e = F.col("event_id")
    told = latest.select(F.col("user_id").alias("notice_id"), F.when(F.col("event_type") == "view", "vi").when(F.col("event_type") == "click", "ko").otherwise(F.col("event_type")).alias("target_language"), F.when(e % 3 == 0, "").otherwise(F.concat(F.lit("tiêu đề "), e.cast("string"))).alias("translated_title"), F.when(e % 2 == 0, F.concat(F.lit("phòng "), e.cast("string"))).alias("translated_location"), F.when(F.col("value") > 20, "văn bản").alias("translated_text"))
    shown = calendar.event_cards(events, notices, told, "vi", "thông báo")
    return shown.select("id", "event_date", F.array_join("event_kinds", "+").alias("kinds"), "display_title", "source_title", "location", "pending")


_J6 = """with e as (select o_orderkey as id, case when o_orderkey % 7 <> 0 then o_custkey end as notice, o_orderpriority as title, o_orderdate::date as day, case when o_orderkey % 3 <> 0 then (o_orderdate::date + (o_orderkey % 5 - 1)::int) end as fin, case when o_orderkey % 2 = 0 then 'event' else 'deadline' end as kind, 'room ' || o_orderstatus as room from orders),
  k as (select *, case when fin >= day then fin else day end as last from e), w as (select *, case when notice is null then 1 else row_number() over (partition by notice, last order by day, fin is null, id) end as rn, min(id) filter (where kind = 'event') over (partition by notice, last) as e1, min(id) filter (where kind = 'deadline') over (partition by notice, last) as d1 from k),
  t as (select * from (select user_id, event_id as v, value from events where event_type = 'view' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)),
  m as (select w.*, case when c_custkey % 4 = 0 then ' ' when c_custkey % 4 = 1 then null else '## ' || c_name end as own, c_custkey, t.v, t.value from w left join customer on c_custkey = notice left join t on t.user_id = notice where rn = 1)
  select id, day as event_date, case when notice is null then kind when e1 is null or d1 is null then kind when kind = 'event' then 'event+deadline' else 'deadline+event' end as kinds,
    case when v is not null and v % 3 <> 0 then 'tiêu đề ' || v when c_custkey % 3 = 0 then 'tóm tắt ' || c_custkey when trim(coalesce(own, title)) <> '' then replace(coalesce(own, title), '## ', '') else 'thông báo' end as display_title,
    coalesce(own, title) as source_title, case when v is not null and v % 2 = 0 then 'phòng ' || v else room end as location, notice is not null and (value is null or value <= 20) as pending from m"""
QUERIES: dict[str, Query] = {"j6_calendar": (j6_calendar, _J6)}
