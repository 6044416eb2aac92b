"""Queries by relational division: customers stand for notices, their first purchase for the body, their orders for cards, kinds of events for sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.operators import completeness as C
from gazette.plans.base import Query, table

NOW, BEGUN = "2024-03-02 00:00:00", "2024-03-01 00:00:00"


def _divided(spark: SparkSession, d: str) -> DataFrame:
    """A customer is complete with a purchase, with a shipped item in every order, and with a k of 50 or more for each of its kinds of events."""
    customers, orders, items, events = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "events"))
    seen = events.select("user_id", "event_type", (F.get_json_object("props", "$.k").cast("int") >= 50).alias("high"))
    source = F.concat_ws("/", "user_id", "event_type")
    required = [C.requirement(customers, "body", F.col("c_custkey"), F.col("c_custkey")), C.requirement(orders, "card", F.col("o_custkey"), F.col("o_orderkey")), C.requirement(seen, "source", F.col("user_id"), source)]
    present = [C.presence(seen.where("event_type = 'purchase'"), "body", F.col("user_id")), C.presence(items.where("l_linestatus = 'F'"), "card", F.col("l_orderkey")), C.presence(seen.where("high"), "source", source)]
    return C.divided(customers, "c_custkey", required, present)


def j18_division(spark: SparkSession, d: str) -> DataFrame:
    return _divided(spark, d).select("c_custkey", F.array_join("missing", ",").alias("missing"), "complete")


def t13_progress(spark: SparkSession, d: str) -> DataFrame:
    """A batch for each nation: begun with all customers, held against those below 2000 in balance, then against those that are not complete."""
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal").join(_divided(spark, d).select("c_custkey", "complete"), "c_custkey")
    i = F.col("c_custkey").cast("string")
    ids = rows.groupBy("c_nationkey").agg(F.collect_list(i).alias("all"), F.collect_list(F.when(F.col("c_acctbal") < 2000, i)).alias("poor"), F.collect_list(F.when(~F.col("complete") & (F.col("c_acctbal") < 2000), i)).alias("left"))  # what a batch holds
    now, begun = F.lit(NOW).cast("timestamp"), F.lit(BEGUN).cast("timestamp")
    b = ids.withColumn("batch", C.synced(F.lit(None).cast(C._BATCH), F.lit("vi"), F.col("all"), begun))
    b = b.withColumn("batch", C.synced(F.col("batch"), F.lit("vi"), F.col("poor"), now)).withColumn("batch", C.progressed(F.col("batch"), F.col("left"), now))
    return b.select("c_nationkey", F.size("batch.ids").alias("n_ids"), F.array_join("batch.pending", ",").alias("pending"), "batch.phase", F.col("batch.completed_at").isNotNull().alias("ended"))


_DIVIDED = """select c_custkey, not exists (select 1 from events where user_id = c_custkey and event_type = 'purchase') as no_body,
  exists (select 1 from orders where o_custkey = c_custkey and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'F')) as card_open,
  exists (select 1 from events e where e.user_id = c_custkey and not exists (select 1 from events h where h.user_id = e.user_id and h.event_type = e.event_type and (h.props->>'$.k')::int >= 50)) as source_open, c_nationkey, c_acctbal from customer"""
QUERIES: dict[str, Query] = {
    "j18_division": (j18_division, f"select c_custkey, concat_ws(',', case when no_body then 'body' end, case when card_open then 'card' end, case when source_open then 'source' end) as missing, not (no_body or card_open or source_open) as complete from ({_DIVIDED})"),
    "t13_progress": (t13_progress, f"""with r as (select *, no_body or card_open or source_open as open from ({_DIVIDED})),
      n as (select c_nationkey, count(*) as every, count(*) filter (where c_acctbal < 2000) as poor, coalesce(string_agg(c_custkey::varchar, ',' order by c_custkey::varchar) filter (where c_acctbal < 2000 and open), '') as pending from r group by 1)
      select c_nationkey, (case when poor = 0 then every else poor end)::int as n_ids, pending, case when pending = '' then 'complete' else 'pending' end as phase, pending = '' as ended from n"""),
}
