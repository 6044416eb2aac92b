"""Queries on keyed tables: scans, joins, groups, windows, calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.functions import dates as D
from gazette.functions.text import round_half_up
from gazette.operators import calendar, picks, summary
from gazette.plans.base import Query, table


def _day(c: str):
    return F.to_date(c)


def s1_filtered_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus in ('F', 'O') and o_totalprice >= 1000 and o_totalprice < 200000").select("o_orderkey", "o_custkey", "o_totalprice")


def s3_lookup_by_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_custkey", "o_orderstatus")


def s4_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return summary.zero_filled_counts(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")), "status", ["F", "O", "P", "X"])


def s24_delete_preview(spark: SparkSession, d: str) -> DataFrame:
    """Rows that would go with the customers of one nation."""
    doomed = table(spark, d, "customer").where("c_nationkey = 7")
    orders = table(spark, d, "orders").join(doomed, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    items = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count(doomed, "customer").unionByName(count(orders, "orders")).unionByName(count(items, "lineitem"))


def j1_inner(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def j2_f18_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Orders and customers that the other side lacks."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    lost = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count(F.lit(1)).alias("orphan_orders"))
    idle = c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count(F.lit(1)).alias("idle_customers"))
    return lost.withColumn("k", F.lit(1)).join(idle.withColumn("k", F.lit(1)), "k").drop("k")


def j3_merged_state(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the state of their newest order over a default."""
    newest = picks.latest_by(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return table(spark, d, "customer").join(newest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("o_orderstatus", F.lit("none")).alias("status"), F.coalesce("o_orderkey", F.lit(-1)).alias("last_order"))


def j4_star(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"))


def j5_home_list(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the counts of two pre-aggregated sides."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"), F.max(_day("l_shipdate")).alias("last_ship"))
    others = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders_of_customer"))
    return table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(others, "o_custkey", "left").select("o_orderkey", F.coalesce("items", F.lit(0)).alias("items"), "last_ship", "orders_of_customer")


def j6_pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count(F.lit(1))).select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("de", "en", "es", "fr")])


def j10_month_overlap(spark: SparkSession, d: str) -> DataFrame:
    month = F.lit("1998-03-01").cast("date")
    spans = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(_day("l_shipdate")).alias("first"), F.max(_day("l_shipdate")).alias("last"))
    return spans.where(calendar.in_month(F.col("first"), F.col("last"), month))


def j12_recurring(spark: SparkSession, d: str) -> DataFrame:
    """Orders by day of week against a table of recurring items."""
    slots = spark.createDataFrame([(0, "rest"), (1, "swim"), (3, "piano"), (5, "art")], "dow int, item string")
    return table(spark, d, "orders").withColumn("dow", F.dayofweek("o_orderdate") - 1).join(F.broadcast(slots), "dow").groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def j16_week_spine(spark: SparkSession, d: str) -> DataFrame:
    """Events of each type for every day of January 2024, days without events included."""
    facts = table(spark, d, "events").groupBy("event_type", _day("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    spine = calendar.with_spine(facts, "event_type", "day", F.lit("2024-01-01").cast("date"), F.lit("2024-02-04").cast("date"))
    return spine.select("event_type", "day", F.coalesce("n", F.lit(0)).alias("n"))


def j18_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Orders all of whose items have left, by quantifiers over groups."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_linestatus") == "F").alias("all_done"), F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"))


def a1_conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"))


def a2_run_summary(spark: SparkSession, d: str) -> DataFrame:
    out = summary.run_summary(table(spark, d, "events").withColumn("day", _day("ts")), F.col("event_type") != "error", F.col("event_type") == "view", ["day"])
    return out.select("day", "processed", "success", "failure", "fallback", "success_rate", "alarm", "outcome")


def a5_collect_map(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "o_orderstatus", F.col("n").cast("string")))), ",").alias("by_status"))


def a6_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.count_distinct(_day("ts")).alias("days"))


def a9_median(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(round_half_up(F.median("value"), 1).alias("median_value"))


def a14_best_signal(spark: SparkSession, d: str) -> DataFrame:
    """The event type with the largest total of each user; ties to the first name."""
    sums = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return picks.first_by(sums, ["user_id"], [F.desc("cents"), F.asc("event_type")])


def w1_keep_newest(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("day", _day("o_orderdate"))
    return picks.first_by(o, ["o_custkey", "o_orderstatus"], [F.desc("day"), F.desc("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderkey", "day")


def w3_w4_latest(spark: SparkSession, d: str) -> DataFrame:
    return picks.latest_by(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def w6_d10_event_winners(spark: SparkSession, d: str) -> DataFrame:
    """Order spans that end on the same day of a customer collapse to the earliest, with all their kinds; some ends are missing or before the start."""
    spans = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(_day("l_shipdate")).alias("start"), F.max(_day("l_shipdate")).alias("last"))
    end = F.when(F.col("o_orderkey") % 5 == 0, F.date_sub("start", 1)).when(F.col("last") > F.col("start"), F.col("last"))
    kinds = F.when(F.col("o_orderkey") % 11 == 0, None).when(F.col("o_orderstatus") == "F", F.array(F.lit("deadline"))).otherwise(F.array(F.lit("event")))
    rows = table(spark, d, "orders").join(spans, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", "start", end.alias("end"), kinds.alias("kinds"))
    # one customer in three: ends by month, so that many of its spans meet
    month = F.when(F.col("o_custkey") % 3 == 0, F.last_day("start")).otherwise(F.col("end"))
    return picks.event_winners(rows.withColumn("end", month), "o_custkey", "start", "end", "o_orderkey", "kinds").withColumn("kinds", F.array_join("kinds", "+"))


def w7_last_of_day(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "day")
    return table(spark, d, "events").withColumn("day", _day("ts")).withColumn("last_id", F.max("event_id").over(w)).where("event_id = last_id").select("user_id", "day", "event_id")


def w8_gaps(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).alias("gap"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running_cents"))
    return rows


def w9_best_of_group(spark: SparkSession, d: str) -> DataFrame:
    """Of each customer's orders within 90 % of the largest, the best priority, then the largest."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    o = table(spark, d, "orders").withColumn("cents", cents).withColumn("top", F.max("cents").over(Window.partitionBy("o_custkey"))).where("cents * 10 >= top * 9")
    return picks.first_by(o, ["o_custkey"], [F.asc("o_orderpriority"), F.desc("cents"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "cents")


def w10_newest_five(spark: SparkSession, d: str) -> DataFrame:
    return picks.first_by(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).select("o_custkey", "o_orderkey")


def w12_w13_corpus_pick(spark: SparkSession, d: str) -> DataFrame:
    """120 documents taken in turn from each language; every third is held out."""
    picked = picks.round_robin(table(spark, d, "documents").where("lang is not null").select("lang", "doc_id"), "lang", "doc_id", 120)
    return picked.select("doc_id", "lang", F.col("position").cast("long").alias("position"), (F.col("position") % 3 == 0).alias("held_out"))


def w14_post_ranks(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.row_number().over(w) - 1).cast("long").alias("post_rank"))


def k1_top_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


def k4_home_order(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 by the day they were checked, else made, latest first; then by rank, missing ones last; then the newest."""
    checked = F.when(F.col("o_orderkey") % 3 == 0, F.date_add(_day("o_orderdate"), 20))
    rank = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 5)
    return table(spark, d, "orders").orderBy(F.coalesce(checked, _day("o_orderdate")).desc(), rank.asc_nulls_last(), F.desc("o_orderdate"), F.desc("o_orderkey")).limit(200).select("o_orderkey", "o_orderpriority")


def k7_name_rank(spark: SparkSession, d: str) -> DataFrame:
    """Parts ranked for a query: 0 equal, 1 begins with it, 2 contains it; 30 rows."""
    rank = F.when(F.col("p_name") == "small ring", 0).when(F.col("p_name").startswith("small"), 1).when(F.col("p_name").contains("small"), 2).otherwise(3)
    return table(spark, d, "part").withColumn("rank", rank.cast("long")).orderBy("rank", "p_name", "p_partkey").limit(30).select("p_partkey", "p_name", "rank")


def u1_u3_set_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Event kinds of users of neighbouring ids: shared, only in one, in either."""
    kinds = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("a"))
    after = kinds.select((F.col("user_id") - 1).alias("user_id"), F.col("a").alias("b"))
    return kinds.join(after, "user_id").select("user_id", F.size(F.array_intersect("a", "b")).cast("long").alias("common"), F.size(F.array_except("a", "b")).cast("long").alias("missing"), F.size(F.array_union("a", "b")).cast("long").alias("either"))


def c22_date_span(spark: SparkSession, d: str) -> DataFrame:
    """First and last ship day of orders with two distinct days or more, as a user of ISO strings would take them."""
    days = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("days"))
    return days.select("l_orderkey", D.date_span(F.col("days")).alias("s")).where("s is not null").select("l_orderkey", "s.first", "s.last")


def c23_due_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", D.due_label(_day("o_orderdate"), F.lit("1998-06-15").cast("date")).alias("label")).where("label is not null")


def c24_age_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", D.age_label("ts", F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("age"))


def c25_weeks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(D.week_start("ts").alias("week")).agg(F.count(F.lit(1)).alias("n"))


def c27_academic_years(spark: SparkSession, d: str) -> DataFrame:
    years = table(spark, d, "orders").groupBy(D.academic_year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    first, last = D.academic_bounds(F.col("year"))
    return years.select(F.col("year").cast("long").alias("year"), "n", first.alias("first"), last.alias("last"))


def c29_daily(spark: SparkSession, d: str) -> DataFrame:
    """Open orders by day, a span running from order to last shipment of at most 60 days."""
    spans = table(spark, d, "events").select("user_id", _day("ts").alias("start"), F.date_add(_day("ts"), (F.col("event_id") % 4).cast("int")).alias("end"))
    return calendar.daily(spans, "start", "end").groupBy("day").agg(F.count(F.lit(1)).alias("open"))


def c32_bell_periods(spark: SparkSession, d: str) -> DataFrame:
    """The default day of each school level."""
    one = spark.range(1)
    days = [one.select(F.lit(x).alias("level"), F.inline(D.bell_periods(x))) for x in D.BELLS]
    out = days[0].unionByName(days[1]).unionByName(days[2])
    return out.select("level", F.col("period").cast("long").alias("period"), D.clock("start_min").alias("start"), D.clock("end_min").alias("end"))


def f17_bell_validity(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' parts laid out as periods; a set is valid as a whole or not at all."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("school"), F.col("l_linenumber").alias("period"), (480 + F.col("l_linenumber") * 60).alias("start_min"), (480 + F.col("l_linenumber") * 60 + F.col("l_quantity").cast("int")).alias("end_min")).distinct()
    return calendar.period_errors(rows, "school")


_SPANS = "select l_orderkey, min(l_shipdate::date) as first, max(l_shipdate::date) as last from lineitem group by 1"
_CENTS = "round(o_totalprice * 100)::bigint"
QUERIES: dict[str, Query] = {
    "s1_filtered_scan": (s1_filtered_scan, "select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus in ('F', 'O') and o_totalprice >= 1000 and o_totalprice < 200000"),
    "s3_lookup_by_keys": (s3_lookup_by_keys, "select o_orderkey, o_custkey, o_orderstatus from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')"),
    "s4_status_counts": (s4_status_counts, "select status, count(o_orderkey) as n from (values ('F'), ('O'), ('P'), ('X')) v(status) left join orders on o_orderstatus = status group by 1"),
    "s24_delete_preview": (s24_delete_preview, "with c as (select c_custkey from customer where c_nationkey = 7), o as (select o_orderkey from orders where o_custkey in (select c_custkey from c)) select 'customer' as part, count(*) as n from c union all select 'orders', count(*) from o union all select 'lineitem', count(*) from lineitem where l_orderkey in (select o_orderkey from o)"),
    "j1_inner": (j1_inner, "select c_mktsegment, count(*) as n from orders join customer on o_custkey = c_custkey group by 1"),
    "j2_f18_orphans": (j2_f18_orphans, "select (select count(*) from orders where o_custkey not in (select c_custkey from customer)) as orphan_orders, (select count(*) from customer where c_custkey not in (select o_custkey from orders)) as idle_customers"),
    "j3_merged_state": (j3_merged_state, "select c_custkey, coalesce(o_orderstatus, 'none') as status, coalesce(o_orderkey, -1) as last_order from customer left join (select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1) on c_custkey = o_custkey"),
    "j4_star": (j4_star, "select r_name, n_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2"),
    "j5_home_list": (j5_home_list, "select o_orderkey, coalesce(items, 0) as items, last_ship, count(*) over (partition by o_custkey) as orders_of_customer from orders left join (select l_orderkey, count(*) as items, max(l_shipdate::date) as last_ship from lineitem group by 1) on o_orderkey = l_orderkey"),
    "j6_pivot": (j6_pivot, "select source, count(*) filter (where lang = 'de') as de, count(*) filter (where lang = 'en') as en, count(*) filter (where lang = 'es') as es, count(*) filter (where lang = 'fr') as fr from documents group by 1"),
    "j10_month_overlap": (j10_month_overlap, f"select * from ({_SPANS}) where first <= date '1998-03-31' and last >= date '1998-03-01'"),
    "j12_recurring": (j12_recurring, "select item, count(*) as n from orders join (values (0, 'rest'), (1, 'swim'), (3, 'piano'), (5, 'art')) v(dow, item) on dayofweek(o_orderdate) = dow group by 1"),
    "j16_week_spine": (j16_week_spine, "select event_type, day, coalesce(n, 0) as n from (select distinct event_type from events) cross join (select unnest(generate_series(date '2024-01-01', date '2024-02-04', interval 1 day))::date as day) left join (select event_type, ts::date as day, count(*) as n from events group by all) using (event_type, day)"),
    "j18_a12_completeness": (j18_completeness, "select l_orderkey, bool_and(l_linestatus = 'F') as all_done, bool_or(l_returnflag = 'R') as any_returned from lineitem group by 1"),
    "a1_conditional_counts": (a1_conditional_counts, "select o_orderpriority, count(*) as total, count(*) filter (where o_orderstatus = 'P') as pending from orders group by 1"),
    "a2_s25_run_summary": (a2_run_summary, "select *, case when processed = 0 then 'idle' when alarm then 'alarm' else 'ok' end as outcome from (select *, success_rate < 0.5 as alarm from (select ts::date as day, count(*) as processed, count(*) filter (where event_type <> 'error') as success, count(*) filter (where event_type = 'error') as failure, count(*) filter (where event_type = 'view') as fallback, floor((count(*) filter (where event_type <> 'error'))::double / count(*)::double * 10000.0::double + 0.5::double) / 10000.0::double as success_rate from events group by 1))"),
    "a5_collect_map": (a5_collect_map, "select o_custkey, string_agg(o_orderstatus || '=' || n, ',' order by o_orderstatus) as by_status from (select o_custkey, o_orderstatus, count(*) as n from orders group by all) group by 1"),
    "a6_a8_kinds": (a6_kinds, "select user_id, string_agg(distinct event_type, ',' order by event_type) as kinds, count(distinct ts::date) as days from events group by 1"),
    "a9_median": (a9_median, "select event_type, floor(median(value) * 10.0::double + 0.5::double) / 10.0::double as median_value from events group by 1"),
    "a14_best_signal": (a14_best_signal, "select * from (select user_id, event_type, sum(round(value * 100)::bigint)::bigint as cents from events group by all) qualify row_number() over (partition by user_id order by cents desc, event_type) = 1"),
    "w1_keep_newest": (w1_keep_newest, "select o_custkey, o_orderstatus, o_orderkey, o_orderdate::date as day from orders qualify row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate::date desc, o_orderkey desc) = 1"),
    "w3_w4_latest": (w3_w4_latest, "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1"),
    "w6_d10_event_winners": (w6_d10_event_winners, f"""with e as (select o_custkey, o_orderkey, first as start, case when o_custkey % 3 = 0 then last_day(first) when o_orderkey % 5 = 0 then (first - interval 1 day)::date when last > first then last end as "end", case when o_orderkey % 11 = 0 then null when o_orderstatus = 'F' then 'deadline' else 'event' end as kind from orders join ({_SPANS}) on o_orderkey = l_orderkey),
      k as (select *, case when "end" >= start then "end" else start end as last from e), m as (select o_custkey, last, min(o_orderkey) filter (where kind = 'deadline') as d1, min(o_orderkey) filter (where kind = 'event') as e1 from k group by all)
      select o_custkey, o_orderkey, start, "end", case when kind is null then null when kind = 'deadline' then case when e1 is null then kind else 'deadline+event' end else case when d1 is null then kind else 'event+deadline' end end as kinds from k join m using (o_custkey, last) qualify row_number() over (partition by o_custkey, last order by start, "end" is null, o_orderkey) = 1"""),
    "w7_last_of_day": (w7_last_of_day, "select user_id, ts::date as day, max(event_id) as event_id from events group by 1, 2"),
    "w8_gaps": (w8_gaps, f"select o_custkey, o_orderkey, date_diff('day', lag(o_orderdate::date) over w, o_orderdate::date) as gap, (sum({_CENTS}) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding))::bigint as running_cents from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)"),
    "w9_best_of_group": (w9_best_of_group, f"select o_custkey, o_orderkey, cents from (select *, {_CENTS} as cents, max({_CENTS}) over (partition by o_custkey) as top from orders) where cents * 10 >= top * 9 qualify row_number() over (partition by o_custkey order by o_orderpriority, cents desc, o_orderkey) = 1"),
    "w10_newest_five": (w10_newest_five, "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) <= 5"),
    "w12_w13_corpus_pick": (w12_w13_corpus_pick, "select doc_id, lang, position, position % 3 = 0 as held_out from (select doc_id, lang, row_number() over (order by turn, lang) as position from (select doc_id, lang, row_number() over (partition by lang order by doc_id) as turn from documents where lang is not null) order by turn, lang limit 120)"),
    "w14_post_ranks": (w14_post_ranks, "select l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as post_rank from lineitem"),
    "k1_top_orders": (k1_top_orders, "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50"),
    "k4_home_order": (k4_home_order, "select o_orderkey, o_orderpriority from orders order by case when o_orderkey % 3 = 0 then o_orderdate::date + 20 else o_orderdate::date end desc, case when o_orderkey % 4 > 0 then o_orderkey % 5 end asc nulls last, o_orderdate desc, o_orderkey desc limit 200"),
    "k7_name_rank": (k7_name_rank, "select p_partkey, p_name, rank from (select *, (case when p_name = 'small ring' then 0 when starts_with(p_name, 'small') then 1 when contains(p_name, 'small') then 2 else 3 end)::bigint as rank from part) order by rank, p_name, p_partkey limit 30"),
    "u1_u3_set_sizes": (u1_u3_set_sizes, "with k as (select distinct user_id, event_type from events), s as (select user_id, list(event_type) as a from k group by 1) select x.user_id, len(list_intersect(x.a, y.a)) as common, len(x.a) - len(list_intersect(x.a, y.a)) as missing, len(x.a) + len(y.a) - len(list_intersect(x.a, y.a)) as either from s x join s y on y.user_id = x.user_id + 1"),
    "c22_date_span": (c22_date_span, f"select l_orderkey, strftime(first, '%Y-%m-%d') as first, strftime(last, '%Y-%m-%d') as last from ({_SPANS}) where first <> last"),
    "c23_due_labels": (c23_due_labels, "select o_orderkey, case when n = 0 then 'D-DAY · ' else 'D-' || n || ' · ' end || month(d) || '/' || day(d) as label from (select o_orderkey, o_orderdate::date as d, date_diff('day', date '1998-06-15', o_orderdate::date) as n from orders) where n >= 0"),
    "c24_age_labels": (c24_age_labels, "select event_id, case when m < 60 then m || 'm' when m < 1440 then (m // 60) || 'h' else (m // 1440) || 'd' end as age from (select event_id, ((epoch(timestamp '2024-02-01 00:00:00')::bigint - floor(epoch(ts))::bigint) // 60)::bigint as m from events)"),
    "c25_weeks": (c25_weeks, "select date_trunc('week', ts)::date as week, count(*) as n from events group by 1"),
    "c27_academic_years": (c27_academic_years, "select y as year, n, make_date(y, 3, 1) as first, (make_date(y + 1, 3, 1) - interval 1 day)::date as last from (select year(o_orderdate) - (case when month(o_orderdate) < 3 then 1 else 0 end) as y, count(*) as n from orders group by 1)"),
    "c29_daily": (c29_daily, "select day, count(*) as open from (select unnest(generate_series(ts::date, ts::date + (event_id % 4)::int, interval 1 day))::date as day from events) group by 1"),
    "c31_c32_bell_periods": (c32_bell_periods, "select level, p as period, lpad((s // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') as start, lpad(((s + lesson) // 60)::varchar, 2, '0') || ':' || lpad(((s + lesson) % 60)::varchar, 2, '0') as \"end\" from (select level, lesson, p, (st + (p - 1) * (lesson + 10) + case when p > 4 then lunch - 10 else 0 end)::bigint as s from (values ('elementary', 540, 40, 50, 6), ('middle', 550, 45, 50, 7), ('high', 530, 50, 60, 7)) v(level, st, lesson, lunch, n), (select unnest(generate_series(1, 7)) as p) where p <= n)"),
    "f17_bell_validity": (f17_bell_validity, "with r as (select distinct l_suppkey as school, l_linenumber as period, 480 + l_linenumber * 60 as s, 480 + l_linenumber * 60 + floor(l_quantity)::int as e from lineitem), c as (select *, lag(period) over w as bp, lag(e) over w as be from r window w as (partition by school order by period, s)) select school, bool_and(period between 1 and 12 and s between 420 and 1260 and e - s between 20 and 120 and coalesce(bp <> period, true) and coalesce(be <= s, true)) as valid from c group by 1"),
}
