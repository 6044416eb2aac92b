"""Queries on boards and calendars: predicates on state, picks by priority, first-wins duplicates, dates, light cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.functions.text import first_non_blank, lines, round_half_up
from gazette.functions.dates import iso_dates
from gazette.functions.notices import default_confidence, earliest, is_actionable, source_status
from gazette.functions.records import title_key
from gazette.operators import ingest
from gazette.operators.summary import AXES, weighted_mark
from gazette.plans.base import Query, table

def f2_first_filled(spark: SparkSession, d: str) -> DataFrame:
    """The first of several fields that is not blank."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.char_length(first_non_blank("text", "role")).cast("long").alias("n"))


def f7_needs_first_visit(spark: SparkSession, d: str) -> DataFrame:
    """Schools without a board that were never checked, or whose state is one to be tried again."""
    board, state = F.expr("case when o_orderkey % 4 = 0 then 'https://s.kr' when o_orderkey % 4 = 1 then '' end"), F.expr("case o_orderkey % 9 when 0 then 'pending' when 1 then 'internal_error' when 2 then 'fetch_timeout' when 3 then 'fetch_unavailable' when 4 then 'homepage_missing' when 5 then 'homepage_fetch_failed' when 6 then 'ok' when 7 then 'unsupported' end")
    return table(spark, d, "orders").select("o_orderkey", ingest.needs_first_crawl(board, F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderdate")), state).alias("due"))


def f8_probe_again(spark: SparkSession, d: str) -> DataFrame:
    """Feeds' states, one an order, on the day of the last."""
    state = F.expr("case o_orderkey % 5 when 0 then 'ok' when 1 then 'unsupported' when 2 then 'unknown' when 3 then '' end")
    board, checked = F.expr("case when o_orderkey % 7 = 0 then 'old' else 'b' end"), F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", ingest.should_probe(state, board, F.lit("b"), checked, F.lit("1998-08-02").cast("timestamp")).alias("due"))


def f16_actionable_turns(spark: SparkSession, d: str) -> DataFrame:
    """A concrete cue keeps a line; a mere courtesy drops it; else it stays unless it is empty."""
    said = F.expr("case o_orderkey % 5 when 0 then '동의서 제출에 협조' when 1 then '점검에 협조 바랍니다 ' || o_orderkey when 2 then '' when 3 then '확인 ' || o_orderkey else '유의 사항 접수 ' || o_orderkey end")
    return table(spark, d, "orders").select("o_orderkey", is_actionable(said).alias("kept"))


def j14_paired_arms(spark: SparkSession, d: str) -> DataFrame:
    """Two arms compared over the keys that both have."""
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    left = days.where("event_type = 'click'").select("day", F.col("n").alias("clicks"))
    right = days.where("event_type = 'error'").select("day", F.col("n").alias("errors"))
    return left.join(right, "day").select("day", "clicks", "errors", (F.col("clicks") - F.col("errors")).alias("gap"))


def j15_cache_fill(spark: SparkSession, d: str) -> DataFrame:
    """Cached days, and fetched days that the cache lacks."""
    by_day = lambda df, origin: df.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit(origin))
    orders = table(spark, d, "orders")
    cached, fetched = by_day(orders.where("o_orderstatus = 'P'"), "cached"), by_day(orders, "fetched")
    return cached.unionByName(fetched.join(cached, "day", "left_anti"))


def j17_update_from(spark: SparkSession, d: str) -> DataFrame:
    """Parts with the size that newer rows bring, where they bring one."""
    new = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").cast("int").alias("quantity"))
    return table(spark, d, "part").join(new, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("quantity", "p_size").alias("p_size"))


def a3_run_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 100).alias("large"), F.countDistinct("user_id").alias("users"), F.sum(F.floor("value").cast("long")).alias("calls"))


def a7_first_seen_types(spark: SparkSession, d: str) -> DataFrame:
    """Distinct event types of each user in the order of their first event; one row a type before they are gathered."""
    first = table(spark, d, "events").where("user_id is not null and event_type is not null").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    types = F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.array_join(types, ",").alias("types"))


def a10_weighted_axes(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean of eight marks from 0 to 5."""
    marks = [F.pmod(F.floor(F.col("p_size") / (i + 1)), F.lit(6)).cast("double") for i in range(len(AXES))]
    return table(spark, d, "part").select("p_partkey", weighted_mark(marks).alias("mark"))


def a11_earliest_deadline(spark: SparkSession, d: str) -> DataFrame:
    """Earliest whole date of an order over four origins, of which some give none or something else."""
    iso = lambda days: F.expr(f"cast(cast(o_orderdate as date) + cast({days} as int) as string)")
    none = F.array().cast("array<string>")
    facts, translated = F.when(F.col("o_orderkey") % 2 == 0, F.array(iso("o_orderkey % 9"), F.lit("곧"))).otherwise(none), F.when(F.col("o_orderkey") % 3 == 0, F.array(iso("5"))).otherwise(none)
    metadata, cards = F.array(F.when(F.col("o_orderkey") % 5 == 0, iso("1")).otherwise("5월 중")), F.when(F.col("o_orderkey") % 7 == 0, F.array(iso("3"), iso("5"))).otherwise(none)
    return table(spark, d, "orders").select("o_orderkey", earliest(facts, translated, metadata, cards).alias("due"))


def w2_keep_newest_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("value").desc_nulls_last(), F.col("ts").desc_nulls_last(), F.col("event_id").desc_nulls_last()]
    rank = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(*order))
    return table(spark, d, "events").withColumn("rn", rank).where("rn = 1").select("user_id", "event_type", "event_id")


def w5_latest_per_user(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", F.col("m.event_id").alias("event_id"))


def w11_best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Of the orders of a customer: least priority, then largest price, then least key."""
    best = F.min_by("o_orderkey", F.struct("o_orderpriority", -F.col("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(best.alias("o_orderkey"))


def k3_targets(spark: SparkSession, d: str) -> DataFrame:
    """The fifty customers to visit first: those never visited, then the oldest visit, then the key."""
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    rows = table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.orderBy(F.col("last").asc_nulls_first(), "c_custkey").limit(50).select("c_custkey", F.to_date("last").alias("last"))


def k9_five_items(spark: SparkSession, d: str) -> DataFrame:
    """The five dearest items of each order; the hint goes with the first alone."""
    order = [F.col("l_extendedprice").desc(), "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, d, "lineitem").withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))).where("rn <= 5")
    return rows.select("l_orderkey", F.col("rn").cast("long").alias("rn"), "l_extendedprice", F.when(F.col("rn") == 1, F.to_date("l_shipdate")).alias("hint"))


def u4_u6_sets(spark: SparkSession, d: str) -> DataFrame:
    """Nations of suppliers and customers: rows of the union, and keys that both have."""
    s, c = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    both = s.unionByName(c).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return both.join(s.intersect(c), "k", "left_semi")


def d6_first_of_source(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each pair of language and source."""
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


def d7_first_of_post(spark: SparkSession, d: str) -> DataFrame:
    """The first page of each post of a host; a url without a post id is its own key."""
    post = F.nullif(F.regexp_extract("url", r"/([0-9]+)(?:[?#]|$)", 1), F.lit(""))
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1))
    key = F.coalesce(F.concat_ws(":", host, post), F.col("url"))
    key = F.when(post.isNull(), F.col("url")).otherwise(key)
    return table(spark, d, "pages").groupBy(key.alias("key")).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


def d13_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha"))


def c21_iso_dates(spark: SparkSession, d: str) -> DataFrame:
    """ISO dates of the span that each order names, twice the same in some, by date."""
    said = F.expr("'접수 ' || cast(cast(o_orderdate as date) as string) || ' ~ ' || cast(cast(o_orderdate as date) + cast(o_orderkey % 3 as int) as string) || ' 2024-5-1'")
    return table(spark, d, "orders").select(F.explode(iso_dates(said)).alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


def c26_window_bounds(spark: SparkSession, d: str) -> DataFrame:
    month = F.trunc("o_orderdate", "MM")
    return table(spark, d, "orders").select("o_orderkey", F.add_months(month, -2).alias("low"), F.add_months(month, 3).alias("high"))


def c28_compact_dates(spark: SparkSession, d: str) -> DataFrame:
    compact = F.date_format("o_orderdate", "yyyyMMdd")
    return table(spark, d, "orders").select("o_orderkey", compact.alias("compact"), F.to_date(compact, "yyyyMMdd").alias("day"))


def c30_calendar_links(spark: SparkSession, d: str) -> DataFrame:
    """Calendar links of all-day entries; their end is exclusive."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    end = F.date_add(F.to_date("o_orderdate"), 1)
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("action=TEMPLATE&dates="), day("o_orderdate"), F.lit("/"), day(end), F.lit("&text="), F.url_encode("o_orderpriority")).alias("link"))


def c40_markers(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a marker each, and the text that is read back from them."""
    marked = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.posexplode(lines("text")).alias("i", "line"))
    marked = marked.select("conv_id", "turn", F.format_string("[[M%03d]] %s", F.col("i") + 1, F.col("line")).alias("row"))
    return marked.select("conv_id", "turn", F.regexp_extract("row", r"^\[\[(M[0-9]+)\]\] ", 1).alias("marker"), F.char_length(F.regexp_replace("row", r"^\[\[M[0-9]+\]\] ", "")).cast("long").alias("n"))


def c45_squeezed(spark: SparkSession, d: str) -> DataFrame:
    """Three or more spaces within a line become one; table rows and indents stay."""
    squeezed = F.transform(lines("text"), lambda x: F.when(x.rlike("^[ ]*[|]"), x).otherwise(F.regexp_replace(x, "([^ ]) {3,}", "$1 ")))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(F.array_join(squeezed, "\n").cast("binary"), 256).alias("sha"))


def c62_deadlines_only(spark: SparkSession, d: str) -> DataFrame:
    """Of a notice about health checks with deadlines only these stay; rows without a notice are grouped by their title."""
    urgent = F.col("o_orderpriority").startswith("1")
    title = F.expr("case when o_custkey % 2 = 0 then ' 건강 검진 (' || o_custkey || ')' else '소풍 ' || o_custkey end")
    group = F.coalesce(F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey").cast("string")), title_key(title))
    rows = table(spark, d, "orders").withColumn("any", F.max(urgent).over(Window.partitionBy(group)))
    return rows.where(~(F.col("any") & title_key(title).contains("건강검진")) | urgent).select("o_orderkey", "o_custkey")


def c81_source_status(spark: SparkSession, d: str) -> DataFrame:
    """Statuses and confidences of texts by method."""
    status = F.expr("case doc_id % 4 when 0 then 'failed' when 1 then 'partial_success' else 'success' end")
    method = F.expr("case doc_id % 5 when 0 then 'model_ocr' when 1 then 'html' when 2 then 'hwpx_xml' else 'other' end")
    text = F.when(F.col("doc_id") % 7 == 0, F.substring("text", 1, 12)).otherwise(F.col("text"))
    final = source_status(status, text)
    return table(spark, d, "documents").select("doc_id", final.alias("status"), default_confidence(method, final).alias("confidence"))


_AXES_SQL = " + ".join(f"(floor(p_size::double / {i}.0::double)::bigint % 6)::double * {w}::double" for i, w in ((1, 1.0), (2, 1.0), (3, 0.8), (4, 0.8), (5, 0.7), (6, 0.8), (7, 0.7), (8, 2.0)))
_POST = r"nullif(regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1), '')"

QUERIES: dict[str, Query] = {
    "f2_first_filled": (f2_first_filled, "select conv_id, turn, length(coalesce(nullif(trim(text, ' '), ''), role)) as n from conversations"),
    "f7_needs_first_visit": (f7_needs_first_visit, "select o_orderkey, o_orderkey % 4 <> 0 and (o_orderkey % 10 = 0 or o_orderkey % 9 in (0, 1, 2, 3, 4, 5, 8)) as due from orders"),
    "f8_probe_again": (f8_probe_again, "select o_orderkey, case when o_orderkey % 5 in (3, 4) or o_orderkey % 7 = 0 then true when o_orderkey % 5 = 0 then false when o_orderkey % 5 = 1 then o_orderkey % 11 = 0 or timestamp '1998-08-02 00:00:00' - o_orderdate >= interval 30 day else true end as due from orders"),
    "f16_actionable_turns": (f16_actionable_turns, "select o_orderkey, o_orderkey % 5 in (0, 3, 4) as kept from orders"),
    "j14_paired_arms": (j14_paired_arms, "with e as (select ts::date as day, event_type, count(*) as n from events group by all) select a.day, a.n as clicks, b.n as errors, a.n - b.n as gap from e a join e b on a.day = b.day where a.event_type = 'click' and b.event_type = 'error'"),
    "j15_cache_fill": (j15_cache_fill, "with c as (select o_orderdate::date as day, count(*) as n from orders where o_orderstatus = 'P' group by 1), f as (select o_orderdate::date as day, count(*) as n from orders group by 1) select day, n, 'cached' as origin from c union all select day, n, 'fetched' from f where day not in (select day from c)"),
    "j17_update_from": (j17_update_from, "select p_partkey, coalesce(q, p_size) as p_size from part left join (select l_partkey, max(l_quantity)::int as q from lineitem group by 1) on p_partkey = l_partkey"),
    "a3_run_summary": (a3_run_summary, "select event_type, count(*) as n, count(*) filter (where value > 100) as large, count(distinct user_id) as users, sum(floor(value)::bigint)::bigint as calls from events group by 1"),
    "a7_first_seen_types": (a7_first_seen_types, "with f as (select user_id, event_type, ts, event_id from events where user_id is not null and event_type is not null qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1) select user_id, string_agg(event_type, ',' order by ts, event_id) as types from f group by 1"),
    "a10_weighted_axes": (a10_weighted_axes, f"select p_partkey, floor(({_AXES_SQL}) / 8.8::double * 100.0::double + 0.5::double) / 100.0::double as mark from part"),
    "a11_earliest_deadline": (a11_earliest_deadline, "select o_orderkey, cast(list_min(list_concat(case when o_orderkey % 2 = 0 then [o_orderdate::date + (o_orderkey % 9)::int] else [] end, case when o_orderkey % 3 = 0 then [o_orderdate::date + 5] else [] end, case when o_orderkey % 5 = 0 then [o_orderdate::date + 1] else [] end, case when o_orderkey % 7 = 0 then [o_orderdate::date + 3] else [] end)) as varchar) as due from orders"),
    "w2_keep_newest_nulls_last": (w2_keep_newest_nulls_last, "select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by value desc nulls last, ts desc nulls last, event_id desc nulls last) = 1"),
    "w5_latest_per_user": (w5_latest_per_user, "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1"),
    "w11_best_candidate": (w11_best_candidate, "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderpriority, o_totalprice desc, o_orderkey) = 1"),
    "k3_targets": (k3_targets, "select c_custkey, last::date as last from (select c_custkey, last from customer left join (select o_custkey, max(o_orderdate) as last from orders group by 1) on c_custkey = o_custkey order by last asc nulls first, c_custkey limit 50)"),
    "k9_five_items": (k9_five_items, "select l_orderkey, rn, l_extendedprice, case when rn = 1 then l_shipdate::date end as hint from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey, l_suppkey) as rn from lineitem) where rn <= 5"),
    "u4_u6_sets": (u4_u6_sets, "select k, count(*) as n from (select s_nationkey as k from supplier union all select c_nationkey from customer) where k in (select s_nationkey from supplier intersect select c_nationkey from customer) group by k"),
    "d6_first_of_source": (d6_first_of_source, "select lang, source, min(doc_id) as doc_id, count(*) as n from documents group by all"),
    "d7_first_of_post": (d7_first_of_post, rf"select case when {_POST} is null then url else lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) || ':' || {_POST} end as key, min(page_id) as page_id, count(*) as n from pages group by 1"),
    "d13_content_hash": (d13_content_hash, "select page_id, sha256(html) as sha from pages"),
    "c21_iso_dates": (c21_iso_dates, "select day, count(*) as n from (select cast(o_orderdate::date as varchar) as day from orders union all select cast(o_orderdate::date + (o_orderkey % 3)::int as varchar) from orders where o_orderkey % 3 > 0) group by 1"),
    "c26_window_bounds": (c26_window_bounds, "select o_orderkey, (date_trunc('month', o_orderdate) - interval 2 month)::date as low, (date_trunc('month', o_orderdate) + interval 3 month)::date as high from orders"),
    "c28_compact_dates": (c28_compact_dates, "select o_orderkey, strftime(o_orderdate, '%Y%m%d') as compact, o_orderdate::date as day from orders"),
    "c30_calendar_links": (c30_calendar_links, "select o_orderkey, 'action=TEMPLATE&dates=' || strftime(o_orderdate, '%Y%m%d') || '/' || strftime(o_orderdate + interval 1 day, '%Y%m%d') || '&text=' || replace(url_encode(o_orderpriority), '%20', '+') as link from orders"),
    "c40_markers": (c40_markers, "select conv_id, turn, 'M' || lpad(i::varchar, 3, '0') as marker, length(line) as n from (select conv_id, turn, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from conversations where text is not null)"),
    "c45_squeezed": (c45_squeezed, "select doc_id, sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda x: case when regexp_matches(x, '^[ ]*[|]') then x else regexp_replace(x, '([^ ]) {3,}', '\\1 ', 'g') end), chr(10))) as sha from documents where text is not null"),
    "c62_deadlines_only": (c62_deadlines_only, "select o_orderkey, o_custkey from orders o where o_orderpriority like '1%' or o_custkey % 2 = 1 or o_custkey not in (select o_custkey from orders where o_orderpriority like '1%')"),
    "c81_source_status": (c81_source_status, r"""with s as (select doc_id, case doc_id % 4 when 0 then 'failed' when 1 then 'partial_success' else case when length(regexp_replace(coalesce(case when doc_id % 7 = 0 then substr(text, 1, 12) else text end, ''), '^[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')) < 20 then 'empty_or_unreadable' else 'success' end end as status from documents)
      select doc_id, status, case when status not in ('success', 'partial_success') then 0.0::double when doc_id % 5 = 0 then 0.72::double when doc_id % 5 in (1, 2) then 0.86::double else 0.65::double end as confidence from s"""),
}
