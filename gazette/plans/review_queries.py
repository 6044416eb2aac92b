"""Queries on values in context, model output, budgets, archives, attachments, pages of results, arms of an experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import review
from gazette.operators import limits
from gazette.plans.base import Query, table
from gazette.plans.notice_queries import DAY, ISO, K, MONTH, NUM, made, rows

_VALUES = {
    "day": f"case {K} % 2 when 0 then {MONTH} || '월 ' || {DAY} || '일' else '2026-06-01' end",
    "body": f"case {K} % 6 when 0 then '작성일: 2026. 6. 1. 작성자 김' when 1 then '체험학습 신청 마감 2026년 6월 1일' when 2 then '안내합니다' || chr(10) || '2026.06.01.' || chr(10) || '한빛초등학교장' when 3 then '등록일 2026.6.15. 조회수 3' when 4 then '작성일 ' || {MONTH} || '월 ' || {DAY} || '일' else '2026-06-01 행사, ' || repeat('가 ', 60) || ' 등록일 2026-06-01' end",
    "thing": f"case {K} % 3 when 0 then '전자 담배' when 1 then '준비물' else '' end", "rule": f"case {K} % 4 when 0 then '반입 금지 물품: 전자담배' when 1 then '준비물은 ' || repeat('나', 70) || ' 지참금지' when 2 then '가져오지 마세요 준비물' else '전자담배' end",
    "value": f"case {K} % 6 when 0 then 'Submit form' when 1 then '2026.5.1 ~ 5.3 (09:00)' when 2 then 'https://a.kr' when 3 then '신청 form' when 4 then ' ' else 'A-' || {NUM(K)} end",
}


def v13_v14_v15_values(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d, _VALUES).select("id", review.is_admin_date("day", "body", 2026).alias("admin"), review.is_forbidden("thing", "rule").alias("forbidden"), review.is_foreign("value").alias("foreign"))


_V13 = f"""with t as ({made(_VALUES)}), m as (select t.*, month(o_orderdate) = 6 and day(o_orderdate) = 1 as june, month(o_orderdate) as mo, day(o_orderdate) as da from t join orders on id = o_orderkey)
  select id, case id % 6 when 0 then june when 1 then false when 2 then june when 3 then false when 4 then true else false end as admin,
  case when id % 3 = 0 then id % 4 = 0 when id % 3 = 1 then id % 4 = 2 else false end as forbidden, id % 6 in (0, 5) as "foreign" from m"""

_ANSWERS = {
    "said": f"case {K} % 4 when 0 then 'Here: {{\"a\": \"x' || chr(92) || 'm' || {NUM(K)} || '\"}} done' when 1 then '{{\"a\": \"y' || chr(92) || chr(92) || 'm' || chr(92) || 'n\"}}' when 2 then 'no object' else '{{\"a\": \"u' || chr(92) || 'u0041\"}}' end",
    "title": f"case {K} % 3 when 0 then '[안내] Field Trip #' || {NUM(K)} when 1 then '---' else '가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허고노도로모보' end", "error": f"' Traceback' || chr(10) || '  line ' || {NUM(K)} || repeat(' x', 500)",
    "note": f"case {K} % 5 when 0 then '급식 식단표' when 1 then '참가비 납부 5월 3일' when 2 then '동의서 제출 긴급' when 3 then '안전 알레르기' else repeat('가', 700) end",
    "page": f"'  제목  ' || {NUM(K)} || chr(13) || '첨부파일' || chr(10) || chr(10) || ' 본문' || chr(9) || '끝 ' || chr(10) || 'Print'",
    "table_": f"case {K} % 3 when 0 then '앞' || chr(10) || '| 일시 |  |' || chr(10) || '|---|---|' || chr(10) || '| | 5월 ' || {NUM(K)} || ' |' || chr(10) || '뒤' when 1 then '| a | b | c |' || chr(10) || '| 1 | 2 | ' || {NUM(K)} || ' |' else '| 하나 |' || chr(10) || '|  |' end",
}


def c59_c66_c82_c2_c50(spark: SparkSession, d: str) -> DataFrame:
    a = rows(spark, d, {k: v.replace("{{", "{").replace("}}", "}") for k, v in _ANSWERS.items()}).withColumn("t", review.corpus_tags("note"))
    return a.select(
        "id", review.repaired_json("said").alias("json"), review.slug("title", F.concat(F.lit("notice-"), F.col("id").cast("string"))).alias("slug"), review.error_line("error").alias("error"), F.concat_ws("/", "t.kind", "t.length", "t.fact_density", "t.tone", "t.time_reference", "t.cultural_sensitivity").alias("tags"),
        review.clean_lines("page", ("첨부파일", "print")).alias("clean"), review.collapsed_tables("table_").alias("tables"),
    )


# Read alike by Spark and DuckDB: turns as models answer, whole, fenced, with a lone backslash, as a list, cut off, and without braces.
_MODEL = """case conv_id % 7 when 0 then '{"said": "' || replace(replace(replace(text, chr(92), ''), chr(34), ''), chr(10), ' ') || '", "turn": ' || turn || '}' when 1 then '```json' || chr(10) || '{"turn": ' || turn || '}' || chr(10) || '```'
  when 2 then 'Here: {"said": "' || chr(92) || 'm ' || replace(replace(replace(substr(text, 1, 40), chr(92), ''), chr(34), ''), chr(10), ' ') || '"} ok' when 3 then '[{"a": ' || turn || '}, {"b": 2}]' when 4 then '{"a": ' || turn || ', "b": [1' when 5 then '{"a": 1} and {"b": ' || turn || '}' else text end"""


def c59_answers(spark: SparkSession, d: str) -> DataFrame:
    """The object of each turn, read as a model's answer."""
    return table(spark, d, "conversations").select("conv_id", "turn", review.answer_object(F.expr(_MODEL)).alias("object")).where("object is not null")


_C59_ANSWERS = f"""with m as (select conv_id, turn, {_MODEL} as said from conversations), i as (select *, nullif(regexp_extract(said, '(?s)[{{].*[}}]', 0), '') as inner_ from m),
  p as (select conv_id, turn, case when json_valid(said) then said when json_valid(inner_) then inner_ else replace(inner_, chr(92) || 'm', chr(92) || chr(92) || 'm') end as j from i) select conv_id, turn, json(j)::varchar as object from p where json_valid(j) and json_type(j) = 'OBJECT'"""

_C59 = f"""select id, case id % 4 when 0 then '{{"a": "x' || chr(92) || chr(92) || 'm' || id || '"}}' when 1 then said when 3 then said end as json, case id % 3 when 0 then '안내-field-trip-' || id when 1 then 'notice-' || id else substr(title, 1, 32) end as slug,
  substr('Traceback line ' || id || repeat(' x', 500), 1, 800) as error, case id % 5 when 0 then 'meal-menu/short/meal-heavy/routine/no-deadline/neutral' when 1 then 'general-notice/short/date-and-fee-heavy/routine/absolute-dates/neutral' when 2 then 'event-consent-form/short/action-heavy/urgent/no-deadline/neutral' when 3 then 'meal-menu/short/meal-heavy/urgent/no-deadline/critical-allergen' else 'general-notice/medium/low/routine/no-deadline/neutral' end as tags,
  '제목 ' || id || chr(10) || '본문 끝' as clean, case id % 3 when 0 then '앞' || chr(10) || '일시' || chr(10) || '5월 ' || id || chr(10) || chr(10) || '뒤' when 1 then table_ else '하나' || chr(10) end as tables from ({made({k: v.replace("{{", "{").replace("}}", "}") for k, v in _ANSWERS.items()})})"""


def v20_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Items of an order as pictures to be read: three at most, and 60 units of cost."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("cost"))
    return limits.within_budget(items, "l_orderkey", "l_linenumber", F.col("cost"), 3, 60).select("l_orderkey", "l_linenumber", "admitted")


_V20 = """with recursive i as (select l_orderkey as k, l_linenumber as n, max(l_quantity)::bigint as c from lineitem group by all), o as (select *, row_number() over (partition by k order by n) as r from i),
  w as (select k, n, r, case when c <= 60 then 1 else 0 end as cnt, case when c <= 60 then c else 0 end as used, c <= 60 as ok from o where r = 1 union all select o.k, o.n, o.r, w.cnt + case when w.cnt < 3 and w.used + o.c <= 60 then 1 else 0 end, w.used + case when w.cnt < 3 and w.used + o.c <= 60 then o.c else 0 end, w.cnt < 3 and w.used + o.c <= 60 from w join o on o.k = w.k and o.r = w.r + 1)
  select k as l_orderkey, n as l_linenumber, ok as admitted from w"""


def s16_archives(spark: SparkSession, d: str) -> DataFrame:
    """Items of an order as entries of an archive."""
    e = table(spark, d, "lineitem").select("l_orderkey", F.concat("l_linenumber", F.lit(".xml")).alias("name"), (F.col("l_quantity") * 1_000_000).cast("long").alias("size"), F.when(F.col("l_partkey") % 50 == 0, 0).otherwise((F.col("l_quantity") * 1_000_000 / (F.col("l_suppkey") % 120 + 1)).cast("long")).alias("packed"))
    return limits.archive_errors(e, "l_orderkey", "name", "size", "packed", 100_000_000, 48_000_000)


_S16 = """with e as (select l_orderkey, (l_quantity * 1000000)::bigint as size, case when l_partkey % 50 = 0 then 0 else floor(l_quantity * 1000000 / (l_suppkey % 120 + 1))::bigint end as packed from lineitem)
  select l_orderkey, case when bool_or(size > 48000000) then 'zip_entry_too_large' when sum(size) > 100000000 then 'zip_uncompressed_too_large' when bool_or(packed = 0 and size > 0) then 'zip_invalid_zero_compressed_entry' when bool_or(packed > 0 and size > packed * 100.0::double) then 'zip_compression_ratio_too_high' end as error from e group by 1"""


def d8_attachments(spark: SparkSession, d: str) -> DataFrame:
    """Four references of each order: a repeated URL, a name written otherwise, a weak name."""
    r = rows(spark, d, {"a": "1"}).select("id", F.expr("inline(array(struct(1 as pos, concat('u', id % 3) as url, ' 가정 통신문.HWP' as name), struct(2 as pos, concat('u', id % 2) as url, '가정통신문.hwp' as name), struct(3 as pos, concat('u', id % 5) as url, 'download' as name), struct(4 as pos, concat('v', id) as url, 'Download' as name)))"))
    kept = limits.first_attachments(r, "id", "pos", "url", "name")
    return kept.select("id", F.col("pos").cast("long").alias("pos"), "url")


_D8 = """select o_orderkey as id, pos, url from (select o_orderkey, 1::bigint as pos, 'u' || o_orderkey % 3 as url from orders union all select o_orderkey, 3, 'u' || o_orderkey % 5 from orders where o_orderkey % 5 <> o_orderkey % 3 union all select o_orderkey, 4, 'v' || o_orderkey from orders)"""


def s9_pages(spark: SparkSession, d: str) -> DataFrame:
    """Days and kinds of events as entries on pages of a hundred; the twelfth page and what follows a short one are not read."""
    e = table(spark, d, "events").select(((F.col("event_id") - F.col("event_id") % 100) / 100 + 1).cast("int").alias("page"), (F.col("event_id") % 100).alias("row"), F.to_date("ts").alias("day"), F.col("event_type").alias("title"), "event_id")
    return limits.paged_entries(e, "page", ["day", "title"]).select("day", "title", "event_id").orderBy("day", "title")


_S9 = """with e as (select event_id // 100 + 1 as page, event_id % 100 as r, ts::date as day, event_type as title, event_id from events), c as (select page, count(*) as n from e group by 1), l as (select min(page) as last from c where n < 100 or page >= 10)
  select day, title, event_id from e, l where last is null or page <= last qualify row_number() over (partition by day, title order by page desc, r desc) = 1 order by day, title"""


def v23_arms(spark: SparkSession, d: str) -> DataFrame:
    p = rows(spark, d, {"base": f"case when {K} % 3 = 0 then 'passed' else 'failed' end", "arm": f"case when {K} % 5 = 0 then 'failed' else 'passed' end", "text": f"case when {K} % 7 = 0 then 'x {{{{a}}}}' end", "status": f"case when {K} % 11 = 0 then 'driver_error' else 'ok' end"})
    return limits.regressions(p, "base", "arm", "text", "status")


_V23 = "select count(*) filter (where o_orderkey % 3 = 0 and o_orderkey % 5 = 0) as lost, count(*) filter (where o_orderkey % 7 = 0) as placeholders, count(*) filter (where o_orderkey % 11 = 0) as errors from orders"


def k5_calendar_order(spark: SparkSession, d: str) -> DataFrame:
    """Spans by start, then by their end, which is the start where it is missing or earlier; the place is part of the result."""
    from pyspark.sql import Window

    s = rows(spark, d, {"school": "o_custkey", "start": ISO, "end_": f"case {K} % 4 when 0 then cast(cast(o_orderdate as date) + cast(3 as int) as string) when 1 then cast(cast(o_orderdate as date) - cast(2 as int) as string) end"})
    end = F.when(F.col("end_") >= F.col("start"), F.col("end_")).otherwise(F.col("start"))
    return s.select("school", "id", F.row_number().over(Window.partitionBy("school").orderBy("start", end, "id")).cast("long").alias("place"))


_K5 = f"""select o_custkey as school, {K} as id, row_number() over (partition by o_custkey order by o_orderdate::date, case when {K} % 4 = 0 then o_orderdate::date + 3 else o_orderdate::date end, {K}) as place from orders"""


def f12_f14_visible(spark: SparkSession, d: str) -> DataFrame:
    """What may be shown of a job: the listed fields of its type, and only from a day on and not if excluded."""
    kinds = {"translation": ("notice_id", "target_language"), "discovery": ("school_id", "max_posts")}
    payload = F.create_map(F.lit("notice_id"), F.col("id").cast("string"), F.lit("target_language"), F.lit("en"), F.lit("school_id"), F.col("school").cast("string"), F.lit("secret"), F.lit("s"))
    r = rows(spark, d, {"school": "o_custkey", "day": ISO, "kind": f"case {K} % 3 when 0 then 'translation' when 1 then 'discovery' else 'other' end"}).withColumn("p", payload)
    allowed = F.coalesce(F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("kind")], F.array().cast("array<string>"))
    shown = F.map_filter("p", lambda k, _: F.array_contains(allowed, k))
    return r.where((F.col("day") >= "1996-01-01") & ~F.col("id").isin(4, 7, 32)).select("id", F.array_join(F.transform(F.array_sort(F.map_keys(shown)), lambda k: F.concat_ws("=", k, shown[k])), "&").alias("shown"))


_F12 = f"select {K} as id, case {K} % 3 when 0 then 'notice_id=' || {K} || '&target_language=en' when 1 then 'school_id=' || o_custkey else '' end as shown from orders where o_orderdate::date >= date '1996-01-01' and {K} not in (4, 7, 32)"


QUERIES: dict[str, Query] = {
    "c59_answers": (c59_answers, _C59_ANSWERS), "v13_v14_v15_values": (v13_v14_v15_values, _V13), "c2_c50_c59_c66_c82_texts": (c59_c66_c82_c2_c50, _C59), "v20_budgets": (v20_budgets, _V20), "s16_archives": (s16_archives, _S16), "d8_attachments": (d8_attachments, _D8), "s9_pages": (s9_pages, _S9), "v23_arms": (v23_arms, _V23),
    "k5_calendar_order": (k5_calendar_order, _K5), "f12_f14_visible": (f12_f14_visible, _F12),
}
