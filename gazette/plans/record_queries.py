"""Queries on records of people, scripts and models; on menus and link candidates; audits of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import links, records
from gazette.operators import crawl
from gazette.plans.base import Query, table
from gazette.plans.notice_queries import ISO, K, NUM, made, rows

_UUID = f"lpad({NUM(K)}, 8, '0') || '-0000-4000-8000-00000000000' || {NUM(K + ' % 10')}"
_GIVEN = {
    "call": f"case {K} % 4 when 0 then 'goView(''a,b'', \"' || {NUM(K)} || '\", null)' when 1 then 'f( 12 , undefined,x )' when 2 then 'nothing' else 'g(''' || {NUM(K)} || ''',)' end",
    "own": f"case {K} % 3 when 0 then ' 본문 ' || {NUM(K)} when 1 then ' ' end", "title": f"case {K} % 2 when 0 then '제목 ' || {NUM(K)} end", "chunk": f"case {K} % 5 when 0 then '' else '조각' end",
    "section": f"case {K} % 4 when 0 then '{{\"items\": [\"할 일 ' || {NUM(K)} || '\", {{\"text\": \"둘째\", \"hint\": \" 5월 \"}}, {{\"hint\": \"x\"}}, \" \"]}}' when 1 then '{{\"items\": 3}}' when 2 then 'not json' else '{{\"items\": []}}' end".replace("{{", "{").replace("}}", "}"),
    "plan": f"'[{{\"id\":\"a\",\"title\":\" 수영 \",\"dayOfWeek\":' || {NUM(K + ' % 9')} || ',\"startTime\":\"1' || {NUM(K + ' % 10')} || ':00\",\"endTime\":\"16:30\",\"color\":\"red\",\"memo\":\"m\"}},{{\"id\":\"b\",\"title\":\"x\",\"dayOfWeek\":0,\"startTime\":\"09:00\",\"endTime\":\"10:00\",\"color\":\"pink\",\"location\":\" \"}}]'".replace("{{", "{").replace("}}", "}"),
    "hidden": f"'[\"' || {_UUID} || '\", \"x\", 3]'",
}


def c15_c77_c79_c83_records(spark: SparkSession, d: str) -> DataFrame:
    g = rows(spark, d, _GIVEN)
    said = lambda a, f: F.array_join(F.transform(a, f), ";")
    return g.select(
        "id", F.array_join(records.script_arguments("call"), "|").alias("args"), records.source_text(F.lit(None).cast("string"), F.col("own"), F.col("title"), F.array("chunk", "chunk")).alias("source"), said(records.card_items("section"), lambda x: F.concat_ws("@", x["text"], x["hint"])).alias("items"),
        said(records.schedules("plan"), lambda x: F.concat_ws(",", x["day"], x["start"], x["end"], x["id"], x["title"], F.coalesce(x["location"], F.lit("-")), F.coalesce(x["memo"], F.lit("-")), x["color"])).alias("plans"), F.array_join(records.hidden_ids("hidden"), "|").alias("hidden"),
    )


_C15 = f"""with t as ({made(_GIVEN)}) select id, case id % 4 when 0 then 'a,b|' || id when 1 then '12|x' when 2 then '' else cast(id as varchar) end as args,
  case when id % 3 = 0 then '본문 ' || id when id % 2 = 0 and id % 5 <> 0 then '제목: 제목 ' || id || chr(10) || chr(10) || '조각' end as source, case when id % 4 = 0 then '할 일 ' || id || ';둘째@5월' else '' end as items,
  '0,09:00,10:00,b,x,-,-,pink' || case when id % 9 <= 6 and id % 10 < 7 then ';' || id % 9 || ',1' || id % 10 || ':00,16:30,a,수영,-,m,blue' else '' end as plans, lpad(cast(id as varchar), 8, '0') || '-0000-4000-8000-00000000000' || id % 10 as hidden from t"""

_FACTS = {"day": f"case {K} % 3 when 0 then '6월 1일' else '6월 2일' end", "due": f"case {K} % 4 when 0 then '' else {ISO} end", "thing": f"case {K} % 2 when 0 then '전자 담배' else '물통' end", "act": f"case {K} % 5 when 0 then 'Submit form' else '동의서 제출' end", "body": "'작성일 6월 1일 ' || repeat('가', 60) || ' 반입 금지: 전자담배. 6월 2일 행사'"}


def v16_v19_facts(spark: SparkSession, d: str) -> DataFrame:
    f = rows(spark, d, _FACTS)
    clean = records.sanitized({"dates": F.array("day"), "materials": F.array("thing"), "actions_required": F.array("act")}, F.col("body"), 2026)
    entries = records.backfill_entries(F.when(F.col("id") % 2 == 0, F.array(F.lit(" 2026-06-01 "), F.lit("곧"), F.col("due"))).otherwise(F.array(F.lit("곧"))), F.col("due"), F.array(F.lit("2026-07-01")))
    return f.select("id", clean.alias("c"), F.array_join(F.transform(entries, lambda x: F.concat_ws(":", x["event_date"], x["kind"])), ";").alias("entries")).select("id", F.concat_ws("/", F.size("c.dates"), F.size("c.materials"), F.size("c.actions_required")).alias("left"), F.col("c.refresh").alias("refresh"), "entries")


_V16 = f"""select id, case when id % 3 = 0 then 0 else 1 end || '/' || case when id % 2 = 0 then 0 else 1 end || '/' || case when id % 5 = 0 then 0 else 1 end as left, id % 3 = 0 or id % 2 = 0 as refresh,
  case when id % 2 = 0 then '2026-06-01:event' || case when id % 4 <> 0 then ';' || due || ':deadline' else '' end else '2026-07-01:event;' || due || ':deadline' end as entries from ({made(_FACTS)})"""

_PICTURES = {"html": f"'<img src=\"/a/' || {NUM(K)} || '.JPG\" alt=\"x\"><img src=''data:image/png;base64,x''><img data-src=\"b.png?v=1\" alt=\"2학년 일과표\"><img src=\"/logo.png\"><img src=\"/a/' || {NUM(K)} || '.JPG\"><img src=\"c.svg\">'", "kind": f"case {K} % 4 when 0 then '건강 검진 (1학년)' when 1 then '[알림] 소풍' else '소풍' end", "start": ISO, "end_": f"case {K} % 3 when 0 then cast(cast(o_orderdate as date) + cast(3 as int) as string) when 1 then '1990-01-01' end"}


def c4_c61_c76_pictures(spark: SparkSession, d: str) -> DataFrame:
    p = rows(spark, d, _PICTURES)
    pictures = records.page_images("html", F.lit("https://s.kr/dir/page"))
    return p.select("id", F.array_join(F.transform(pictures, lambda x: F.concat_ws("@", x["url"], x["alt"])), ";").alias("pictures"), records.title_key("kind").alias("key"), records.span_label(F.col("start"), F.col("end_")).alias("label"))


_C4 = f"""select id, 'https://s.kr/dir/b.png?v=1@2학년 일과표;https://s.kr/a/' || id || '.JPG@x' as pictures, case id % 4 when 0 then '건강검진1학년' when 1 then '알림소풍' else '소풍' end as key, replace("start"[6:10], '-', '/') || case when id % 3 = 0 then '–' || replace(end_[6:10], '-', '/') else '' end as label from ({made(_PICTURES)})"""


def c76_bell_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of a menu: a carousel's button, a script, a repeat, a long text, and timetables in some."""
    b = rows(spark, d, {"own": f"case {K} % 3 when 0 then ' 학교  일과표 ' when 1 then '등하교 시간' else '식단' end", "path": f"'/p' || {NUM(K)}"})
    link = lambda text, href: F.struct(text.alias("text"), href.alias("href"), F.concat(F.lit("https://s.kr"), href).alias("url"))
    menu = F.array(link(F.lit("학생마당"), F.lit("/a")), link(F.lit("일시정지"), F.lit("/b")), link(F.lit("일과표"), F.lit("#top")), link(F.lit("학생마당"), F.lit("/a")), link(F.repeat(F.lit("가"), 41), F.lit("/c")), link(F.lit(" "), F.lit("/d")), link(F.col("own"), F.col("path")))
    return b.select("id", F.array_join(F.transform(links.bell_candidates(menu), lambda x: F.concat_ws("@", x["text"], x["url"])), ";").alias("links"))


_C76 = f"select {K} as id, case {K} % 3 when 0 then '학교 일과표@https://s.kr/p' || {K} || ';학생마당@https://s.kr/a' when 1 then '등하교 시간@https://s.kr/p' || {K} || ';학생마당@https://s.kr/a' else '학생마당@https://s.kr/a;식단@https://s.kr/p' || {K} end as links from orders"


def t13_batches(spark: SparkSession, d: str) -> DataFrame:
    b = rows(spark, d, {"lang": f"case {K} % 4 when 0 then 'en' else 'vi' end", "phase": f"case {K} % 3 when 0 then 'complete' else 'pending' end", "one": f"case {K} % 5 when 0 then '' else {NUM(K + ' % 7')} end"})
    made_ = records.merged_batch(F.lit("vi"), F.array("one", "one"), F.when(F.col("id") % 11 > 0, F.col("lang")), F.array(F.lit("1"), F.lit("2")), F.array(F.lit("2")), F.col("phase"))
    return b.select("id", made_.alias("m")).select("id", F.array_join("m.ids", ",").alias("ids"), F.array_join("m.pending", ",").alias("pending"), "m.phase")


_T13 = """select id, case when e then '1,2' when f then o when k then '1,2' else '1,2,' || o end as ids, case when e then '2' when f then o when k then '2' else '2,' || o end as pending, case when e then ph when f then 'pending' when k then ph else 'pending' end as phase
  from (select o_orderkey as id, o_orderkey % 5 = 0 as e, o_orderkey % 11 = 0 or o_orderkey % 4 = 0 or o_orderkey % 3 = 0 as f, o_orderkey % 7 in (1, 2) as k, cast(o_orderkey % 7 as varchar) as o, case when o_orderkey % 3 = 0 then 'complete' else 'pending' end as ph from orders)"""

_MENU = {"label": f"case {K} % 5 when 0 then '가정통신문' when 1 then '알림마당' when 2 then '공지사항' when 3 then '급식' else '학교소식' end", "url": f"'https://s.kr/' || {NUM(K + ' % 300')}", "parent": f"{K} % 40"}


def c75_w11_k8_menus(spark: SparkSession, d: str) -> DataFrame:
    """Links under menus gain the menu's score; of links with one URL the best stays; the best hundred and twenty."""
    c = rows(spark, d, _MENU)
    scored = c.select("id", "label", "url", "parent", links.link_score("label", "url", F.lit("")).alias("score"))
    menus = scored.where("id < 40").select(F.col("id").alias("menu"), F.col("label").alias("menu_label"), F.col("score").alias("menu_score"))
    return crawl.best_links(crawl.expanded(scored, menus, "parent", "menu"), 120).select("url", "id", "context", F.col("score").cast("long").alias("score"), F.col("place").cast("long").alias("place"))


_C75 = f"""with s as (select id, label, url, parent, case label when '가정통신문' then 400 when '급식' then -30 when '공지사항' then 20 when '알림마당' then 20 else 40 end as score from ({made(_MENU)})),
  x as (select s.id, s.url, s.label, case when m.id is null then '' else m.label || ' > ' end as context, s.score + coalesce(m.score, 0) as score from s left join (select * from s where id < 40) m on s.parent = m.id),
  t as (select *, case when label = '가정통신문' then 0 when context like '가정통신문%' then 3 else 10 end as tier from x), b as (select * from t qualify row_number() over (partition by url order by tier, score desc, id) = 1)
  select url, id, context, score, row_number() over (order by tier, score desc, id) as place from b qualify place <= 120"""


def a14_c12_c13_signals(spark: SparkSession, d: str) -> DataFrame:
    """Sums of weighted signals by name; on a tie the one first named wins, and confidence is its sum in 120, under one."""
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ordinal"), F.col("l_returnflag").alias("signal"), (F.col("l_suppkey") % 4 * 20).alias("weight"))
    return crawl.detected(s.groupBy("page", "ordinal").agg(F.min("signal").alias("signal"), F.min("weight").alias("weight")), "page", "ordinal", "signal", "weight")


_A14 = """with l as (select l_orderkey as page, l_linenumber as o, min(l_returnflag) as s, min(l_suppkey % 4 * 20) as w from lineitem group by all), g as (select page, s, sum(w)::bigint as score, min(o) as o from l group by all)
  select page, s as signal, score, least(floor(score / 120.0::double * 100.0::double + 0.5::double) / 100.0::double, 0.99::double) as confidence from g qualify row_number() over (partition by page order by score desc, o) = 1"""


def v26_audit(spark: SparkSession, d: str) -> DataFrame:
    """Counts of tables for each nation against what is expected of it."""
    customers = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("customers"))
    suppliers = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("suppliers"))
    wanted = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.explode(F.array(F.lit("customers"), F.lit("suppliers"))).alias("part"), (F.col("n_nationkey") % 3).cast("long").alias("wanted"))
    return crawl.audited(customers.unionByName(suppliers), wanted, ["k", "part"], "n", "wanted")


_V26 = """with c as (select c_nationkey as k, 'customers' as part, count(*) as n from customer group by 1 union all select s_nationkey, 'suppliers', count(*) from supplier group by 1), w as (select n_nationkey as k, unnest(['customers', 'suppliers']) as part, (n_nationkey % 3)::bigint as wanted from nation)
  select w.k, w.part, coalesce(n, 0) as n, wanted, coalesce(n, 0) = wanted as as_expected from w left join c on w.k = c.k and w.part = c.part"""


QUERIES: dict[str, Query] = {
    "c15_c77_c79_c83_records": (c15_c77_c79_c83_records, _C15), "v16_v19_facts": (v16_v19_facts, _V16), "c4_c61_c76_pictures": (c4_c61_c76_pictures, _C4), "c76_bell_links": (c76_bell_links, _C76), "t13_batches": (t13_batches, _T13), "c75_w11_k8_menus": (c75_w11_k8_menus, _C75),
    "a14_c12_signals": (a14_c12_c13_signals, _A14), "v26_audit": (v26_audit, _V26),
}
