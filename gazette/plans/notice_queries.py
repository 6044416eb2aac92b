"""Queries on notices: facts, refinement, bells, meals, locales, cards, events, sources, links.

The tables have no notices, so each query writes notice texts from the columns of a whole table, by expressions that
both engines read alike, and applies the library's functions to them. The SQL states the rules again, in literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import facts, links, locales, notices, refine, school
from gazette.functions import text as X
from gazette.operators import dedup
from gazette.plans.base import Query, dealt, spread, table

# Parts of texts, read by both engines.
K = "o_orderkey"
MONTH, DAY, ISO = "cast(month(o_orderdate) as string)", "cast(day(o_orderdate) as string)", "cast(cast(o_orderdate as date) as string)"
NUM = "cast({} as string)".format


def rows(spark: SparkSession, d: str, exprs: dict[str, str]) -> DataFrame:
    used = [c for c in table(spark, d, "orders").columns if c == K or any(c in e for e in exprs.values())]
    return dealt(table(spark, d, "orders").select(*used)).selectExpr(f"{K} as id", *[f"{e} as {n}" for n, e in exprs.items()])


def made(exprs: dict[str, str]) -> str:
    return f"select {K} as id, " + ", ".join(f"{e} as {n}" for n, e in exprs.items()) + " from orders"


def joined(c) -> F.Column:
    return F.array_join(F.array_sort(c), ",")


_FACTS = {
    "dates": f"case {K} % 4 when 0 then {ISO} || '~' || {ISO} when 1 then '작성' || {ISO} when 2 then {MONTH} || '월 ' || {DAY} || '일, 2026학년도' else 'until ' || {ISO} || '.' end",
    "times": f"case {K} % 3 when 0 then {NUM(K + ' % 30')} || ':' || lpad({NUM(K + ' % 70')}, 2, '0') || '~' || '9:05' when 1 then '40분' else '오전9:30 (10:00)' end",
    "contacts": f"case {K} % 5 when 0 then '032-' || lpad({NUM(K + ' % 1000')}, 3, '0') || '-' || lpad({NUM(K + ' % 9999')}, 4, '0') when 1 then '+82 32-' || lpad({NUM(K + ' % 1000')}, 3, '0') || '-0096' when 2 then 'Help' || {NUM(K + ' % 50')} || '@School.kr 문의' when 3 then '안전복지과' else 'https://Open.Chat.kr/o/Ab/.' end",
    "urls": f"case {K} % 3 when 0 then 'https://Www.School.kr/Board/' || {NUM(K)} || '/' when 1 then '학교 홈페이지' else 'see https://a.kr, https://B.kr/X.' end",
    "fees": f"case {K} % 7 when 0 then '무료' when 1 then '0원' when 2 then ' Free' when 3 then '교육청 전액 지원' when 4 then {NUM(K)} || ' KRW' when 5 then '1,' || lpad({NUM(K + ' % 1000')}, 3, '0') || '원' else '회비 별도' end",
    "grades": f"case {K} % 8 when 0 then '1, 2, ' || {NUM(K + ' % 6')} || '학년' when 1 then 'Grades 1, 2' when 2 then '1st, 2nd, 3rd grade' when 3 then 'grade:' || {NUM(K + ' % 6')} when 4 then 'A반' when 5 then '5' when 6 then 'Grade 3 and 4' else '3rd grade' end",
}
_W = "[^0-9A-Za-z_가-힣:-]+"
_FACT_LISTS = f"""list_distinct(list_filter(regexp_split_to_array(dates, '{_W}'), lambda x: regexp_full_match(x, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'))) as dates,
  list_distinct(list_transform(list_filter(regexp_split_to_array(times, '{_W}'), lambda x: regexp_full_match(x, '([01]?[0-9]|2[0-3]):[0-5][0-9]')), lambda x: lpad(x, 5, '0'))) as times,
  list_distinct(list_concat(list_transform(regexp_extract_all(lower(contacts), '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}'), lambda x: 'email:' || x),
    case when contacts like 'https:%' then ['https://open.chat.kr/o/Ab'] else [] end,
    list_transform(list_filter(list_transform(regexp_extract_all(contacts, '\\+?[0-9][0-9() .-]{{7,}}[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) >= 8), lambda x: 'phone:' || case when starts_with(x, '82') then '0' || x[3:] else x end))) as contacts,
  case when urls like 'https:%' then ['https://www.school.kr/Board/' || id] when urls like 'see%' then ['https://a.kr', 'https://b.kr/X'] else ['학교 홈페이지'] end as urls,
  case when trim(lower(fees)) in ('무료', 'free') or fees like '%전액 지원%' or regexp_replace(fees, '[^0-9]', '', 'g') = '0' then ['free'] when regexp_matches(fees, '[0-9]') then ['amount:' || cast(cast(regexp_replace(fees, '[^0-9]', '', 'g') as bigint) as varchar)] else [fees] end as fees,
  list_distinct(list_transform(case when grades = 'A반' then [] else regexp_extract_all(grades, '[0-9]+') end, lambda x: 'grade:' || x)) as grades"""
_OUT = {n: e.replace(K, f"({K} + case when {K} % 11 = 0 then 1 else 0 end)") for n, e in _FACTS.items()}


def v6_fact_values(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name, f: joined(f(F.array(name))).alias(name)
    return rows(spark, d, _FACTS).select("id", one("dates", facts.dates), one("times", facts.times), one("contacts", facts.contacts), one("urls", facts.urls), one("fees", facts.fees), one("grades", facts.grades))


def v5_fact_issues(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a notice against those of its translation, which differs in one of eleven; dates of the output are filed as deadlines."""
    both = rows(spark, d, _FACTS | {f"out_{n}": e for n, e in _OUT.items()} | {"meal": f"{K} % 13 = 0", "mapped": f"{K} % 26 = 0"})
    names = {"dates": "dates", "times": "times", "fees": "fees", "contacts": "contacts", "urls": "urls", "grade_class_targets": "grades"}
    none = F.array().cast("array<string>").alias("deadlines")
    source = facts.comparable(F.struct(*[F.array(c).alias(f) for f, c in names.items()], none))
    out = facts.comparable(F.struct(*[F.array(f"out_{c}").alias(f) if f != "dates" else F.array().cast("array<string>").alias(f) for f, c in names.items()], F.array("out_dates").alias("deadlines")))
    judged = both.select("id", source.alias("s"), out.alias("o"), "meal", "mapped").select("id", facts.fact_issues(F.col("s"), F.col("o"), F.col("meal"), F.col("mapped")).alias("i"))
    said = F.transform("i", lambda x: F.concat_ws(":", x["field"], x["issue"], F.array_join(x["values"], "|")))
    return judged.select("id", F.array_join(said, ";").alias("issues"), facts.fact_verdict(F.col("i"))["verdict"].alias("verdict"), facts.fact_verdict(F.col("i"))["severity"].alias("severity"))


def _issue_sql(name: str, field: str, new: bool) -> str:
    gone = lambda a, b, issue: f"case when len(list_filter({a}.{name}, lambda x: not list_contains({b}.{name}, x))) > 0 then '{field}:{issue}:' || array_to_string(list_sort(list_filter({a}.{name}, lambda x: not list_contains({b}.{name}, x))), '|') end"
    return gone("s", "o", "missing") + (", " + gone("o", "s", "new") if new else "")


_V5 = f"""with s as (select id, {_FACT_LISTS} from ({made(_FACTS)})), b as ({made(_OUT)}), o as (select id, {_FACT_LISTS.replace("|| id]", "|| (id + case when id % 11 = 0 then 1 else 0 end)]")} from b),
  i as (select s.id, list_filter([{", ".join(_issue_sql(n, f, w) for n, f, w in (("dates", "dates", True), ("times", "times", True), ("fees", "fees", True), ("contacts", "contacts", True), ("urls", "urls", True), ("grades", "grade_class_targets", False)))},
    case when s.id % 13 = 0 and s.id % 26 <> 0 then 'meal_and_allergy:unmapped:' end], lambda x: x is not null) as i from s join o on s.id = o.id)
  select id, array_to_string(i, ';') as issues, case when len(i) = 0 then 'PASS' else 'FAIL' end as verdict, case when len(i) = 0 then 'none' else 'high' end as severity from i"""

# Refinement.
_BODY = {
    "body": f"'◉ 체험학습 안내' || chr(10) || '작성자: 김' || {NUM(K + ' % 9')} || chr(10) || '조회수' || chr(10) || '15' || chr(10) || '일시   ' || {MONTH} || '월 ' || {DAY} || '일 9:' || lpad({NUM(K + ' % 60')}, 2, '0') || '까지 제출해 주세요.' || chr(10) || '| 구분 | 값 |' || chr(10) || '| a    b | ' || {ISO} || ' |' || chr(10) || '문의 032-123-' || lpad({NUM(K + ' % 9999')}, 4, '0') || ' a' || {NUM(K)} || '@b.kr https://s.kr/p/' || {NUM(K)} || chr(10) || '  들여   쓰기' || chr(10) || '- 1 -' || chr(10) || '![그림](x.png)[신청](https://s.kr/' || {NUM(K)} || ')[설명 본문](https://s.kr/신청)'"
}
_TOKENS = "⟦[TUEPMD][0-9]+⟧"


def c41_c42_masks(spark: SparkSession, d: str) -> DataFrame:
    """Masked texts, and what comes back when an edit drops the first line and every third notice's tables."""
    m = rows(spark, d, _BODY).select("id", "body", refine.mask("body").alias("m"))
    edited = F.when(F.col("id") % 3 == 0, F.replace("m.text", F.lit("⟦T0⟧"), F.lit(""))).otherwise(F.col("m.text"))
    back = refine.unmask(edited, F.col("m.store"), F.col("m.kinds"))
    return m.select("id", F.col("m.text").alias("masked"), F.array_join("m.store", "¦").alias("store"), (back == F.col("body")).alias("same"), back.endswith("|").alias("table_last"))


_C41 = f"""with t as (select id, body, '| 구분 | 값 |' || chr(10) || regexp_extract(body, '\\| a    b \\| [0-9-]+ \\|') as tab, regexp_extract(body, 'a[0-9]+@b\\.kr') as mail, 'https://s.kr/p/' || id as u1, 'https://s.kr/' || id as u2, 'https://s.kr/' as u3, regexp_extract(body, '032-123-[0-9]{{4}}') as tel, regexp_extract(body, '9:[0-9]{{2}}') as clock, regexp_extract(body, '[0-9]+월 [0-9]+일') as md from ({made(_BODY)}))
  select id, replace(replace(replace(replace(replace(replace(replace(replace(body, tab, '⟦T0⟧'), mail, '⟦E1⟧'), u1, '⟦U2⟧'), '(' || u2 || ')', '(⟦U3⟧)'), '(' || u3 || '신청)', '(⟦U4⟧신청)'), tel, '⟦P5⟧'), clock, '⟦M6⟧'), md, '⟦D7⟧') as masked,
  array_to_string([tab, mail, u1, u2, u3, tel, clock, md], '¦') as store, id % 3 <> 0 as same, id % 3 = 0 as table_last from t"""


def c44_to_c49_cleaning(spark: SparkSession, d: str) -> DataFrame:
    b = rows(spark, d, _BODY)
    return b.select(
        "id", F.sha2(refine.light_clean("body").cast("binary"), 256).alias("light"), F.sha2(refine.without_board_lines("body").cast("binary"), 256).alias("board"), F.sha2(refine.with_headings("body").cast("binary"), 256).alias("headed"),
        F.sha2(refine.squeezed("body").cast("binary"), 256).alias("squeezed"), F.sha2(refine.sound_links("body").cast("binary"), 256).alias("links"), F.sha2(refine.with_links(F.replace("body", F.concat(F.lit("https://s.kr/p/"), F.col("id").cast("string")), F.lit("")), "body").cast("binary"), 256).alias("linked"),
    )


_C44 = f"""with t as ({made(_BODY)}) select id,
  sha256(replace(replace(body, chr(10) || '- 1 -' || chr(10), chr(10) || chr(10)), '![그림](x.png)', '')) as light,
  sha256(regexp_replace(replace(body, '조회수' || chr(10) || '15' || chr(10), ''), '작성자: 김[0-9]' || chr(10), '')) as board,
  sha256('### ' || body) as headed,
  sha256(replace(replace(body, '일시   ', '일시 '), '들여   쓰기', '들여 쓰기')) as squeezed,
  sha256(replace(replace(body, '[설명 본문](https://s.kr/신청)', '설명 본문'), '![그림](x.png)', '!그림')) as links,
  sha256(replace(body, 'https://s.kr/p/' || id, '') || chr(10) || chr(10) || '## 관련 링크' || chr(10) || '- https://s.kr/p/' || id) as linked from t"""

# Bells.
_BELLS = {
    "school": f"case {K} % 3 when 0 then '한빛초등학교' when 1 then '한빛중학교' else '한빛고등학교' end", "shift": f"cast({K} % 30 - 15 as int)", "pause": f"case when {K} % 2 = 0 then cast({K} % 5 + 5 as int) end", "lunch": f"case when {K} % 5 = 0 then cast({K} % 20 + 40 as int) end", "last": f"cast({K} % 5 + 4 as int)",
    "bells": f"case {K} % 3 when 0 then '1|09:10|09:55' || chr(10) || '2|10:0' || {NUM(K + ' % 9')} || '|10:50' || chr(10) || '1교시 08:00~08:40' when 1 then '2교시 (오전) 9:5' || {NUM(K + ' % 9')} || ' ~ 10:30, 1교시 09:00 - 09:40, 상담 13:00~15:00' else '전화 09:00~18:00' end",
}


def c33_j13_bells(spark: SparkSession, d: str) -> DataFrame:
    b = rows(spark, d, _BELLS).withColumn("p", school.with_overrides(school.level_bells("school"), F.col("shift"), F.col("pause"), F.col("lunch")))
    longer = b.withColumn("e", school.extended(F.col("p"), F.lit(8)))
    said = F.array_join(F.transform("e", lambda x: F.concat_ws("-", x["period"], x["start_min"], x["end_min"])), " ")
    return longer.select("id", said.alias("periods"), school.dismissal(F.col("p"), F.col("last"), F.lit(5)).cast("long").alias("out_at"))


_C33 = f"""with t as ({made(_BELLS)}), l as (select *, case when school like '%고등%' then 530 when school like '%중학%' then 550 else 540 end + "shift" as s0, case when school like '%고등%' then 50 when school like '%중학%' then 45 else 40 end as len, coalesce(pause, 10) as br, coalesce(lunch, case when school like '%고등%' then 60 else 50 end) as lu, case when school like '%초등%' then 6 else 7 end as n from t),
  p as (select *, unnest(range(1, 9)) as i from l), q as (select id, i, n, last, case when i <= n then s0 + (i - 1) * (len + br) + case when i > 4 then lu - br else 0 end else s0 + (n - 1) * (len + br) + lu - br + (i - n) * (len + 10) end as st, len from p)
  select id, string_agg(i || '-' || st || '-' || (st + len), ' ' order by i) as periods, max(case when i = last and i <= n then st + len + 15 end) as out_at from q group by id"""


def c34_bell_texts(spark: SparkSession, d: str) -> DataFrame:
    said = F.array_join(F.transform(school.parsed_bells("bells"), lambda x: F.concat_ws("-", x["period"], x["start"], x["end"])), " ")
    return rows(spark, d, _BELLS).select("id", said.alias("periods"))


_C34 = f"select id, case id % 3 when 0 then '1-09:10-09:55 2-10:0' || id % 9 || '-10:50' when 1 then '1-09:00-09:40 2-09:5' || id % 9 || '-10:30' else '' end as periods from ({made(_BELLS)})"

# Meals and subjects.
_MEALS = {
    "menu": f"'쌀밥<br/>' || case {K} % 4 when 0 then '돈까스 (1.5.' || {NUM(K + ' % 19')} || ')' when 1 then '김치찌개*5.' || {NUM(K + ' % 19')} || '.' when 2 then '새우볶음밥 9.' || {NUM(K + ' % 19')} || '.' else '<br />한우국' || {NUM(K)} end",
    "origin": f"case {K} % 3 when 0 then '쌀 : 국내산<br/>돼지고기-' || {NUM(K)} when 1 then '에너지' else '단백질(g) :  ' || {NUM(K + ' % 90')} || '<br/> ' end",
    "diet": f"case {K} % 5 when 0 then 'halal' when 1 then 'no_pork' when 2 then 'no_beef' when 3 then 'vegetarian' else 'kosher' end",
    "subject": f"case {K} % 6 when 0 then '수학Ⅱ' when 1 then ' 영어 ' || {NUM(K + ' % 5 + 1')} when 2 then '생윤' when 3 then '기술 · 가정' when 4 then 'Ⅲ' else '확통 ' || {NUM(K + ' % 10')} end",
}


def c35_to_c38_meals(spark: SparkSession, d: str) -> DataFrame:
    m = rows(spark, d, _MEALS).withColumn("second", F.element_at(school.dishes("menu"), 2)).withColumn("sub", school.split_subject("subject"))
    said = F.array_join(F.transform(school.labelled_lines("origin"), lambda x: F.concat_ws("=", x["label"], x["value"])), ";")
    warned = F.array_join(F.transform(school.diet_warnings(F.col("second.name"), F.col("second.allergens"), F.array("diet")), lambda x: F.concat_ws(":", x["diet"], x["by"])), ",")
    return m.select("id", F.col("second.name").alias("dish"), F.array_join("second.allergens", ".").alias("allergens"), said.alias("origins"), warned.alias("warnings"), F.col("sub.base").alias("base"), F.col("sub.suffix").alias("suffix"), F.col("sub.key").alias("key"))


_C35 = f"""with t as ({made(_MEALS)}), m as (select *, case id % 4 when 0 then '돈까스' when 1 then '김치찌개*' when 2 then '새우볶음밥' else '한우국' || id end as dish, case id % 4 when 0 then [1, 5, id % 19] when 1 then [5, id % 19] when 2 then [9, id % 19] else [] end as codes from t),
  w as (select *, case diet when 'halal' then list_has_any(codes, [10]) when 'no_pork' then list_has_any(codes, [10]) when 'no_beef' then list_has_any(codes, [16]) when 'vegetarian' then list_has_any(codes, [7, 8, 9, 10, 15, 16, 17, 18]) else list_has_any(codes, [8, 9, 10, 18]) end as by_code,
    case diet when 'halal' then dish = '돈까스' when 'no_pork' then dish = '돈까스' when 'no_beef' then dish like '한우%' when 'vegetarian' then dish like '한우%' or dish like '새우%' else dish like '새우%' end as by_word from m)
  select id, dish, array_to_string(codes, '.') as allergens, case id % 3 when 0 then '쌀=국내산;돼지고기=' || id when 1 then '에너지=' else '단백질(g)=' || id % 90 end as origins, case when by_code then diet || ':allergen' when by_word then diet || ':keyword' else '' end as warnings,
  case id % 6 when 0 then '수학' when 1 then '영어' when 2 then '생윤' when 3 then '기술 · 가정' when 4 then 'Ⅲ' else case when id % 10 between 1 and 5 then '확통' else '확통 ' || id % 10 end end as base,
  case id % 6 when 0 then 'II' when 1 then cast(id % 5 + 1 as varchar) when 5 then case when id % 10 between 1 and 5 then cast(id % 10 as varchar) else '' end else '' end as suffix,
  case id % 6 when 0 then '수학' when 1 then '영어' when 2 then '생활과윤리' when 3 then '기술가정' when 4 then 'Ⅲ' else case when id % 10 between 1 and 5 then '확률과통계' else '확통' || id % 10 end end as key from w"""

# Locales.
_TITLES = {
    "locale": f"case {K} % 4 when 0 then 'ko' when 1 then 'en' when 2 then 'vi' else 'ru' end", "title": f"case {K} % 3 when 0 then '## 알림 ' || {NUM(K)} when 1 then '  ' end", "en": f"case when {K} % 5 < 3 then ' Notice ' || {NUM(K)} else ' ' end", "ko": f"case when {K} % 7 = 0 then '' else '공지 ' || {NUM(K)} end",
    "summary": f"case {K} % 2 when 0 then ' 요약 ' || {NUM(K)} || chr(10) || '둘째' else '' end", "raw_locale": f"case {K} % 5 when 0 then ' EN ' when 1 then 'zh-Hant' when 2 then 'ko' when 3 then 'x' else 'vi_vn' end", "status": f"case when {K} % 4 = 1 then 'failed' else 'completed' end",
}


def f3_f4_f5_f15_locales(spark: SparkSession, d: str) -> DataFrame:
    t = rows(spark, d, _TITLES)
    texts = F.create_map(F.lit("en"), F.col("en"), F.lit("ko"), F.col("ko"))
    shown = locales.display_title(F.col("locale"), F.col("title"), texts, F.col("summary"), F.create_map(F.lit("vi"), F.col("summary")), F.lit("(제목 없음)"))
    return t.select("id", locales.pick(texts, F.col("locale")).alias("picked"), locales.pick_reason(texts, F.col("locale")).alias("reason"), shown.alias("shown"), locales.normal_locale("raw_locale").alias("wanted"), locales.usable("en", "status").alias("usable"))


_F3 = f"""with t as ({made(_TITLES)}), u as (select *, case when trim(title) <> '' then substr(regexp_replace(title, '^## ', ''), 1, 60) end as own, case when summary <> '' then '요약 ' || id end as line from t)
  select id, coalesce(case when locale = 'en' then en when locale = 'ko' then nullif(ko, '') end, nullif(ko, ''), en) as picked, coalesce(case when locale = 'en' then nullif(trim(en), '') end, nullif(ko, '')) as reason,
  coalesce(case locale when 'ko' then coalesce(own, line) when 'en' then coalesce(nullif(trim(en), ''), own) when 'vi' then coalesce(line, own) else own end, '(제목 없음)') as shown,
  case id % 5 when 0 then 'en' when 1 then 'zh-hant' end as wanted, trim(en) <> '' and status <> 'failed' as usable from u"""

# Cards, events, risk, review, kinds of content.
_ACTIONS = {
    "a1": f"case {K} % 4 when 0 then '동의서를 작성하여 담임에게 제출' when 1 then '행사에 협조 부탁드립니다' when 2 then '참가비 납부' else '' end", "a2": f"case {K} % 3 when 0 then '신청서 제출 협조' when 1 then '참가비 납부' else '확인 ' || {NUM(K)} end",
    "s1": f"case {K} % 3 when 0 then '동의서' when 1 then '신청서 원본' else '참가비 영수증' end", "due": f"case when {K} % 5 = 0 then '' else {ISO} end",
}


def v18_f16_d12_k9_cards(spark: SparkSession, d: str) -> DataFrame:
    items = notices.action_items(F.array("a1", "a2"), F.array("s1"), F.col("due"))
    return rows(spark, d, _ACTIONS).select("id", F.array_join(F.transform(items, lambda x: F.concat(x["text"], F.lit("@"), F.coalesce(x["hint"], F.lit("-")))), ";").alias("items"))


_V18 = f"""with t as ({made(_ACTIONS)}), k as (select *, list_filter([a1, a2], lambda x: x <> '' and x not like '행사에%') as kept from t),
  s as (select *, list_distinct([x for x in kept if true]) as u, (id % 3 = 0 and list_contains(kept, '동의서를 작성하여 담임에게 제출')) as asked from k),
  e as (select id, due, list_concat(case when len(kept) = 2 and kept[1] = kept[2] then kept[1:1] else kept end, case when asked then [] else ['제출: ' || s1] end) as items from s)
  select id, array_to_string(list_transform(items, lambda x, i: x || '@' || case when i = 1 and due <> '' then due else '-' end), ';') as items from e"""

_SPANS = {"p1": ISO, "p2": "cast(cast(o_orderdate as date) + cast(o_orderkey % 3 as int) as string)", "p3": "cast(cast(o_orderdate as date) + cast(o_orderkey % 5 as int) as string)"}


def v17_d10_events(spark: SparkSession, d: str) -> DataFrame:
    """Two dates and a span of each order: the span first, then an event or a deadline at its ends."""
    point = lambda start, end, kind: F.struct(F.col(start).alias("start"), (F.col(end) if end else F.lit(None).cast("string")).alias("end"), kind.alias("kind"))
    kind = F.when(F.col("id") % 2 == 0, "event").otherwise("deadline")
    e = notices.events(F.array(point("p1", "p2", F.lit("event")), point("p2", None, kind), point("p3", None, F.lit("deadline"))))
    said = F.transform(e, lambda x: F.concat_ws("/", x["event_date"], F.coalesce(x["end_date"], F.lit("-")), F.array_join(x["event_kinds"], "+")))
    return rows(spark, d, _SPANS).select("id", F.array_join(said, ";").alias("events"))


_V17 = f"""with t as ({made(_SPANS)}), p as (select id, p1 as s, p2 as e, 'event' as k, 1 as o from t union all select id, p2, null, case when id % 2 = 0 then 'event' else 'deadline' end, 2 from t union all select id, p3, null, 'deadline', 3 from t),
  g as (select id, s, min(o) as o, max(e) as e, bool_or(k = 'deadline') as dl, bool_or(k = 'event') as ev from p group by id, s), w as (select *, case when e > s then e end as en from g)
  select id, string_agg(s || '/' || coalesce(en, '-') || '/' || case when dl and ev then 'deadline+event' when dl then 'deadline' else 'event' end, ';' order by o) as events from w a
  where en is not null or dl or not exists (select 1 from w b where b.id = a.id and b.en = a.s) group by id"""


def v9_v10_v11_review(spark: SparkSession, d: str) -> DataFrame:
    r = rows(spark, d, {"body": f"case {K} % 3 when 0 then '붙임 참조 QR' when 1 then repeat('가', 1601) else '오늘 급식' end", "n": f"cast({K} % 4 as int)", "why": f"case {K} % 4 when 0 then 'mismatch ' || {NUM(K)} when 1 then ' ' end", "must": f"{K} % 3 = 0", "sev": f"case {K} % 5 when 0 then 'Critical' when 1 then 'HIGH' else 'low' end"})
    risk = notices.risk_reasons("body", {"deadlines": F.col("n"), "actions_required": F.col("n"), "times": F.col("n")}, F.col("id") % 7 == 0)
    review = notices.review(F.when(F.col("id") % 6 != 0, F.col("body")), F.col("why"), F.col("must"), F.lit(None).cast("string"))
    merged = facts.merged_verdict(F.when(F.col("n") > 1, "FAIL").otherwise("PASS"), F.when(F.col("must"), "FAIL").otherwise("PASS"))
    return r.select("id", risk["level"].alias("level"), F.array_join(risk["reasons"], ",").alias("reasons"), review["needed"].alias("needed"), review["reason"].alias("why"), notices.priority(F.array(F.lit("normal"), F.col("sev"))).alias("priority"), merged.alias("verdict"))


_V9 = """with t as (select o_orderkey as id, o_orderkey % 4 as n from orders), r as (select *, list_filter([case when n > 0 then 'has_deadlines' end, case when n > 1 then 'has_multiple_actions_required' end, case when id % 7 = 0 then 'has_meal_or_dictionary_sensitive_content' end, case when n > 2 then 'has_multiple_schedule_facts' end,
  case when id % 3 = 1 then 'long_notice' end, case when id % 3 = 0 then 'has_high_risk_text_cues' end], lambda x: x is not null) as rs, case when id % 6 <> 0 then coalesce(case when id % 4 = 0 then 'mismatch ' || id end, case when id % 3 = 0 then 'admin_review_required' end) end as why from t)
  select id, case when len(rs) > 0 then 'high' else 'low' end as level, case when len(rs) > 0 then array_to_string(rs, ',') else 'simple_notice_without_actions_or_deadlines' end as reasons, why is not null as needed, why,
  case id % 5 when 0 then 'critical' when 1 then 'high' else 'normal' end as priority, case when n > 1 or id % 3 = 0 then 'FAIL' else 'PASS' end as verdict from r"""

_DATES = {"said": f"case {K} % 4 when 0 then {MONTH} || '월 ' || {DAY} || '일(화) 2026. 6. 8. 참가비 5,000원' when 1 then '기한: ' || {MONTH} || '/' || {DAY} when 2 then '2월 30일, 13월 1일' else {MONTH} || '.' || {DAY} || '.(금) 12,' || lpad({NUM(K + ' % 1000')}, 3, '0') || ' 원' end", "source": f"case when {K} % 8 < 4 then '6월 8일, ' || {MONTH} || '월 ' || {DAY} || '일 5000원' else '12' || lpad({NUM(K + ' % 1000')}, 3, '0') || '원' end"}


def c20_v4_dates(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d, _DATES).select("id", joined(notices.yearless_dates("said", 2026)).alias("dates"), F.array_join(notices.invented_facts("said", "source"), ",").alias("invented"))


_C20 = f"""with t as ({made(_DATES)}), m as (select t.id, said, source, lpad(cast(month(o_orderdate) as varchar), 2, '0') || '-' || lpad(cast(day(o_orderdate) as varchar), 2, '0') as md, month(o_orderdate) || '-' || day(o_orderdate) as p from t join orders on id = o_orderkey)
  select id, array_to_string(list_sort(list_filter(list_distinct(case id % 4 when 0 then ['2026-' || md, '2026-06-08'] when 1 then ['2026-' || md] when 2 then [] else ['2026-' || md] end), lambda x: x <> '2026-02-29')), ',') as dates,
  array_to_string(list_sort(case id % 4 when 0 then case when id % 8 < 4 then [] else list_distinct([p, '6-8', '5,000원']) end when 1 then [] when 2 then case when id % 8 < 4 then list_filter(['2-30', '13-1'], lambda x: x <> p) else ['2-30', '13-1'] end else case when id % 8 < 4 then ['12,' || lpad(cast(id % 1000 as varchar), 3, '0') || ' 원'] else [p] end end), ',') as invented from m"""

_SOURCES = {"body": f"case {K} % 3 when 0 then '작성자 김 등록일 ' || {ISO} || ' 조회수 3' when 1 then '## 제목' || chr(10) || '- 첨부1.hwp' || chr(10) || '작성자: 김' else '본문 ' || {NUM(K)} || '입니다' || chr(10) || 'Y D O T N I G' end", "att": f"case when {K} % 2 = 0 then '첨부 내용 ' || {NUM(K)} else ' ' end"}


def c52_to_c56_sources(spark: SparkSession, d: str) -> DataFrame:
    s = rows(spark, d, _SOURCES)
    both = F.array(F.struct(F.lit("html_body").alias("kind"), F.col("body").alias("text")), F.struct(F.lit("attachment_pdf").alias("kind"), F.col("att").alias("text")))
    kind = notices.content_kind(F.col("id") % 3 != 0, F.col("id") % 2 == 0, F.col("id") % 5 == 0)
    flat = notices.looks_flattened(F.concat(F.lit("가\n나\n다\n라\n마\n바\n"), F.when(F.col("id") % 2 == 0, F.lit("- 목록\n끝입니다")).otherwise(F.repeat(F.lit("끝입니다\n"), 9))))
    return s.select("id", notices.combined_text(both).alias("combined"), notices.body_has_content("body").alias("has_content"), notices.without_decoration("body").alias("plain"), kind.alias("kind"), flat.alias("flat"), notices.drops_inline_text(F.lit("inline_image"), F.lit(55.0), F.col("id") % 3 == 0, F.col("att") != " ").alias("dropped"))


_C52 = f"""select id, case when id % 3 = 0 and id % 2 = 0 then trim(att) when trim(att) = '' then body else body || chr(10) || chr(10) || '---' || chr(10) || chr(10) || att end as combined, id % 3 <> 1 as has_content, case when id % 3 = 2 then '본문 ' || id || '입니다' else body end as plain,
  case when id % 3 <> 0 then case when id % 2 = 0 then case when id % 5 = 0 then 'mixed' else 'html_text_with_images' end when id % 5 = 0 then 'html_text_with_attachments' else 'html_text_only' end when id % 2 = 0 then case when id % 5 = 0 then 'image_with_attachments' else 'image_only' end when id % 5 = 0 then 'attachment_only' else 'empty_or_unreadable' end as kind,
  id % 2 = 0 as flat, id % 2 = 0 and id % 3 <> 0 as dropped from ({made(_SOURCES)})"""


def c60_document_score(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all documents, each with a line of a notice before it."""
    docs = spread(table(spark, d, "documents").where("text is not null"))
    return docs.select("doc_id", notices.document_score(F.concat(F.lit("학부모 안내 敎育\n"), F.substring("text", 1, 2_147_483_647))).alias("score"))


_BLANK = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_C60 = f"""with t as (select doc_id, regexp_replace('학부모 안내 敎育' || chr(10) || text, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') as t from documents where text is not null)
  select doc_id, round(length(regexp_replace(t, '[^가-힣]', '', 'g')) * 2 + length(t) * 0.08::double + ((length(t) - length(replace(t, '학부모', ''))) / 3 + (length(t) - length(replace(t, '안내', ''))) / 2) * 20 + least(len(list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[{_BLANK}]', '', 'g') <> '')), 30) * 3 - length(regexp_replace(t, '[^一-鿿]', '', 'g')) * 3, 2) as score from t"""

# Links and pages.
_LINKS = {
    "label": f"case {K} % 6 when 0 then '가정통신문' when 1 then '교육청 가정통신문' when 2 then '학교 통신문 ' || {NUM(K)} when 3 then '공지사항 게시판' when 4 then '급식 사진' else '학교소식' end", "url": f"case {K} % 3 when 0 then 'https://s.kr/bbs/Notice?m=' || {NUM(K)} when 1 then 'https://s.kr/sub/menu' else 'https://s.kr/x' end", "near": f"case {K} % 5 when 0 then '알림마당 / 가정통신문' when 1 then '열린마당' else '' end",
    "feed": "'https://School.kr/rss'", "link": f"case {K} % 6 when 0 then '//school.kr/a/a/b/' || {NUM(K)} when 1 then '/board/view?x=' || {NUM(K)} when 2 then 'school.kr/na/' || {NUM(K)} || '/#top' when 3 then 'https://other.kr/1' when 4 then ' ' else 'HTTPS://SCHOOL.KR/c/?' end",
    "home": f"case {K} % 6 when 0 then 'school' || {NUM(K)} || '.kr/' when 1 then 'http://' when 2 then '//s.kr/' || {NUM(K)} when 3 then 'https://s.kr//' when 4 then 'ftp:x' else ' ' end", "ask": f"case {K} % 4 when 0 then '한빛초' when 1 then '한빛중' when 2 then '한빛초등학교' else ' ' end",
    "page": f"case {K} % 4 when 0 then 'https://s.kr 가정 통신문 목록 제목' when 1 then '공지 사항 등록일' when 2 then '로그인이 필요 제목 작성자' else '검색' end", "error": f"case {K} % 6 when 0 then 'HTTP 429' when 1 then '404 Not Found' when 2 then 'ReadError: timed out' when 3 then 'file_type_check' when 4 then 'budget_exhausted' else 'KeyError' end",
    "html": f"case {K} % 6 when 0 then '<script>location.href = \"/main/' || {NUM(K)} || '\";</script><a href=\"/\"></a>' when 1 then '<a href=\"/x\">들어가기</a><script>location.href=\"/no\"</script>' when 2 then '<meta http-equiv=\"refresh\" content=\"0; url=/m\">' when 3 then '<form action=loginpost.php name=fm_xb_login>' when 4 then '<script>window.location.replace( ''/r'' )</script>' else '<p>게시판 접근 권한이 없습니다</p>' end",
    "code": f"case when {K} % 9 = 0 then 403 else 200 end", "agent": f"case {K} % 6 when 0 then 'Mozilla KAKAOTALK 1' when 1 then 'x Line/9 ' when 2 then 'NAVER(inapp; x)' when 3 then 'FBAN/x' when 4 then 'Android; wv) x' else 'Firefox' end",
    "header": f"case {K} % 4 when 0 then 'attachment; filename=\"a/b' || {NUM(K)} || '.hwp\"' when 1 then 'attachment; filename=x.pdf; filename*=UTF-8''''%EC%95%88%EB%82%B4' || {NUM(K)} || '.pdf' when 2 then 'inline' else 'attachment; filename=plain.txt' end",
}


def c6_c7_link_scores(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d, _LINKS).select("id", links.link_score("label", "url", "near").cast("long").alias("score"), links.link_tier("label", "near").cast("long").alias("tier"))


_C6 = f"""with t as ({made(_LINKS)}) select id, case id % 6 when 0 then 200 when 1 then -120 when 2 then 200 else case when id % 5 = 0 then 25 else 0 end end + case id % 6 when 0 then 200 else 0 end
  + 20 * (case when near like '알림마당%' then 1 when near = '열린마당' then 1 else 0 end + case id % 6 when 3 then 2 when 5 then 2 else 0 end) + case id % 3 when 0 then 15 when 1 then 10 else 0 end - case id % 6 when 4 then 60 else 0 end as score,
  case id % 6 when 0 then 0 when 1 then 9 when 2 then 1 else case when id % 5 = 0 then 3 else 10 end end as tier from t"""


def c10_c11_c64_urls(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d, _LINKS).select("id", links.feed_link("link", "feed").alias("link"), links.homepage("home").alias("home"), F.array_join(links.query_forms("ask"), "|").alias("forms"))


_C10 = f"""select id, case id % 6 when 0 then 'https://school.kr/a/b/' || id when 1 then 'https://School.kr/board/view?x=' || id when 2 then 'https://school.kr/na/' || id when 3 then '' when 4 then '' else 'https://SCHOOL.KR/c' end as link,
  case id % 6 when 0 then 'https://school' || id || '.kr' when 1 then '' when 2 then 'https://s.kr/' || id when 3 then 'https://s.kr' else '' end as home, case id % 4 when 0 then '한빛초|한빛초등학교' when 1 then '한빛중|한빛중학교' when 2 then '한빛초등학교' else '' end as forms from ({made(_LINKS)})"""


def c16_c17_c18_pages(spark: SparkSession, d: str) -> DataFrame:
    p = links.page_check("page")
    return rows(spark, d, _LINKS).select("id", p["score"].cast("long").alias("score"), p["ok"].alias("ok"), links.error_class("error").alias("error"), links.access_failure("url", "code", "html").alias("barred"), links.redirect_target("html").alias("target"))


_C16 = """select o_orderkey as id, case o_orderkey % 4 when 0 then 60 when 1 then 20 when 2 then 0 else 5 end as score, o_orderkey % 4 in (0, 1) as ok,
  case o_orderkey % 6 when 0 then 'quota_exhausted' when 1 then 'permanent_not_found' when 2 then 'transient_network' when 3 then 'unsupported_file' when 4 then 'budget_exhausted' else 'internal_error' end as error,
  case when o_orderkey % 9 = 0 then 'unsupported_forbidden' when o_orderkey % 6 in (3, 5) then 'unsupported_login_required' end as barred, case o_orderkey % 6 when 0 then '/main/' || o_orderkey when 2 then '/m' when 4 then '/r' end as target from orders"""


def c72_c84_clients(spark: SparkSession, d: str) -> DataFrame:
    a = links.in_app_client("agent")
    return rows(spark, d, _LINKS).select("id", links.disposition_name("header").alias("file"), a["name"].alias("app"), a["opens"].alias("opens"))


_C72 = "select o_orderkey as id, case o_orderkey % 4 when 0 then 'a_b' || o_orderkey || '.hwp' when 1 then '안내' || o_orderkey || '.pdf' when 3 then 'plain.txt' end as file, case o_orderkey % 6 when 0 then 'kakaotalk' when 1 then 'line' when 2 then 'naver' when 3 then 'facebook' when 4 then 'other' end as app, o_orderkey % 6 < 3 as opens from orders"

_ROWS = {"cells": f"case {K} % 4 when 0 then {NUM(K)} || ' 안내문 2024-05-0' || {NUM(K + ' % 9 + 1')} || ' 조회 3' when 1 then '급식 식단' when 2 then ' ' else '제목 12' end", "markup": f"case {K} % 3 when 0 then '<td><a href=\"#\" data-id=\"3\">x</a></td>' when 1 then '<td onclick=\"go()\">x</td>' else '<td>x</td>' end"}


def c74_k10_rows(spark: SparkSession, d: str) -> DataFrame:
    """The fifty best rows of all, of those with a positive score."""
    s = rows(spark, d, _ROWS).select("id", links.row_score("cells", "markup", F.col("id") % 10 == 0).cast("long").alias("score"))
    return s.where("score > 0").orderBy(F.desc("score"), "id").limit(50)


_K10 = f"""select id, case when id % 4 = 2 then -10 else case id % 3 when 0 then 30 when 1 then 10 else 0 end + case when id % 10 = 0 then -30 else 0 end + case id % 4 when 0 then 40 when 1 then -10 else 5 end end as score from ({made(_ROWS)}) where case when id % 4 = 2 then -10 else case id % 3 when 0 then 30 when 1 then 10 else 0 end + case when id % 10 = 0 then -30 else 0 end + case id % 4 when 0 then 40 when 1 then -10 else 5 end end > 0 order by score desc, id limit 50"""


def j11_titles(spark: SparkSession, d: str) -> DataFrame:
    t = rows(spark, d, {"a": f"'체험 학습 ' || {NUM(K + ' % 50')}", "b": f"'[가정통신문] 체험학습 ' || {NUM(K + ' % 40')} || ' NEW'"})
    return t.select("id", links.titles_meet(F.array("a", F.lit("가나")), F.array("b", F.lit(" "))).alias("meet"))


_J11 = "select o_orderkey as id, contains('[가정통신문]체험학습' || o_orderkey % 40 || 'NEW', '체험학습' || o_orderkey % 50) as meet from orders"


# Duplicates among the sources of a notice.
def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a notice of three sources: its text, the text with more, and its first three fifths with a fee that may be nowhere else."""
    docs = spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text"))
    fee = F.when(F.col("doc_id") % 2 == 0, F.lit(" 참가비 7,777원")).otherwise(F.lit(""))
    part = F.concat(F.substring("text", F.lit(1), (F.char_length("text") * 3 / 5).cast("int")), fee)
    kinds = [("html_body", F.col("text")), ("attachment_hwp", F.concat("text", F.lit(" 접수 마감 12월 31일까지입니다"))), ("inline_image", part)]
    each = F.array(*[F.struct(F.lit(i).alias("order_index"), F.lit(k).alias("source_type"), t.alias("raw_text")) for i, (k, t) in enumerate(kinds)])
    status = F.when((F.col("notice_id") % 10 == 0) & (F.col("order_index") == 1), "failed").otherwise("success")
    return docs.select(F.col("doc_id").alias("notice_id"), F.inline(each)).withColumn("status", status)


def d3_d4_d5_j9_k6_roles(spark: SparkSession, d: str) -> DataFrame:
    roles = dedup.assign_roles(_sources(spark, d))
    return roles.select("notice_id", F.col("order_index").cast("long").alias("order_index"), "source_role", F.col("duplicate_of").cast("long").alias("duplicate_of"), F.col("place").cast("long").alias("place"))


_TOK = "list_distinct(regexp_extract_all(lower({}), '[0-9A-Za-z가-힣]{{2,}}'))".format
_CRIT = (
    r"[0-9]{4}[ \t\n\r]*[.\-/년][ \t\n\r]*[0-9]{1,2}[ \t\n\r]*[.\-/월][ \t\n\r]*[0-9]{1,2}|[0-9]{1,2}[ \t\n\r]*월[ \t\n\r]*[0-9]{1,2}[ \t\n\r]*일|[0-9]{1,2}[ \t\n\r]*[./][ \t\n\r]*[0-9]{1,2}",
    r"[0-9][0-9,]*[ \t\n\r]*원",
)
_D3 = f"""with s as (select doc_id as n, text as t0, text || ' 접수 마감 12월 31일까지입니다' as t1, substr(text, 1, (length(text) * 3 // 5)) || case when doc_id % 2 = 0 then ' 참가비 7,777원' else '' end as t2 from documents where text is not null),
  x as (select n, unnest([0, 1, 2]) as i, unnest([t0, t1, t2]) as t from s),
  y as (select n, i, t, regexp_replace(lower(t), '[^0-9A-Za-z가-힣]+', '', 'g') as fp, {_TOK("t")} as tok, length(regexp_replace(t, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')) as len, list_distinct(regexp_extract_all(replace(t, ',', ''), '[0-9]+')) as num,
    list_distinct(flatten(list_transform(list_concat(regexp_extract_all(t, '{_CRIT[0]}'), regexp_extract_all(t, '{_CRIT[1]}')), lambda m: regexp_extract_all(replace(m, ',', ''), '[0-9]+')))) as crit, len > 0 and not (n % 10 = 0 and i = 1) as ok from x),
  p as (select a.n, a.i as i, b.i as j, (a.fp <> '' and a.fp = b.fp) or (a.len >= 120 and b.len >= 120 and len(list_intersect(a.tok, b.tok)) * 10 >= len(list_distinct(list_concat(a.tok, b.tok))) * 9 and len(a.tok) + len(b.tok) > 0)
    or (least(len(a.tok), len(b.tok)) >= 40 and len(list_intersect(a.tok, b.tok)) * 20 >= least(len(a.tok), len(b.tok)) * 17 and not (case when len(a.tok) <= len(b.tok) then len(list_filter(a.crit, lambda q: not list_contains(b.num, q))) > 0 else len(list_filter(b.crit, lambda q: not list_contains(a.num, q))) > 0 end)) as dup
    from y a join y b on a.n = b.n and a.i < b.i where a.ok and b.ok),
  w as (select n, coalesce(bool_or(dup) filter (where i = 0 and j = 1), false) as d01, coalesce(bool_or(dup) filter (where i = 0 and j = 2), false) as d02, coalesce(bool_or(dup) filter (where i = 1 and j = 2), false) as d12 from p group by n),
  g as (select y.*, case i when 0 then 0 when 1 then case when d01 then 0 else 1 end else case when d02 or (d01 and d12 and o1) then 0 when d12 and o1 then 1 else 2 end end as grp from y left join w on y.n = w.n join (select n, bool_or(ok) filter (where i = 1) as o1 from y group by n) o on o.n = y.n),
  r as (select *, case i when 0 then 70 when 1 then 90 else 45 end as rank, max(length(t)) filter (where ok) over (partition by n, grp) as longest from g),
  b as (select n, grp, arg_max(i, case when i = 0 then 1000 else rank end) filter (where ok and length(t) >= longest * 0.9::double) as best from r group by n, grp),
  o as (select r.n, r.i, r.ok, b.best, row_number() over (partition by r.n order by case when r.ok and b.best = r.i then 0 else 1 end, -r.rank, -length(r.t)) as place from r left join b on r.n = b.n and r.grp = b.grp)
  select n as notice_id, i as order_index, case when not ok then 'excluded' when best = i then 'primary' else 'duplicate' end as source_role, case when ok and best <> i then best end as duplicate_of, case when ok and best = i then place end as place from o"""


QUERIES: dict[str, Query] = {
    "v6_fact_values": (v6_fact_values, f"with l as (select id, {_FACT_LISTS} from ({made(_FACTS)})) select id, " + ", ".join(f"array_to_string(list_sort({n}), ',') as {n}" for n in _FACTS) + " from l"),
    "v5_v12_fact_issues": (v5_fact_issues, _V5), "c41_c42_masks": (c41_c42_masks, _C41), "c44_to_c49_cleaning": (c44_to_c49_cleaning, _C44), "c33_j13_bells": (c33_j13_bells, _C33), "c34_bell_texts": (c34_bell_texts, _C34), "c35_to_c38_meals": (c35_to_c38_meals, _C35),
    "f3_f4_f5_f15_c80_locales": (f3_f4_f5_f15_locales, _F3), "v18_f16_d12_k9_cards": (v18_f16_d12_k9_cards, _V18), "v17_events": (v17_d10_events, _V17), "v9_v10_v11_v12_review": (v9_v10_v11_review, _V9), "c20_v4_dates": (c20_v4_dates, _C20), "c52_to_c56_v21_sources": (c52_to_c56_sources, _C52),
    "c60_document_score": (c60_document_score, _C60), "c6_c7_link_scores": (c6_c7_link_scores, _C6), "c10_c11_c64_urls": (c10_c11_c64_urls, _C10), "c16_c17_c18_c68_pages": (c16_c17_c18_pages, _C16), "c72_c84_clients": (c72_c84_clients, _C72), "c74_k10_rows": (c74_k10_rows, _K10), "j11_titles": (j11_titles, _J11),
    "d3_d4_d5_j9_k6_roles": (d3_d4_d5_j9_k6_roles, _D3),
}
