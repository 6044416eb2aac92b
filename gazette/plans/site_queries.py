"""Queries on families of sites over all pages; SQL joins the same rows of rules and states match, rank and sums by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import site_rules as R
from gazette.plans.base import Query, spread, table

# Read alike by Spark and DuckDB: a page's own address on the hosts and paths of several kinds of board software, by its language, number and path.
_TAIL = "split_part(url, '/', 4) || '/' || split_part(url, '/', 5)"
_URL = f"""case when page_id % 12 = 0 then 'https://school.jbedu.kr/' || split_part(url, '/', 4) || '/M0104/view/' || page_id when page_id % 12 = 1 then 'https://' || split_part(url, '/', 3) || '/na/ntt/selectNttInfo.do?mi=' || page_id || '&bbsId=3&nttSn=' || length(url)
  when page_id % 12 = 2 then 'https://a.cnems.kr/boardCnts/view.do?boardID=' || length(html) || '&boardSeq=' || page_id || '&m=0203' when page_id % 12 = 3 then 'http://b.gen.ms.kr/xboard/board.php?tbnum=' || page_id || '&mode=view&number=' || length(url) when page_id % 12 = 4 then 'https://c.sen.ms.kr/' || {_TAIL}
  when page_id % 12 = 5 then 'https://d.dge.es.kr:452/cms.php?dk_cms=' || page_id || '&DK_ID=9' when page_id % 12 = 6 then 'https://school.use.go.kr/' || {_TAIL} || '/M01040101/' when page_id % 12 = 7 then url || '/c2zHome' else url end"""
_HTML = "case when page_id % 5 = 0 then html || 'selectNttList.do nttInfoBtn' when page_id % 5 = 1 then html || 'boardCnts/list.do goView(1)' when page_id % 5 = 2 then html || 'passni5 schoolbell-e.com /M01' when page_id % 7 = 3 then html || 'subMenu.do?bbsId' else html end"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "pages").select("page_id", "url", "html")).select("page_id", F.expr(_URL).alias("url"), F.expr(_HTML).alias("html"))


def c12_c13_families(spark: SparkSession, d: str) -> DataFrame:
    """Software of each page, how sure that is, the signals told, and the parser."""
    p = _pages(spark, d).withColumn("cms", R.detect_family("url", "html", F.array().cast("array<string>")))
    return p.select("page_id", "cms.key", F.round("cms.confidence", 6).alias("confidence"), F.array_join("cms.signals", "; ").alias("signals"), R.parser_family("url", "html", F.col("cms.key")).alias("parser"))


def c69_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists that each page may belong to, one a row, and whether the page is one of a post."""
    return _pages(spark, d).select("page_id", F.posexplode(R.list_urls("url")).alias("at", "list_url"), R.is_detail_link("url").alias("detail"))


def c70_c71_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Feed of each page's board by the key of its first list, and where post 77 of it may be."""
    p = _pages(spark, d).withColumn("board", F.element_at(R.list_urls("url"), 1))
    key = F.when(F.col("board").contains("mi="), F.concat(F.lit("mi="), F.regexp_extract("board", "mi=([0-9]+)", 1), F.lit("|bbsId=3"))).otherwise(F.regexp_extract("board", "^[a-z]+://[^/]*([^?]*)", 1))
    family = F.when(F.col("board").contains("selectNtt"), "select_ntt_like").otherwise("slash_view_like")
    return p.select("page_id", R.feed_url("board", family, key)["url"].alias("feed"), F.array_join(R.detail_urls("board", F.lit("77")), " ").alias("posts"))


def _rule_rows(rules: tuple[R.Rule, ...]) -> str:
    """Rank, family, score, signal, clause, field and term of each rule as rows of SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({i}, {quoted(r.family)}, {r.score}, {quoted(r.signal)}, {c}, {quoted(w)}, {quoted(t)})" for i, r in enumerate(rules) for c, clause in enumerate(r.clauses) for w, t in clause)


_P = f"select page_id, u as url, h as html, lower(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1)) as host, regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path from (select page_id, {_URL} as u, {_HTML} as h from pages)"
_HIT = "select page_id, rank, family, score, signal from (select page_id, rank, family, score, signal, clause, bool_or(case field when 'host' then contains(host, term) when 'text' then contains(text, term) when 'url' then contains(url, term) when 'text~' then regexp_matches(text, term) when 'path~' then regexp_matches(path, term) when 'cms=' then cms = term end) as ok from {t} cross join (values {rules}) r(rank, family, score, signal, clause, field, term) group by all) group by all having bool_and(ok)"
_DROP = "nullif(concat_ws('&', case when b <> '' and not regexp_matches(b, '{keys}') then b end, case when c <> '' and not regexp_matches(c, '{keys}') then c end, case when d <> '' and not regexp_matches(d, '{keys}') then d end), '')"
_ENDS = {"ntt": ("selectNttInfo.do", "selectNttList.do"), "cnts": ("boardCnts/view.do", "boardCnts/list.do"), "php": ("board.php", "board.php"), "cms": ("cms.php", "cms.php")}
_KEYS = {"ntt": "^(?:nttSn|nttId|articleId|boardSeq|seq|number|num)=", "cnts": "^(?:nttSn|nttId|articleId|boardSeq|seq|number|num)=", "php": "^(?:nttSn|nttId|articleId|boardSeq|seq|number|num|(?i:mode|queryencode))=", "cms": "^(?i:dk_id)="}
_MADE = ", ".join(
    f"case when path like '%{a}' then head || replace(path, '{a}', '{b}') || coalesce('?' || {_DROP.format(keys=_KEYS[k])}, '') end as {k}" for k, (a, b) in _ENDS.items()
)
_LISTS = f"""select page_id, url, path, list_filter(list_distinct_in_order, lambda x: x is not null) as lists from (select *, [case when contains(path, '/view/') then head || rtrim(split_part(path, '/view/', 1), '/') || '/' end, ntt, cnts, case when php <> url then php end, case when cms <> url then cms end, url] as list_distinct_in_order
  from (select *, {_MADE} from (select *, regexp_extract(url, '^[a-z]+://[^/]*') as head, split_part(split_part(url, '?', 2), '&', 1) as b, split_part(split_part(url, '?', 2), '&', 2) as c, split_part(split_part(url, '?', 2), '&', 3) as d from ({_P}))))"""
QUERIES: dict[str, Query] = {
    "c12_c13_families": (c12_c13_families, f"""with p as materialized ({_P}), t as (select *, url || ' ' || html || ' ' as text, '' as cms from p), hit as materialized ({_HIT.format(t='t', rules=_rule_rows(R.SIGNALS))}),
      best as (select * from (select page_id, family, sum(score) as total, min(rank) as early, string_agg(signal, '; ' order by rank) filter (where nth <= 4) as signals from (select *, row_number() over (partition by page_id, family order by rank) as nth from hit) group by 1, 2) qualify row_number() over (partition by page_id order by total desc, early) = 1),
      k as (select p.*, coalesce(b.family, 'unknown') as cms, round(least(coalesce(b.total, 0) / 120.0::double, 0.99), 6) as confidence, coalesce(b.signals, '') as signals, p.url || ' ' || html as text from p left join best b using (page_id)), parse as ({_HIT.format(t='k', rules=_rule_rows(R.PARSERS))})
      select page_id, cms as key, confidence, signals, coalesce((select arg_min(family, rank) from parse where parse.page_id = k.page_id), 'generic') as parser from k"""),
    "c69_lists": (c69_lists, f"""select page_id, unnest(range(len(lists)))::int as at, unnest(lists) as list_url, coalesce(regexp_matches(url, '[?&]mode=(?i:downpost|view|read|detail|viewpost)(?:&|$)') or regexp_matches(url, '(?i)[?&]dk_id=[^&]') or regexp_matches(path, '(?i)/view/[0-9]+/?$') or regexp_matches(lower(path), '(?:selectnttinfo\\.do|boardcnts/view\\.do)$'), false) as detail
      from (select page_id, url, path, list_filter(lists, lambda x, i: list_position(lists, x) = i) as lists from ({_LISTS}))"""),
    "c70_c71_addresses": (c70_c71_addresses, f"""with b as (select page_id, lists[1] as board from ({_LISTS})), p as (select *, regexp_extract(board, '^[a-z]+://[^/]*') as head, regexp_extract(board, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(split_part(board, '#', 1), '[?](.*)$', 1) as query, board like '%selectNtt%' as ntt, board like '%boardCnts%' as cnts, regexp_extract(board, 'boardID=([0-9]+)', 1) as id from b)
      select page_id, case when ntt then head || replace(path, 'selectNttList.do', 'selectRssFeed.do') || '?mi=' || regexp_extract(board, 'mi=([0-9]+)', 1) || '&bbsId=3' when head like '%//school.jbedu.kr' and regexp_matches(path, '^/[^/]+/[^/]+/?$') then 'https://school.jbedu.kr/rss' || rtrim(path, '/') || '.do' end as feed,
        concat_ws(' ', case when ntt then head || replace(path, 'selectNttList.do', 'selectNttInfo.do') || '?mi=' || regexp_extract(board, 'mi=([0-9]+)', 1) || '&bbsId=3&nttSn=77' end,
          case when cnts then head || '/boardCnts/view.do?boardID=' || id || '&viewBoardID=' || id || '&boardSeq=77&lev=0&action=view&searchType=null&statusYN=W&page=1&m=0203 ' || head || '/boardCnts/updateCnt.do?boardID=' || id || '&viewBoardID=' || id || '&boardSeq=77&lev=0&action=view&searchType=null&srch2=null&statusYN=W&page=1&m=0203' end,
          head || case when regexp_matches(board, '[?#]') then coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') else rtrim(path, '/') || '/' end || 'view/77', head || path || '?' || case when query <> '' then replace(query, '/', '%2F') || '&' else '' end || 'id=77') as posts from p"""),
}
