"""Queries on whole pages: body text by the cascade, titles with snippets, and tables. The boxes of board software are spliced into the given pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import html_tree, links
from gazette.plans.base import Query, modest_batches, spread, table

# Read alike by Spark and DuckDB: the article becomes a box of one of several kinds, or gets an empty one before it.
_BOX = """case page_id % 6 when 0 then replace(replace(html, '<article>', '<div class="x conts">'), '</article>', '</div>') when 1 then replace(replace(html, '<article>', '<div class="board_view">'), '</article>', '</div><div class="file">attached</div>')
  when 2 then replace(replace(html, '<article>', '<div id="viewConts">'), '</article>', '</div><div class="conts">never</div>') when 3 then replace(html, '<article>', '<div class="conts"><img src="n.png"></div><article>') when 4 then replace(html, '<nav>', '<nav id="gnb"><p>menu</p>') else html end"""
# A table of each page's menu: host and headings span rows and columns; on odd pages the table stands in others that lay out the page.
_HOST = "substr(substr(url, strpos(url, '//') + 2), 1, strpos(substr(url, strpos(url, '//') + 2) || '/', '/') - 1)"


def _host(dialect: str) -> str:
    return _HOST.replace("strpos(", "instr(") if dialect == "spark" else _HOST


def _grid_source(dialect: str) -> str:
    row = "'<li><a href=\"([^\"]*)\">([^<]*)</a></li>'"
    two, one = ("$2", "$1") if dialect == "spark" else ("\\2", "\\1")
    swapped = f"regexp_replace(html, {row}, '<tr><td>{two}<td colspan=\"2\">{one}</tr>'{'' if dialect == 'spark' else ", 'g'"})"
    head = f"'<table><tr><th rowspan=\"2\">' || {_host(dialect)} || '</th><th colspan=\"2\">links</th></tr><tr><td>text<td>href</tr>'"
    inner = f"replace(replace({swapped}, '<ul>', {head}), '</ul>', '</table>')"
    return f"case when page_id % 2 = 1 then replace(replace({inner}, '<nav>', '<table><tr><td>menu<table><tr><td>'), '</nav>', '</td></tr></table></td></tr></table>') else {inner} end"


def _pages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Whole pages for work in Python."""
    modest_batches(spark)
    return spread(table(spark, d, "pages").select(*columns))


def c3_body(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d, "page_id", "html")
    return pages.select("page_id", html_tree.body_text(F.expr(_BOX)).alias("body"))


def c8_heads(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d, "page_id", "html")
    return pages.select("page_id", html_tree.title_and_snippet("html", 300).alias("h")).select("page_id", "h.title", "h.snippet")


def c51_grids(spark: SparkSession, d: str) -> DataFrame:
    """A row for each row of each grid, its cells joined by bars."""
    pages = _pages(spark, d, "page_id", "url", "html")
    grids = pages.select("page_id", F.explode(html_tree.table_grids(F.expr(_grid_source("spark")))).alias("grid"))
    return grids.select("page_id", F.posexplode("grid").alias("row", "cells")).select("page_id", "row", F.array_join("cells", "|").alias("cells"))


# Read alike by Spark and DuckDB: cues of a barred page at the head of the text, in the title, in the footer where they mean nothing, and in the address.
_CUED = """case page_id % 8 when 0 then replace(html, '<nav>', '<p>이 게시판은 로그인 후 이용할 수 있습니다.</p><nav>') when 1 then replace(html, '<nav>', '<p>로그인 후 이용 - 작성일 순</p><nav>') when 2 then replace(html, '<footer>', '<footer>권한이 없습니다 로그인이 필요 AuthReadError') when 3 then replace(html, '<title>', '<title>권한이 없습니다 ')
  when 4 then replace(html, '<nav>', '<p>비공개 설정된 글입니다</p><nav>') when 5 then replace(html, '<nav>', '<script>var x = "게시판 접근 권한"</script><nav>') when 6 then replace(html, '<nav>', '<form action=loginPost.php id=fm_xb_login></form><nav>') else html end"""
_ASKED = "case page_id % 9 when 0 then url || '&mode=LOGIN' when 1 then 'https://schoolbell-e.com/' || page_id else url end"
_STATUS = "case page_id % 10 when 0 then 403 when 1 then 200 else null end"


def c16_barred(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d, "page_id", "url", "html")
    return pages.select("page_id", links.access_failure(F.expr(_ASKED), F.expr(_STATUS), F.expr(_CUED)).alias("failure"))


_PLAIN = "regexp_replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"
_CUT = "regexp_replace(regexp_replace({x}, '(?s)<script.*?(?:</script>|$)|<style.*?(?:</style>|$){more}|<!--.*?(?:-->|$)', {by}, 'g'), '<[^>]*(?:>|$)', {by}, 'g')"
_BODY = _PLAIN.format(x=_CUT.format(x="part", more='|<nav.*?(?:</nav>|$)|<footer.*?(?:</footer>|$)|<div class="file">.*?(?:</div>|$)', by="chr(10)"))
_SNIPPET = _PLAIN.format(x=_CUT.format(x="html", more="", by="' '"))
QUERIES: dict[str, Query] = {
    "c3_body": (c3_body, f"""with p as (select page_id, {_BOX} as html from pages), q as (select page_id, case when page_id % 6 = 2 then regexp_extract(html, '(?s)<div id="viewConts">(.*?)(?:</div>|$)', 1) when page_id % 6 = 0 then regexp_extract(html, '(?s)<div class="x conts">(.*?)(?:</div>|$)', 1)
        when page_id % 6 = 1 then regexp_extract(html, '(?s)<div class="board_view">(.*?)(?:</div>|$)', 1) else regexp_extract(html, '(?s)<body>(.*)', 1) end as part from p)
      select page_id, array_to_string(list_filter(list_transform(string_split({_BODY}, chr(10)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), lambda l: l <> ''), chr(10)) as body from q"""),
    "c8_heads": (c8_heads, f"""select page_id, trim({_PLAIN.format(x="regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) as title, left(trim(regexp_replace({_SNIPPET}, '\\s+', ' ', 'g')), 300) as snippet from pages"""),
    "c16_barred": (c16_barred, rf"""with p as (select page_id, {_ASKED} as url, {_STATUS} as status, {_CUED} as html from pages), t as (select *, lower(regexp_replace({_SNIPPET}, '\s+', ' ', 'g')) as text, lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) as title from p),
      u as (select *, lower(url) || ' ' || title || ' ' || substr(trim(text), 1, 500) as seen, replace(substr(trim(text), 1, 2000), ' ', '') as compact from t)
      select page_id, case when status in (401, 403) then 'unsupported_forbidden' when contains(url, '//schoolbell-e.com/') then 'unsupported_external_dynamic' when contains(lower(url), 'mode=login') or (contains(lower(html), 'loginpost.php') and contains(lower(html), 'fm_xb_login'))
        or regexp_matches(seen, 'authreaderror|게시판 접근 권한|권한이 없습니다|로그인이 필요|비공개 설정된 글|authorization required') or (contains(compact, '로그인후이용') and not regexp_matches(compact, '게시판목록|총|작성일|조회수|등록일|첨부파일|selectboardlistajax|fnview|selectnttinfo|boardcnts/view') and not regexp_matches(substr(trim(text), 1, 2000), '\b20[0-9]{{2}}[./-][0-9]{{1,2}}[./-][0-9]{{1,2}}\b')) then 'unsupported_login_required' end as failure from u"""),
    "c51_grids": (c51_grids, f"""with l as (select page_id, url, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) as names, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) as refs from pages),
      r as (select page_id, list_concat([{_host('duckdb')} || '|links|', '|text|href'], list_transform(range(len(names)), lambda i: {_PLAIN.format(x="trim(regexp_replace(names[i + 1], '\\s+', ' ', 'g'))")} || '|' || {_PLAIN.format(x="refs[i + 1]")} || '|')) as lines from l)
      select page_id, (unnest(range(len(lines))))::int as row, unnest(lines) as cells from r"""),
}
