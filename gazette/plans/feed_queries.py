"""Queries on feed files that are written from the pages: items with attachments, links to be repaired, and items that are no XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.operators.folders import shared_folder
from gazette.plans.base import Query, table
from gazette.sources import feeds

FEED = "https://feeds.example.kr/rss.xml"
# Read alike by Spark and DuckDB: links as feeds give them, by number and language of a page.
_LINK = """case page_id % 6 when 0 then 'feeds.example.kr/' || split_part(url, '/', 4) || '/' || split_part(url, '/', 4) || '/' || page_id when 1 then '/x/' || page_id when 2 then '  ' when 3 then '//feeds.example.kr/y/' || page_id || '/#top' when 4 then 'https://feeds.example.kr/z?id=' || page_id else 'https://evil.example.com/' || page_id end"""


def s6_feed_posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts read from the files: the menu's links of a page are its attachments, its title is taken as it is escaped."""
    path = shared_folder(spark, "feeds")
    pages = table(spark, d, "pages")
    files = F.regexp_replace(F.array_join(F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">[^<]*</a></li>'), F.lit(0)), ""), '<li><a href="([^"]*)">([^<]*)</a></li>', "<file><fileNm>$2</fileNm><dwldUrl>$1</dwldUrl></file>")
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    item = F.concat(F.lit("<item><title> "), title, F.lit("</title><link>"), F.expr(_LINK), F.lit('</link><guid isPermaLink="false">/g/'), F.col("page_id").cast("string"), F.lit("</guid>"), files, F.lit("</item>"))
    pages.select(item.alias("value")).write.text(path)
    found = feeds.posts(feeds.rss_file_items(spark, path).where(F.col(feeds.BROKEN).isNull()).drop(feeds.BROKEN), F.lit(FEED))
    return found.select(F.regexp_extract("guid", "[0-9]+", 0).cast("long").alias("page_id"), "title", "link", F.array_join(F.transform("attachments", lambda a: F.concat(a["name"], F.lit(" "), a["url"])), "; ").alias("attachments"))


_PLAIN = "trim(regexp_replace(replace({0}, '&quot;', chr(34)), '&amp;', '&', 'g'))"
_SQL = f"""with p as (select page_id, {_LINK} as link, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) as refs, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) as names, url from pages),
  f as (select *, list_transform(range(len(refs)), lambda i: {_PLAIN.format("names[i + 1]")} || ' https://feeds.example.kr' || rtrim({_PLAIN.format("refs[i + 1]")}, '/')) as files from p where not contains(regexp_replace(title || array_to_string(refs, '') || array_to_string(names, ''), '&(?:amp|quot);', '', 'g'), '&'))
  select page_id, {_PLAIN.format("title")} as title, 'https://feeds.example.kr/' || case page_id % 6 when 0 then split_part(url, '/', 4) || '/' || page_id when 1 then 'x/' || page_id when 2 then 'g/' || page_id when 3 then 'y/' || page_id else 'z?id=' || page_id end as link, array_to_string(list_filter(files, lambda x: not starts_with(x, ' ')), '; ') as attachments
  from f where page_id % 6 <> 5 and trim(title) <> ''"""
QUERIES: dict[str, Query] = {"s6_feed_posts": (s6_feed_posts, _SQL)}
