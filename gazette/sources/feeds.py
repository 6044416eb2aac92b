"""Feeds and API envelopes as tables, parsed by Spark's own readers of XML and JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.functions.links import feed_link
from gazette.functions.text import blank_to_null, col, first_non_blank, once

_ITEM = "title string, link string, guid string, pubDate string, description string"
RSS = f"channel struct<title: string, item: array<struct<{', '.join(f'{a}: {b}' for a, b in (x.split() for x in _ITEM.split(', ')))}>>>"
JSON_FEED = "items array<struct<title: string, link: string, guid: string, pubDate: string, description: struct<value: string>>>"
ENVELOPE = "array<struct<head: array<struct<RESULT: struct<CODE: string, MESSAGE: string>>>, row: array<map<string,string>>>>"
#: Result codes.
BENIGN, QUOTA = ("INFO-000", "INFO-200"), "ERROR-337"


def rss_items(df: DataFrame, body: str) -> DataFrame:
    """One row for each item of an RSS 2.0 body; a body that does not parse has none."""
    kept = [c for c in df.columns if c != body]
    parsed = df.withColumn("_x", F.from_xml(F.col(body), F.lit(RSS)))
    return parsed.select(*kept, F.inline("_x.channel.item"))


#: An item of an RSS 2.0 feed with its attachments, and the text of an item that is no XML.
POST = "title string, link string, guid string, pubDate string, description string, file array<struct<fileNm: string, dwldUrl: string>>"
BROKEN = "_corrupt_record"


def _filled(value: Column) -> Column:
    return once(value, lambda v: F.when(v != "", v))


def posts(items: DataFrame, feed: Column | str) -> DataFrame:
    """Items (columns of POST, others pass) as posts: title, link, guid, published_at, body_html and attachments (name, url), blanks as null.

    A link is that of the item, else its guid, as a whole URL of the feed's host; items without a title or such a
    link, and attachments without a name or a URL of that host, are left out.
    """
    feed = col(feed)
    other = [c for c in items.columns if c not in ("title", "link", "guid", "pubDate", "description", "file")]
    files = F.transform(F.coalesce("file", F.array().cast("array<struct<fileNm: string, dwldUrl: string>>")), lambda f: F.struct(blank_to_null(f["fileNm"]).alias("name"), _filled(feed_link(F.coalesce(f["dwldUrl"], F.lit("")), feed)).alias("url")))
    found = items.withColumn("_link", first_non_blank("link", "guid")).select(
        *other, blank_to_null("title").alias("title"), _filled(feed_link(F.col("_link"), feed)).alias("link"), blank_to_null("guid").alias("guid"), blank_to_null("pubDate").alias("published_at"),
        blank_to_null("description").alias("body_html"), F.filter(files, lambda f: f["name"].isNotNull() & f["url"].isNotNull()).alias("attachments"),
    )
    return found.where("title is not null and link is not null")


def rss_posts(df: DataFrame, body: str, feed: Column | str) -> DataFrame:
    """Posts of RSS 2.0 bodies, one a row; a body that is no feed has none."""
    kept = [c for c in df.columns if c != body]
    parsed = df.withColumns({"_x": F.from_xml(F.col(body), F.lit(f"channel struct<item: array<{T.StructType.fromDDL(POST).simpleString()}>>")), "_feed": col(feed)})
    return posts(parsed.select(*kept, "_feed", F.inline("_x.channel.item")), "_feed").drop("_feed")


def rss_file_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of all feed files of a path, and in BROKEN the text of those that are no XML, which spoil no other item.

    Files are split where items end, so one of any size is read by many tasks.
    """
    ends = "</item>"
    chunks = spark.read.option("lineSep", ends).text(path)
    item = F.regexp_extract("value", r"(?s)<item(?:\s[^>]*)?>.*$", 0)
    parsed = F.from_xml(F.concat(item, F.lit(ends)), F.lit(f"{POST}, {BROKEN} string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    return chunks.where(item != "").select(parsed.alias("x")).select("x.*")


def json_items(df: DataFrame, body: str) -> DataFrame:
    kept = [c for c in df.columns if c != body]
    rows = df.withColumn("_x", F.from_json(F.col(body), JSON_FEED)).select(*kept, F.inline("_x.items"))
    return rows.withColumn("description", F.col("description.value"))


def envelope(df: DataFrame, body: str, key: str) -> DataFrame:
    """code, state (ok, quota or error) and rows of an API answer; benign codes without rows give an empty list."""
    blocks = F.from_json(F.get_json_object(F.col(body), f"$.{key}"), ENVELOPE)
    head = F.filter(F.flatten(F.transform(blocks, lambda b: F.coalesce(b["head"], F.array().cast("array<struct<RESULT: struct<CODE: string, MESSAGE: string>>>")))), lambda h: h["RESULT"].isNotNull())
    code = F.coalesce(F.try_element_at(head, F.lit(1))["RESULT"]["CODE"], F.get_json_object(F.col(body), "$.RESULT.CODE"))
    rows = F.flatten(F.filter(F.transform(blocks, lambda b: b["row"]), lambda r: r.isNotNull()))
    state = F.when(code.isin(*BENIGN) | code.isNull(), "ok").when(code == QUOTA, "quota").otherwise("error")
    out = df.withColumns({"code": code, "state": state})
    return out.withColumn("rows", F.when(F.col("state") == "ok", F.coalesce(rows, F.array().cast("array<map<string,string>>"))))
