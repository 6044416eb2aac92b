"""Calendars: spines, ranges, periods of a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.functions.locales import display_title
from gazette.operators.picks import event_winners


def with_spine(df: DataFrame, key: str, day: str, first: Column, last: Column) -> DataFrame:
    """A row for each key and day from first to last, with the facts of that day or nulls."""
    days = df.select(key).distinct().withColumn(day, F.explode(F.sequence(first, last)))
    return days.join(df, [key, day], "left")


def daily(df: DataFrame, start: str, end: str, day: str = "day") -> DataFrame:
    """A row for each day of a range, both ends included."""
    return df.withColumn(day, F.explode(F.sequence(F.col(start), F.coalesce(F.col(end), F.col(start)))))


def in_month(start: Column, end: Column, month: Column) -> Column:
    """The range meets the month that begins on month."""
    return (start <= F.last_day(month)) & (F.coalesce(end, start) >= month)


def event_cards(events: DataFrame, notices: DataFrame, translations: DataFrame, locale: str, fallback: str) -> DataFrame:
    """Events of a calendar with what is shown of their notices: display_title, location in the locale if there is one, source_title, and pending: the notice's text is still to be translated.

    events: id, notice_id, title, event_date, end_date, event_kinds, location, others pass. notices: id, title, summary, summaries (map by
    locale). translations: notice_id, target_language, translated_title, translated_location, translated_text; empty ones count as none.
    Translations of the locale are gathered to a row a notice before they meet the events. Of a notice's events that end on one day one stays.
    """
    mine = translations.where((F.col("target_language") == locale) & F.col("notice_id").isNotNull())
    filled = lambda c: F.max(F.nullif(F.col(c), F.lit("")))
    told = mine.groupBy(F.col("notice_id").alias("_told")).agg(filled("translated_title").alias("_title"), filled("translated_location").alias("_place"), filled("translated_text").alias("_text"))
    known = notices.select(F.col("id").alias("_notice"), F.col("title").alias("_own"), F.col("summary").alias("_summary"), F.col("summaries").alias("_summaries"))
    once_a_day = event_winners(events, "notice_id", "event_date", "end_date", "id", "event_kinds")
    met = once_a_day.join(known, F.col("notice_id") == F.col("_notice"), "left").join(told, F.col("notice_id") == F.col("_told"), "left")
    source = F.coalesce("_own", "title")
    shown = display_title(F.lit(locale), source, F.create_map(F.lit(locale), F.col("_title")), F.col("_summary"), F.col("_summaries"), F.lit(fallback))
    pending = F.lit(locale != "ko") & F.col("notice_id").isNotNull() & F.col("_text").isNull()
    return met.select(*[c for c in events.columns if c not in ("title", "location")], shown.alias("display_title"), source.alias("source_title"), F.coalesce("_place", "location").alias("location"), pending.alias("pending"))


def period_errors(df: DataFrame, group: str) -> DataFrame:
    """group and valid: whether all its periods are in range, distinct, of sane length and do not overlap. Columns: period, start_min, end_min."""
    w = Window.partitionBy(group).orderBy("period", "start_min")
    checked = df.withColumn("_before", F.lag("end_min").over(w)).withColumn("_same", F.lag("period").over(w) == F.col("period"))
    length = F.col("end_min") - F.col("start_min")
    good = F.col("period").between(1, 12) & F.col("start_min").between(420, 1260) & length.between(20, 120) & ~F.coalesce(F.col("_same"), F.lit(False)) & F.coalesce(F.col("_before") <= F.col("start_min"), F.lit(True))
    return checked.groupBy(group).agg(F.coalesce(F.bool_and(good), F.lit(False)).alias("valid"))
