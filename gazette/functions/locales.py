"""Picks among texts by locale, titles for display, usable translations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.text import BLANK, blank_to_null, col, strip


def pick(texts: Column | str, locale: Column) -> Column:
    """The text of the locale, else the Korean one, else the first that is not empty, in the map's order."""
    m = col(texts)
    filled = lambda x: F.when(x != "", x)
    return F.coalesce(filled(m[locale]), filled(m[F.lit("ko")]), F.get(F.filter(F.map_values(m), lambda x: x != ""), F.lit(0)))


def pick_reason(texts: Column | str, locale: Column) -> Column:
    """As pick, but trimmed, and null where neither locale has one."""
    return F.coalesce(blank_to_null(col(texts)[locale]), blank_to_null(col(texts)[F.lit("ko")]))


def clean_title(c: Column, cut: int = 60) -> Column:
    return F.substring(strip(F.regexp_replace(c, rf"^{BLANK}{{0,3}}#{{1,6}}{BLANK}+", "")), 1, cut)


def summary_line(c: Column, cut: int = 60) -> Column:
    """The first line of a summary that is not blank as a whole; null if that line is blank."""
    return F.when(strip(c) != "", F.nullif(F.substring(strip(F.split(c, "\n")[0]), 1, cut), F.lit("")))


def display_title(locale: Column, title: Column, titles: Column, summary: Column, summaries: Column, fallback: Column) -> Column:
    """The title shown: in Korean the title, then the summary; else the translated title, the translated summary, then the title."""
    own = F.when(strip(title) != "", clean_title(title))
    korean = F.coalesce(own, clean_title(summary_line(summary)))
    other = F.coalesce(F.when(strip(titles[locale]) != "", clean_title(strip(titles[locale]))), clean_title(summary_line(summaries[locale])), own)
    return F.coalesce(F.when(locale == "ko", korean).otherwise(other), fallback)


def normal_locale(c: Column | str) -> Column:
    """A language code in lower case, with its region if it has one; null for Korean and for what is no code."""
    t = F.lower(strip(c))
    return F.when(t.rlike("^[a-z]{2,3}(?:-[a-z0-9]{2,8})?$") & (t != "ko"), t)


def usable(text: Column | str, status: Column | str) -> Column:
    """Whether a translation may be shown."""
    return F.coalesce((strip(text) != "") & (col(status) != "failed"), F.lit(False))
