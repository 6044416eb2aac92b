"""Checks of an output text against its source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.text import col, lines, once, significant_numbers, strip

#: Codes that fail an output; the rest only warn.
BLOCKING = ("empty_output", "hangul_leftover", "too_short", "numbers_lost")
HEADING = r"(?m)^[ \t]{0,3}#{1,6}[ \t]+[^ \t\n]"
ITEM = r"(?m)^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+[^ \t\n]"


def missing(source: Column, out: Column) -> Column:
    return F.array_sort(F.array_except(source, out))


def output_issues(source: Column | str, out: Column | str, target: str = "en") -> Column:
    """Codes of what is wrong with out, in a fixed order; an output without text has empty_output alone."""
    s, o = F.coalesce(col(source), F.lit("")), F.coalesce(col(out), F.lit(""))
    n, m = F.char_length(strip(s)), F.char_length(strip(o))
    fewer = lambda p: (F.regexp_count(s, F.lit(p)) >= 2) & (F.regexp_count(o, F.lit(p)) < F.regexp_count(s, F.lit(p)) * 0.6)
    long = F.filter(F.transform(lines(o), strip), lambda x: F.char_length(x) >= 20)
    repeated = once(long, lambda every: (F.size(every) >= 3) & F.exists(F.array_distinct(every), lambda x: F.size(F.filter(every, lambda y: y == x)) >= 3))
    found = F.array_compact(F.array(
        F.when(F.lit(target != "ko") & o.rlike("[가-힣]{2,}"), "hangul_leftover"), F.when((n >= 200) & (m < n * 0.4), "too_short"),
        F.when(fewer(HEADING), "headings_lost"), F.when(fewer(ITEM), "list_items_lost"), F.when(F.size(missing(significant_numbers(s), significant_numbers(o))) > 0, "numbers_lost"), F.when(repeated, "repeated_line"),
    ))
    return F.when(m == 0, F.array(F.lit("empty_output"))).otherwise(found)


def verdict(issues: Column) -> Column:
    return F.when(F.arrays_overlap(issues, F.array(*[F.lit(x) for x in BLOCKING])), "failed").when(F.size(issues) > 0, "warned").otherwise("passed")


def invented_numbers(source: Column | str, out: Column | str) -> Column:
    """Digit runs of out that source lacks."""
    digits = lambda c: F.array_distinct(F.regexp_extract_all(col(c), F.lit("[0-9]+"), F.lit(0)))
    return missing(digits(out), digits(source))
