"""Calendar functions. Today and now are parameters, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.text import col

#: Start of the first lesson, lesson, break and lunch in minutes, lessons before lunch, lessons.
BELLS = {"elementary": (540, 40, 10, 50, 4, 6), "middle": (550, 45, 10, 50, 4, 7), "high": (530, 50, 10, 60, 4, 7)}


def iso_dates(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit("[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.lit(0)))


def month_day_dates(c: Column | str, year: int) -> Column:
    """ISO dates of month/day mentions that lack a year."""
    found = F.regexp_extract_all(col(c), F.lit("(?:^|[^0-9/.])([0-9]{1,2}/[0-9]{1,2})(?:[^0-9/]|$)"), F.lit(1))
    split = F.transform(found, lambda x: F.struct(F.split(x, "/")[0].cast("int").alias("m"), F.split(x, "/")[1].cast("int").alias("d")))
    good = F.filter(split, lambda x: x["m"].between(1, 12) & x["d"].between(1, 31))
    return F.array_distinct(F.transform(good, lambda x: F.format_string("%04d-%02d-%02d", F.lit(year), x["m"], x["d"])))


def date_span(dates: Column) -> Column:
    """First and last of two distinct dates or more; null otherwise."""
    d = F.array_sort(F.array_distinct(dates))
    return F.when(F.size(d) >= 2, F.struct(d[0].alias("first"), F.element_at(d, -1).alias("last")))


def due_label(due: Column | str, today: Column) -> Column:
    """D-DAY, D-n with the date, or null when past."""
    n = F.datediff(col(due), today)
    day = F.concat(F.month(col(due)).cast("string"), F.lit("/"), F.dayofmonth(col(due)).cast("string"))
    return F.when(n == 0, F.concat(F.lit("D-DAY · "), day)).when(n > 0, F.concat(F.lit("D-"), n.cast("string"), F.lit(" · "), day))


def age_label(then: Column | str, now: Column) -> Column:
    """Minutes below an hour, hours below a day, else days."""
    m = F.floor((F.unix_timestamp(now) - F.unix_timestamp(col(then))) / 60)
    return F.when(m < 60, F.concat(m.cast("string"), F.lit("m"))).when(m < 1440, F.concat(F.floor(m / 60).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(m / 1440).cast("string"), F.lit("d")))


def week_start(c: Column | str) -> Column:
    return F.date_trunc("week", col(c)).cast("date")


def academic_year(c: Column | str) -> Column:
    """The year that began on the last 1 March."""
    return F.year(col(c)) - F.when(F.month(col(c)) < 3, 1).otherwise(0)


def academic_bounds(year: Column) -> tuple[Column, Column]:
    return F.make_date(year, F.lit(3), F.lit(1)), F.last_day(F.make_date(year + 1, F.lit(2), F.lit(1)))


def clock(minutes: Column | str) -> Column:
    """HH:MM of minutes of the day, modulo one day."""
    m = F.pmod(col(minutes), F.lit(1440)).cast("int")
    return F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def bell_periods(level: str) -> Column:
    """The periods of a day as an array of period, start_min, end_min."""
    start, lesson, pause, lunch, after, n = BELLS[level]
    begin = lambda p: F.lit(start) + (p - 1) * (lesson + pause) + F.when(p > after, lunch - pause).otherwise(0)
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda p: F.struct(p.alias("period"), begin(p).alias("start_min"), (begin(p) + lesson).alias("end_min")))
