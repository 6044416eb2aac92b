"""Picking rows of a group: one window over the group's key, with orders that end in a unique column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; n small, so most rows go before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest_by(df: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """The whole row with the greatest value of at, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("_r")).select(*keys, "_r.*")


def round_robin(df: DataFrame, kind: str, order: str, target: int) -> DataFrame:
    """target rows, taken in turn from each kind; position from 1."""
    w = Window.partitionBy(kind).orderBy(order)
    each = df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= target)
    picked = each.orderBy("turn", kind).limit(target)
    return picked.withColumn("position", F.row_number().over(Window.orderBy("turn", kind)))  # target rows


def event_winners(df: DataFrame, group: str, start: str, end: str, ordinal: str, kinds: str | None = None) -> DataFrame:
    """Of rows of a group that end on the same day: the earliest start, then one with an end, then the first seen. Rows with a null group all stay.

    A row without an end, or with one before its start, ends on its start. The kinds of rows that go are added to
    those of the row that stays, in the order in which they were seen, unless it has no list of kinds. A group's rows are few: the events of one notice.
    """
    last = F.when(F.col(end) >= F.col(start), F.col(end)).otherwise(F.col(start))
    whole = Window.partitionBy(group, "_last").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = Window.partitionBy(group, "_last").orderBy(start, F.col(end).isNull(), ordinal)
    numbered = df.where(F.col(group).isNotNull()).withColumn("_last", last)
    if kinds:
        numbered = numbered.withColumn("_kinds", F.flatten(F.collect_list(F.coalesce(F.col(kinds), F.array().cast(df.schema[kinds].dataType))).over(whole)))
        numbered = numbered.withColumn(kinds, F.when(F.col(kinds).isNotNull(), F.array_distinct(F.concat(kinds, "_kinds"))))
    numbered = numbered.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*df.columns)
    return numbered.unionByName(df.where(F.col(group).isNull()))
