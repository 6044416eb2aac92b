"""Pairs of texts of which one holds the other, by an index of runs of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _runs(t: str, size: int) -> F.Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(t) - size + 1), lambda i: F.substring(F.col(t), i, F.lit(size))))


def _held(short: DataFrame, long: DataFrame, size: int) -> DataFrame:
    """short and long: column t, distinct, of ``size`` characters or more. Pairs (inner, outer) with the inner text in the outer one.

    A text can only stand in others that have all of its runs of ``size`` characters, so it meets those that have its
    rarest one, and only these are compared. A text with a run that none of the others has meets nothing.
    """
    there = long.select(F.col("t").alias("outer"), F.explode(_runs("t", size)).alias("run"))
    counts = there.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    wanted = short.select("t", F.explode(_runs("t", size)).alias("run")).join(counts, "run", "left")
    rarest = wanted.groupBy("t").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("least")).where("least.n > 0")
    met = rarest.select(F.col("t").alias("inner"), F.col("least.run").alias("run")).join(there, "run")
    return met.where(F.col("outer").contains(F.col("inner"))).select("inner", "outer")


def containment_pairs(left: DataFrame, left_text: str, right: DataFrame, right_text: str, least: int = 4) -> DataFrame:
    """Distinct texts of both sides, left and right, of ``least`` characters or more, of which one holds the other. Nulls and shorter ones meet nothing."""
    a, b = (df.select(F.col(c).alias("t")).where(F.char_length("t") >= least).distinct() for df, c in ((left, left_text), (right, right_text)))
    inside, around = _held(b, a, least), _held(a, b, least)
    return inside.select(F.col("outer").alias("left"), F.col("inner").alias("right")).unionByName(around.select(F.col("inner").alias("left"), F.col("outer").alias("right"))).distinct()
