"""Summaries of runs and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.text import round_half_up


def zero_filled_counts(df: DataFrame, key: str, domain: list[str]) -> DataFrame:
    """A row for each value of the domain, with 0 where there are no rows."""
    known = df.sparkSession.createDataFrame([(x,) for x in domain], f"{key} string")
    return known.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def run_summary(df: DataFrame, ok: Column, fallback: Column, keys: list[str] | None = None, alarm_below: float = 0.5) -> DataFrame:
    """processed, success, failure, fallback, success_rate (1.0 when nothing ran), alarm, outcome."""
    agg = [F.count(F.lit(1)).alias("processed"), F.count_if(ok).alias("success"), F.count_if(fallback).alias("fallback")]
    out = (df.groupBy(*keys) if keys else df.groupBy()).agg(*agg)
    rate = F.when(F.col("processed") == 0, 1.0).otherwise(round_half_up(F.col("success").cast("double") / F.col("processed").cast("double"), 4))
    out = out.withColumn("failure", F.col("processed") - F.col("success")).withColumn("success_rate", rate)
    out = out.withColumn("alarm", (F.col("processed") > 0) & (F.col("success_rate") < alarm_below))
    return out.withColumn("outcome", F.when(F.col("processed") == 0, "idle").when(F.col("alarm"), "alarm").otherwise("ok"))


#: Weights of the eight axes of a review, the last counting most, and what their sum is divided by.
AXES, DIVISOR = (1.0, 1.0, 0.8, 0.8, 0.7, 0.8, 0.7, 2.0), 8.8


def weighted_mark(marks: list[Column], weights: tuple[float, ...] = AXES, divisor: float = DIVISOR) -> Column:
    """The weighted mean of marks, rounded to two digits."""
    total = sum((m * w for m, w in zip(marks[1:], weights[1:], strict=True)), marks[0] * weights[0])
    return round_half_up(total / divisor, 2)
