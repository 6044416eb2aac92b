"""What a write does to a keyed table, as a table: on Parquet the result replaces the old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str, keep_first: list[str] | None = None) -> DataFrame:
    """Newest row of each key of either; of columns in keep_first the oldest value. One partial aggregation, no join."""
    rows = base.unionByName(changes)
    rest = [c for c in base.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(order)).alias("_r")  # a struct is never null, so rows without an order count, as the lowest
    first = [F.min_by(c, F.col(order)).alias(f"_{c}") for c in keep_first or []]
    merged = rows.groupBy(*keys).agg(newest, *first)
    return merged.select(*keys, *[F.col(f"_{c}").alias(c) if c in (keep_first or []) else F.col(f"_r.{c}").alias(c) for c in rest])


def insert_absent(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """base and those rows whose key it lacks."""
    return base.unionByName(rows.join(base.select(*keys).distinct(), keys, "left_anti").select(*base.columns))


def replace_range(base: DataFrame, rows: DataFrame, within: Column) -> DataFrame:
    """base without the rows in the range, and the new rows."""
    return base.where(~F.coalesce(within, F.lit(False))).unionByName(rows)


def diff_replace(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, the new values, and action: insert, update, delete or keep."""
    o = old.select(*keys, *[F.col(v).alias(f"_o_{v}") for v in values], F.lit(True).alias("_old"))
    n = new.select(*keys, *values, F.lit(True).alias("_new"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_o_{v}"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(same, "keep").otherwise("update")
    return o.join(n, keys, "full_outer").select(*keys, *values, action.alias("action"))
