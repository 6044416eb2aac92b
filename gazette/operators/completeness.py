"""Relational division by counts: keys for which everything that is required is present, and batches of such keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def requirement(rows: DataFrame, kind: str, key: Column, element: Column) -> DataFrame:
    """Elements that a key needs. An element belongs to one key, as a card to its notice; null elements ask for nothing."""
    return rows.select(F.lit(kind).alias("kind"), element.cast("string").alias("element"), key.cast("string").alias("key"), F.lit(False).alias("there")).where("element is not null and key is not null")


def presence(rows: DataFrame, kind: str, element: Column) -> DataFrame:
    """Elements that are there; their key is known from the requirement."""
    return rows.select(F.lit(kind).alias("kind"), element.cast("string").alias("element"), F.lit(None).cast("string").alias("key"), F.lit(True).alias("there")).where("element is not null")


def divided(keys: DataFrame, key: str, required: Iterable[DataFrame], present: Iterable[DataFrame]) -> DataFrame:
    """key, required, present and complete of each key, and missing: the kinds of which something is missing, in order of name.

    Required and present elements are put in one list and grouped by element, which says of each required one
    whether it is there; a second grouping counts them by key. The sets never meet in a join, each element is
    pre-aggregated where it is read, and a key that requires nothing is complete.
    """
    rows = [*required, *present]
    united = rows[0]
    for more in rows[1:]:
        united = united.unionByName(more)
    of_element = united.groupBy("kind", "element").agg(F.max("key").alias("key"), F.bool_or("there").alias("there")).where("key is not null")
    of_kind = of_element.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("there").alias("got"))
    of_key = of_kind.groupBy("key").agg(F.sum("n").alias("required"), F.sum("got").alias("present"), F.array_sort(F.collect_list(F.when(F.col("got") < F.col("n"), F.col("kind")))).alias("missing"))  # a few kinds a key
    asked = keys.select(F.col(key).cast("string").alias("_key"), F.col(key)).distinct()
    out = asked.join(of_key, asked["_key"] == of_key["key"], "left").drop("_key") if key != "key" else asked.join(of_key.withColumnRenamed("key", "_of"), F.col("_key") == F.col("_of"), "left").drop("_key", "_of")
    counted = out.select(asked[key], F.coalesce("required", F.lit(0)).alias("required"), F.coalesce("present", F.lit(0)).alias("present"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))
    return counted.withColumn("complete", F.size("missing") == 0)


_BATCH = "struct<locale:string,ids:array<string>,pending:array<string>,phase:string,created_at:timestamp,completed_at:timestamp>"


def _ids(ids: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")))


def _batch(locale: Column, ids: Column, pending: Column, phase: Column | str, created: Column, completed: Column) -> Column:
    return F.struct(locale.alias("locale"), ids.alias("ids"), pending.alias("pending"), (F.lit(phase) if isinstance(phase, str) else phase).alias("phase"), created.alias("created_at"), completed.alias("completed_at")).cast(_BATCH)


def synced(batch: Column, locale: Column, ids: Column, now: Column) -> Column:
    """A batch after it is held against the ids that are pending now: struct of locale, ids, pending, phase, created_at, completed_at.

    None left ends a pending batch of the locale. A missing or complete batch, or one of another locale, is begun anew; else
    the ids take the place of the batch's own and of its pending ones. Null stands for no batch.
    """
    wanted, none = _ids(ids), F.lit(None).cast("timestamp")
    empty = F.array().cast("array<string>")
    ended = _batch(batch["locale"], batch["ids"], empty, "complete", batch["created_at"], F.coalesce(batch["completed_at"], now))
    begun = _batch(locale, wanted, wanted, "pending", now, none)
    moved = _batch(batch["locale"], wanted, wanted, "pending", batch["created_at"], none)
    pending_here = batch.isNotNull() & (batch["locale"] == locale) & (batch["phase"] == "pending")
    return (
        F.when((F.size(wanted) == 0) & F.coalesce(pending_here, F.lit(False)), ended).when(F.size(wanted) == 0, batch.cast(_BATCH)).when(~F.coalesce(pending_here, F.lit(False)), begun)
        .when((batch["ids"] == wanted) & (batch["pending"] == wanted), batch.cast(_BATCH)).otherwise(moved)
    )


def progressed(batch: Column, pending: Column, now: Column) -> Column:
    """A batch with what is still pending: complete when nothing is, at the time it first was."""
    left = _ids(pending)
    done = F.size(left) == 0
    return F.when(batch.isNotNull(), _batch(batch["locale"], batch["ids"], left, F.when(done, "complete").otherwise("pending"), batch["created_at"], F.when(done, F.coalesce(batch["completed_at"], now))))
