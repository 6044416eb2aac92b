"""Budgets, archives, attachments and pages of results: rows admitted in order, first wins, whole groups refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.text import BLANK

#: File names that say nothing.
WEAK_NAMES = ("attachment", "download", "filedown", "filedown.do", "filedownload.do", "nttfiledownload.do")


def within_budget(df: DataFrame, group: str, order: str, cost: Column, max_count: int = 8, max_cost: int = 26_214_400) -> DataFrame:
    """Add admitted: rows of a group are taken in order while their number and cost allow; one too dear is passed over.

    What is passed over costs nothing, so this is a fold over a group's rows, of which there are few (the pictures of a notice).
    """
    item = F.struct(F.col(order).alias("o"), cost.cast("long").alias("c"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{df.schema[order].dataType.simpleString()}>").alias("taken"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["n"] < max_count) & (s["used"] + x["c"] <= max_cost)
        return F.when(fits, F.struct((s["n"] + 1).alias("n"), (s["used"] + x["c"]).alias("used"), F.concat(s["taken"], F.array(x["o"])).alias("taken"))).otherwise(s)

    taken = df.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("_items")).select(F.col(group), F.aggregate("_items", start, step, lambda s: s["taken"]).alias("_taken"))
    return df.join(taken, group).withColumn("admitted", F.array_contains("_taken", F.col(order))).drop("_taken")


def archive_errors(entries: DataFrame, archive: str, name: str, size: str, packed: str, max_total: int = 104_857_600, max_entry: int = 52_428_800, max_ratio: float = 100.0) -> DataFrame:
    """archive and error, null if it may be opened: entries or sums too large, or packed too well to be true."""
    n = F.col(size)
    checks = [
        ("zip_entry_too_large", F.bool_or(n > max_entry)), ("zip_uncompressed_too_large", F.sum(n) > max_total), ("zip_invalid_zero_compressed_entry", F.bool_or((F.col(packed) == 0) & (n > 0))),
        ("zip_compression_ratio_too_high", F.bool_or((F.col(packed) > 0) & (n > F.col(packed) * max_ratio))),
    ]
    found = F.coalesce(*[F.when(holds, code) for code, holds in checks])
    return entries.groupBy(archive).agg(found.alias("error"))


def name_key(c: Column) -> Column:
    """A file name without white space in lower case; null where it says nothing."""
    key = F.lower(F.regexp_replace(c, BLANK + "+", ""))
    return F.when(~key.isin("", *WEAK_NAMES), key)


def first_attachments(refs: DataFrame, group: str, order: str, url: str, name: str) -> DataFrame:
    """Attachments of a group in order, without those whose URL or telling name one that stays has already.

    A fold, as one that goes bars none of those after it; a notice has few attachments.
    """
    item = F.struct(F.col(order).alias("o"), F.col(url).alias("u"), name_key(F.col(name)).alias("k"))
    kind = f"struct<kept:array<{refs.schema[order].dataType.simpleString()}>,urls:array<string>,keys:array<string>>"
    start = F.struct(F.array().alias("kept"), F.array().alias("urls"), F.array().alias("keys")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        known = F.array_contains(s["urls"], x["u"]) | F.coalesce(F.array_contains(s["keys"], x["k"]), F.lit(False))
        keys = F.when(x["k"].isNotNull(), F.concat(s["keys"], F.array(x["k"]))).otherwise(s["keys"])
        return F.when(known, s).otherwise(F.struct(F.concat(s["kept"], F.array(x["o"])).alias("kept"), F.concat(s["urls"], F.array(x["u"])).alias("urls"), keys.alias("keys")))

    kept = refs.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("_items")).select(F.col(group), F.aggregate("_items", start, step, lambda s: s["kept"]).alias("_kept"))
    return refs.join(kept, group).where(F.array_contains("_kept", F.col(order))).drop("_kept")


def paged_entries(pages: DataFrame, page: str, keys: list[str], size: int = 100, max_pages: int = 10) -> DataFrame:
    """Entries of a paged answer: pages up to the first short one, ten at most; of entries with equal keys that of the last page and row.

    pages: page (from 1), row, entry columns.
    """
    counts = pages.groupBy(page).agg(F.count(F.lit(1)).alias("n"))
    last = counts.where((F.col("n") < size) | (F.col(page) >= max_pages)).agg(F.min(page)).first()[0]
    read = pages if last is None else pages.where(F.col(page) <= last)
    rest = [c for c in read.columns if c not in keys]
    return read.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(page, "row")).alias("_r")).select(*keys, "_r.*")


def regressions(pairs: DataFrame, base: str, arm: str, text: str, status: str) -> DataFrame:
    """One row of gates for two arms: statuses that passed and do not any more, placeholders left, runs that broke."""
    lost = (F.col(base) == "passed") & (F.col(arm) != "passed")
    return pairs.agg(F.count_if(lost).alias("lost"), F.count_if(F.coalesce(F.col(text).contains("{{"), F.lit(False))).alias("placeholders"), F.count_if(F.col(status) == "driver_error").alias("errors"))

