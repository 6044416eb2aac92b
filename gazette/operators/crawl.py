"""Candidates of a crawl: links under menus, the best of each URL, what a page's signals say, counts against expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.functions.links import link_tier
from gazette.functions.text import round_half_up


def expanded(candidates: DataFrame, menus: DataFrame, parent: str, menu: str) -> DataFrame:
    """Candidates (id, label, url, score) with the score of the menu that they stand under added, and context `menu > `."""
    met = candidates.join(menus, candidates[parent] == menus[menu], "left")
    context = F.coalesce(F.concat("menu_label", F.lit(" > ")), F.lit(""))
    return met.select("id", "label", "url", context.alias("context"), (F.col("score") + F.coalesce("menu_score", F.lit(0))).alias("score"))


def best_links(candidates: DataFrame, limit: int) -> DataFrame:
    """Of candidates with one URL the one of best tier, then score, then first; of these the best, with their place."""
    ranked = candidates.withColumn("tier", link_tier("label", "context"))
    rest = [c for c in ranked.columns if c != "url"]
    one = ranked.groupBy("url").agg(F.min_by(F.struct(*rest), F.struct("tier", -F.col("score"), "id")).alias("r")).select("url", "r.*")
    top = one.orderBy("tier", F.desc("score"), "id").limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy("tier", F.desc("score"), "id")))  # limit rows


def detected(signals: DataFrame, page: str, ordinal: str, signal: str, weight: str, full: float = 120.0) -> DataFrame:
    """page, signal, score, confidence: the signal of greatest sum, of equal ones the first named."""
    sums = signals.groupBy(page, signal).agg(F.sum(weight).cast("long").alias("score"), F.min(ordinal).alias("first"))
    best = sums.groupBy(page).agg(F.max_by(F.struct(signal, "score"), F.struct("score", -F.col("first"))).alias("b")).select(page, "b.*")
    return best.withColumn("confidence", F.least(round_half_up(F.col("score") / full, 2), F.lit(0.99)))


def audited(counts: DataFrame, wanted: DataFrame, keys: list[str], n: str, expected: str) -> DataFrame:
    """Counts of what is expected, 0 where there are none, and whether they are as expected."""
    met = wanted.join(counts, keys, "left").withColumn(n, F.coalesce(n, F.lit(0)).cast("long"))
    return met.select(*keys, n, expected, (F.col(n) == F.col(expected)).alias("as_expected"))
