"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.shared import drop_saved, save


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. The least neighbour of a node is pre-aggregated; a hot node's edges meet it in a join that can be split."""
    out = edges.select("a", "b")
    around = out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else out
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
    met = around.join(least, around["a"] == least["u"])
    if large:
        made = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        made = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    made = made.where("a <> b")
    return made.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """edges: bigint a and b. Returns node and component (its least node) for every node with an edge to another."""
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    was = now.agg(F.count(F.lit(1)), mark).first()
    if was[0] == 0:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(rounds):
        old, now = now, save(_star(_star(now, True), False), "edges")
        drop_saved(old)
        state = now.agg(F.count(F.lit(1)), mark).first()
        if state == was:
            break
        was = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
