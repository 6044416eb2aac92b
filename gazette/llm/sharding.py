"""Sharding by jump consistent hashing (operator 6), native DataFrame expressions only.

The shard of a 64-bit key among n shards comes from a fixed series of pseudo-random jumps; growing from
n to n+1 shards moves a key only if its last jump lands in the new shard. The linear congruential step
needs unsigned 64-bit arithmetic, which Spark's checked bigint lacks, so a key is held as two halves of
32 bits. Each step raises the bucket by one at least, so n steps settle n shards.

Defined results: a null key is treated as key 0; equal keys, and so repeated rows, share a shard; an empty table
gives an empty table. Slots number the rows of a shard from 0 without gaps in key order (ties by the further
columns). A column to be added that exists already is refused, in whatever case it is written; other columns pass, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.shared import free_name, refuse, save

#: Multiplier of the generator, in halves.
_MULTIPLIER = 2862933555777941757
_HI, _LO = _MULTIPLIER >> 32, _MULTIPLIER & 0xFFFFFFFF
_MASK = 0xFFFFFFFF


def _low32(a: Column, b: int) -> Column:
    """The low 32 bits of a product of two 32-bit values; a is taken by 16 bits to stay within bigint."""
    hi, lo = F.shiftright(a, 16), a.bitwiseAND(F.lit(0xFFFF).cast("long"))
    return (F.shiftleft((hi * F.lit(b)).bitwiseAND(F.lit(0xFFFF).cast("long")), 16) + (lo * F.lit(b))).bitwiseAND(F.lit(_MASK))


def _times32(a: Column, b: int) -> tuple[Column, Column]:
    """High and low 32 bits of a product of two 32-bit values."""
    hi, lo = F.shiftright(a, 16) * F.lit(b), a.bitwiseAND(F.lit(0xFFFF).cast("long")) * F.lit(b)  # 48 bits each
    total = F.shiftleft(hi.bitwiseAND(F.lit(0xFFFFFFFF)), 16) + lo  # below 2**49
    return F.shiftleft(F.shiftright(hi, 32), 16) + F.shiftright(total, 32), total.bitwiseAND(F.lit(_MASK))


def _advance(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * multiplier + 1 modulo 2**64."""
    carry, low = _times32(lo, _LO)
    high = carry + _low32(hi, _LO) + _low32(lo, _HI)
    low = low + F.lit(1)
    return (high + F.shiftright(low, 32)).bitwiseAND(F.lit(_MASK)), low.bitwiseAND(F.lit(_MASK))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0 to shards - 1, of a bigint key."""
    if shards < 1:
        raise ValueError("at least one shard")
    k = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(F.shiftrightunsigned(k, 32).alias("hi"), k.bitwiseAND(F.lit(_MASK)).alias("lo"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        hi, lo = _advance(s["hi"], s["lo"])
        j = F.floor((s["j"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + F.lit(1)).cast("double"))).cast("long")
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), j.alias("j"))
        return F.when(s["j"] < F.lit(shards), moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"]).cast("int")


def assign_shards(df: DataFrame, key_col: str, shards: int, shard_col: str = "shard") -> DataFrame:
    """Add shard_col; one narrow projection, no shuffle."""
    refuse(df, shard_col)
    return df.withColumn(shard_col, jump_hash(F.col(key_col), shards))


def number_slots(df: DataFrame, shard_col: str, order: list[str], slot_col: str = "slot", partitions: int | None = None) -> DataFrame:
    """Number the rows of each shard from 0 in the given order.

    Rows are dealt by range of (shard, order), so a shard of any size spans many tasks; the dealt table is
    written once and a row's slot is its place in its partition plus the rows of the shard before it. Only
    one count for each partition and shard meets in a window.
    """
    refuse(df, slot_col)
    at, part = free_name(df, "_at"), free_name(df, "_part")
    n = partitions or max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(n, shard_col, *order).sortWithinPartitions(shard_col, *order)
    dealt = save(dealt.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33)), "slots")
    counts = dealt.groupBy(F.col(part).alias("p"), F.col(shard_col).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"))
    before = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("p", "s", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    joined = dealt.join(F.broadcast(offsets), (dealt[part] == offsets["p"]) & dealt[shard_col].eqNullSafe(offsets["s"]))
    return joined.select(*[dealt[c] for c in df.columns], (dealt[at] + offsets["shift"]).alias(slot_col))
