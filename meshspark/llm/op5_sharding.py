"""Sharding by a minimax contiguous partition of atomic groups.

Groups are the documents of one text (by its 64-bit hash), ordered by that hash.  The shards are contiguous
ranges of this order; the largest shard is as small as whole groups allow.  The smallest feasible capacity is
found by binary search with a greedy check, on the driver, over a summary of bounded size: the hash range is
cut into 2**16 segments with their byte sums; segments that a cut could fall into are split further, by one
aggregation a level, until every cut falls between single groups.  A segment list holds a fixed number of
segments however many documents there are.

Where the greedy ranges are uneven only because one group is huge, ranges filled to the mean of what remains
are taken instead, provided that they keep to the same capacity.

Defined results: a null text counts 0 bytes (plus 1) and forms a group of its own with crc32 0; repeated rows
and null ids are kept as they are; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_of, hash38, staged, table

SHARDS = 16
#: Hash bits that the first summary keeps, and those that each further level adds.
FIRST_BITS, MORE_BITS = 16, 8


@dataclass(frozen=True)
class Segment:
    """A range of group keys: those with key >> shift == prefix."""

    prefix: int
    shift: int
    size: int
    single: bool  # one group only

    @property
    def last(self) -> int:
        return ((self.prefix + 1) << self.shift) - 1


def _greedy(segs: list[Segment], capacity: int, shards: int, whole: bool) -> list[int] | None:
    """Indexes of the segments in which each shard but the last ends, or None if more shards are needed.

    whole: segments are kept whole; else a segment of several groups may be cut anywhere.
    """
    cuts, room = [], capacity
    for i, s in enumerate(segs):
        left = s.size
        if left > room:
            if whole or s.single:
                if left > capacity:
                    return None
                cuts.append(i - 1)
                room = capacity - left
            else:
                left -= room
                cuts += [i] * (1 + (left - 1) // capacity)
                room = capacity - (left - (left - 1) // capacity * capacity)
            if len(cuts) >= shards:
                return None
        else:
            room -= left
    return cuts + [len(segs) - 1] * (shards - 1 - len(cuts))


def _smallest(segs: list[Segment], shards: int, whole: bool) -> int:
    """The smallest capacity that the greedy check accepts."""
    lo, hi = 1, max(1, sum(s.size for s in segs))
    while lo < hi:
        mid = (lo + hi) // 2
        if _greedy(segs, mid, shards, whole) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def _even(segs: list[Segment], shards: int, capacity: int) -> list[int] | None:
    """Cuts nearest to the mean of what remains, if every shard keeps to the capacity."""
    left, cuts, i = sum(s.size for s in segs), [], 0
    for k in range(shards - 1):
        goal, got = -(-left // (shards - k)), 0
        while i < len(segs) and (got == 0 or got + segs[i].size / 2 <= goal and got + segs[i].size <= capacity):
            got += segs[i].size
            i += 1
        if got > capacity:
            return None
        left -= got
        cuts.append(i - 1)
    return cuts if left <= capacity else None


def _summary(rows: DataFrame, shift: int) -> list[Segment]:
    got = rows.groupBy(F.shiftright("key", shift).alias("prefix")).agg(F.sum("size").alias("size"), (F.min("key") == F.max("key")).alias("single"))
    return [Segment(r["prefix"], shift, r["size"], r["single"]) for r in got.collect()]


def cut_points(rows: DataFrame, shards: int) -> list[int]:
    """The last key of each shard but the last, for rows (key, size)."""
    shift = 64 - FIRST_BITS
    segs = sorted(_summary(rows, shift), key=lambda s: s.last)
    while True:
        low = _greedy(segs, max(_smallest(segs, shards, False), 1), shards, False)
        best = _smallest(segs, shards, True)
        tight = _greedy(segs, best, shards, True)
        high = _even(segs, shards, best) or tight
        near = {i for a, b in [*zip(low, tight, strict=True), *zip(high, high, strict=True)] for i in range(max(0, min(a, b) - 1), min(len(segs), max(a, b) + 2))}
        open_ = {i for i in near if not segs[i].single and segs[i].shift}
        if not segs or not open_:
            return [segs[i].last if i >= 0 else -(1 << 63) for i in high]
        parts = [s for i, s in enumerate(segs) if i not in open_]
        for at in sorted({segs[i].shift for i in open_}):
            inside = [segs[i].prefix for i in open_ if segs[i].shift == at]
            parts += _summary(rows.where(F.shiftright("key", at).isin(inside)), max(0, at - MORE_BITS))
        segs = sorted(parts, key=lambda s: s.last)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = staged(rows, "shard-rows")
    cuts = cut_points(rows.select("key", "size"), shards)
    placed = F.lit(0)
    for c in cuts:
        placed = placed + (F.col("key") > F.lit(c)).cast("int")
    n = rows.count()
    # Slots: rank within a shard in the order of a hash, which spreads copies too; ranked in two levels.
    rows = rows.withColumn("shard", placed).withColumn("h", hash38("key", "doc_id"))
    rows = rows.withColumn("bucket", bucket_of(F.col("h"), n))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("h", "key", "doc_id", "size")) - 1
    rows = rows.withColumn("inside", inside).join(bases, ["shard", "bucket"])
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("inside")).cast("long").alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents in one of 16 shards of near equal bytes."""
    got = shard(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
