"""Mixing sources to target weights by a low-discrepancy source schedule (DataFrame functions only).

The mix is a sequence of slots of BLOCK words, as many as the targets need.  Slot i owns the golden-ratio point
i * phi mod 1.  Its place among all points, counted in parallel ranges, is looked up in the cumulative numbers of
slots of the sources, so each source gets exactly its slots and they are spread over the mix as evenly as the points.
Slots are ranked per source (two levels, so that a source with a third of all slots is ranked in parallel) and the
r-th slot of a source takes the r-th equal-token block of that source's shuffled documents, starting over when a pass
is complete.  A source's last slot takes only what its target lacks, so taken words equal the target rounded down.

Defined results: null or empty texts have size 0 and are taken 0 times; a null source is a source of its own
and comes last; repeated rows are mixed as separate documents; an empty table gives no rows; further columns
of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import RANK_ROWS, WORD, bucket_of, hash38, staged, table

#: Words in a slot.
BLOCK = 4096
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
CAP = 3
#: round(2**31 / golden ratio): slot i owns the point (i * PHI31 mod 2**31) / 2**31.
PHI31 = 1327217885
#: Slots that are ranked in one group.
CHUNK_BITS = 16


@dataclass
class Mix:
    documents: DataFrame  # doc_id, source, size, source_size, target, taken, first_slot, n_slots, row (of the input)
    schedule: DataFrame  # slot, source, rank, pass, block, doc_id, from_word, to_word
    sources: DataFrame  # source, size, weight, target


def targets(sized: DataFrame, weights=WEIGHTS, cap=CAP) -> DataFrame:
    """One row per source: sid (position), size, weight, target, need (slots), cumulative slots lo and hi.

    The target is min(level * weight, cap * size) at the one level where targets add up to all sizes,
    which is where resharing the excess by weight ends.  One row per source is small beside the documents.
    """
    size = sized.groupBy("source").agg(F.sum("size").alias("size"))
    place = Window.orderBy(F.col("source").isNull(), F.col("source").cast("string"))
    s = size.withColumn("sid", F.row_number().over(place).cast("long") - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    s = s.withColumn("limit", F.col("size") * float(cap))
    # Sources by the level at which they reach their limit: those before are full, the rest share what is left.
    full = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    s = s.withColumn("level", (F.sum("size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
    fits = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct(F.col("limit") / F.col("weight"), "sid", "level"))
    s = s.withColumn("level", F.min(fits).over(Window.partitionBy())["level"])
    s = s.withColumn("target", F.least(F.coalesce("level", F.lit(0.0)) * F.col("weight"), F.col("limit")))
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    goal = F.floor(F.col("target") + 1e-6).cast("long")
    passes = F.when(F.col("size") > 0, F.expr(f"cast(floor(target + 1e-6) as bigint) div greatest(size, 1)")).otherwise(0)
    s = s.withColumn("blocks", blocks).withColumn("goal", goal).withColumn("passes", passes)
    s = s.withColumn("rest", F.col("goal") - F.col("passes") * F.col("size"))
    s = s.withColumn("need", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / BLOCK).cast("long"))
    s = s.withColumn("hi", F.sum("need").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("need"))
    return s.select("source", "sid", "size", "weight", "target", "lo", "hi", "blocks", "passes", "rest", "need")


def _slots(spark: SparkSession, sources: DataFrame, n_slots: int, n_sources: int) -> DataFrame:
    """slot, sid, rank: every slot of the mix with its source and its rank among that source's slots."""
    low, ranges = F.lit((1 << 31) - 1).cast("long"), max(1, n_slots // RANK_ROWS)
    points = spark.range(n_slots).select(F.col("id").alias("slot"), (F.col("id").bitwiseAND(low) * PHI31).bitwiseAND(low).alias("point"))
    points = points.withColumn("range", F.shiftright(F.col("point") * F.lit(ranges).cast("long"), 31))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = points.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("point", "slot")) - 1
    placed = points.withColumn("inside", inside).join(bases, "range").select("slot", (F.col("base") + F.col("inside")).alias("place"))
    # An interval join as an equi-join: places and intervals meet in bins, of which there are as many as sources.
    width = max(1, n_slots // (4 * n_sources))
    spans = sources.where("hi > lo").select("sid", "lo", "hi", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("bin"))
    dealt = placed.withColumn("bin", F.expr(f"place div {width}")).join(spans, "bin").where("lo <= place and place < hi").select("slot", "sid", F.shiftright("slot", CHUNK_BITS).alias("chunk"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = dealt.groupBy("sid", "chunk").agg(F.count("*").alias("n")).select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    return dealt.withColumn("inside", inside).join(chunks, ["sid", "chunk"]).select("slot", "sid", (F.col("base") + F.col("inside")).alias("rank"))


def mix(docs: DataFrame, weights=WEIGHTS, cap=CAP, seed: int = 1, row: Column | None = None) -> Mix:
    """The mix of ``docs`` (doc_id, text, source): see the module's head.

    ``row`` names a row in the result where doc_id can't; by default it is only unique.
    """
    spark = docs.sparkSession
    row = F.monotonically_increasing_id() if row is None else row
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), hash38(F.lit(seed), "doc_id", "text").alias("h"), row.alias("row"))
    sized = staged(sized, "mix-sized")
    sources = staged(targets(sized, weights, cap), "mix-sources")
    n_docs, n_sources = sized.agg(F.count("*"), F.count_distinct("source")).first()
    n_slots = sources.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    small = F.broadcast(sources) if n_sources <= 100_000 else sources
    d = sized.alias("d").join(small.alias("s"), F.expr("d.source <=> s.source")).select("d.doc_id", "d.size", "d.h", "d.row", "s.sid", bucket_of(F.col("d.h"), n_docs).alias("bucket"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = d.groupBy("sid", "bucket").agg(F.sum("size").alias("n")).select("sid", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    shuffled = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    d = d.where("size > 0").withColumn("inside", F.coalesce(F.sum("size").over(shuffled), F.lit(0))).join(bases, ["sid", "bucket"])
    d = d.select("doc_id", "sid", "size", "row", (F.col("base") + F.col("inside")).alias("at"))
    pieces = d.withColumn("block", F.explode(F.expr(f"sequence(at div {BLOCK}, (at + size - 1) div {BLOCK})")))
    pieces = pieces.select("*", F.greatest("at", F.col("block") * BLOCK).alias("from"), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * BLOCK).alias("to"))

    ranked = staged(_slots(spark, sources, n_slots, n_sources + 1), "mix-slots")
    slots = ranked.join(small.select("sid", "source", "size", "blocks", "passes", "rest"), "sid")
    slots = slots.select("slot", "sid", "source", "rank", F.expr("rank div blocks").alias("pass"), F.expr("rank % blocks").alias("block"), F.expr("if(rank div blocks < passes, size, rest)").alias("upto"))
    schedule = slots.join(pieces.drop("source"), ["sid", "block"]).where("from < upto")
    schedule = schedule.select("slot", "sid", "source", "rank", "pass", "block", "doc_id", "size", "at", (F.col("from") - F.col("at")).alias("from_word"), (F.least("to", "upto") - F.col("at")).alias("to_word"))
    taken = schedule.groupBy("sid", "at").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
    out = d.join(taken, ["sid", "at"], "left").select("doc_id", "size", "sid", "row", "taken", "first_slot", "n_slots")
    empty = sized.alias("d").where("size = 0").join(small.alias("s"), F.expr("d.source <=> s.source")).select("d.doc_id", "d.size", "s.sid", "d.row", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"), F.lit(0).cast("long").alias("n_slots"))
    out = out.unionByName(empty).join(small.select("sid", "source", F.col("size").alias("source_size"), "target"), "sid")
    out = out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), "row")
    return Mix(out, schedule.drop("sid", "at", "size"), sources.select("source", "size", "weight", "target"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot, n_slots of every row of documents.

    first_slot and n_slots are the slots of the schedule that hold words of the document, repeats counted.
    """
    return mix(table(spark, sf_dir, "documents")).documents.drop("source", "row")
