"""Connected components of an edge table by repeated contraction.

Each round draws a new order of the nodes by a hash.  A node moves to the first of itself and its neighbours, then
once more to where that one moved, and the edges are replaced by their images.  A node stays only if it is first
among its neighbours or the goal of one of them, so the number of nodes falls by a constant factor in expectation,
whatever the shape of the graph: rounds grow with the logarithm of the nodes, not with the diameter.  Once at most
FEW edges are left, one task ends the work.  The rounds' maps are composed from the smallest up, and the least node
of each component names it.  A round is one partially aggregated group-by and equi-joins on tables that shrink;
nothing goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from meshspark.functions.shared import dropped, staged

#: Edges (some 16 bytes each) that one task holds at most.
FEW = 100_000


def _drawn(node: str, turn: int) -> Column:
    """A node behind its place in the order of a round."""
    return F.struct(F.xxhash64(F.lit(turn), node).alias("place"), F.col(node).alias("node"))


def contracted(e: DataFrame, turn: int) -> DataFrame:
    """(node, parent): where every node of the edges ``e`` (a, b; a <> b) moves in a round."""
    both = e.select("a", "b").union(e.select("b", "a"))
    step = both.groupBy("a").agg(F.min(_drawn("b", turn)).alias("first")).select(F.col("a").alias("node"), F.least("first", _drawn("a", turn))["node"].alias("parent"))
    up = step.select(F.col("node").alias("parent"), F.col("parent").alias("goal"))
    return step.join(up, "parent").select("node", F.col("goal").alias("parent"))


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, parent) of the edges of all batches: every node with one node of its component."""
    batches = list(batches)
    if not batches:
        return
    ends = pa.chunked_array([b.column(i) for i in (0, 1) for b in batches]).combine_chunks()
    first: dict = {}
    keys = [tuple(x.values()) if isinstance(x, dict) else x for x in ends.to_pylist()]
    at = [first.setdefault(k, i) for i, k in enumerate(keys)]
    root = list(range(len(at)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    half = len(at) // 2
    for i, j in zip(at[:half], at[half:], strict=True):
        root[top(i)] = top(j)
    own = list(first.values())
    yield pa.RecordBatch.from_arrays([ends.take(pa.array(own)), ends.take(pa.array([top(i) for i in own]))], ["node", "parent"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of ``edges`` and the smallest node it is connected to."""
    whole = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = staged(whole.select(F.least(F.col(a), F.col(b)).alias("a"), F.greatest(F.col(a), F.col(b)).alias("b")).distinct(), "cc-edges")
    e, levels, turn = pairs.where("a <> b"), [], 0
    while left := e.count():
        if left <= FEW:
            kind = e.schema["a"].dataType
            level = e.coalesce(1).mapInArrow(_ended, StructType([StructField("node", kind), StructField("parent", kind)]))
            levels.append(staged(level, "cc-level"))
            break
        level = staged(contracted(e, turn), "cc-level")
        levels.append(level)
        pa, pb = (level.select(F.col("node").alias(x), F.col("parent").alias(f"p{x}")) for x in "ab")
        moved = e.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        old, e, turn = e, staged(moved, "cc-edges"), turn + 1
        dropped(old)
    if not levels:
        return pairs.select(F.col("a").alias("node"), F.col("a").alias("component"))
    roots = levels[-1]
    for level in reversed(levels[:-1]):
        up = roots.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        roots = level.join(up, "parent", "left").select("node", F.coalesce("root", "parent").alias("parent"))
    least = roots.groupBy("parent").agg(F.min("node").alias("component"))
    named = roots.join(least, "parent").select("node", "component")
    alone = pairs.where("a = b").select(F.col("a").alias("node")).join(named.select("node"), "node", "left_anti")
    labels = staged(named.unionByName(alone.select("node", F.col("node").alias("component"))), "cc-labels")
    for old in (pairs, e, *levels):
        dropped(old)
    return labels
