"""Dense row numbers without sorting a whole mesh in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys in one numbered range.
RANGE_BITS = 14


def numbered(rows: DataFrame, name: str, key: Column, *ties: Column, by: str = "mesh_id") -> DataFrame:
    """``rows`` with a dense number from 0 per ``by``, in the order of an integer key and ``ties``.

    Rows are numbered within ranges of 2**RANGE_BITS keys; the ranges' counts, a far smaller table, give the bases.
    """
    rows = rows.withColumn("__key", key.cast("long")).withColumn("__range", F.shiftright("__key", RANGE_BITS))
    before = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(by, "__range").agg(F.count("*").alias("__n")).select(by, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy(by, "__range").orderBy("__key", *ties)) - 1
    return rows.withColumn("__inside", inside).join(bases, [by, "__range"]).withColumn(name, (F.col("__base") + F.col("__inside")).cast("long")).drop("__key", "__range", "__inside", "__base")
