"""What the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshspark.functions.shared import dropped, shared_dir, staged  # noqa: F401

#: A word is a run of characters other than ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda variable that no optimizer rule inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _dealt(*own: str) -> Column:
    return F.when(F.col("state") == 2, F.pmod(F.xxhash64(*own), F.lit(1 << 16)) + 1).otherwise(F.lit(0))


def meeting(key: str, *own: str):
    """The window in which rows of a key meet; those that words.local_state found AGAIN are dealt over many others."""
    return Window.partitionBy(key, _dealt(*own))


def met(rows: DataFrame, key: str, value: str, *own: str) -> DataFrame:
    """``rows`` with the least and the greatest ``value`` that meet (see ``meeting``) as lo and hi.

    The dealt number is a column, which both windows share: as an expression it would be another one for each, and all
    rows would be exchanged and sorted twice.
    """
    one, rows = Window.partitionBy(key, "__dealt"), rows.withColumn("__dealt", _dealt(*own))
    return rows.select("*", F.min(value).over(one).alias("lo"), F.max(value).over(one).alias("hi")).drop("__dealt")


def hash38(*cols: Column) -> Column:
    """A 38-bit non-negative hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 26)


#: Rows that one window partition holds on average where rows are numbered in two levels.
RANK_ROWS = 4096


def bucket_of(h: Column, rows: int) -> Column:
    """Deals 38-bit hashes into equal ranges of about RANK_ROWS rows, in hash order."""
    n = max(1, -(-rows // RANK_ROWS))
    return F.shiftright(h * F.lit(n).cast("long"), 38)
