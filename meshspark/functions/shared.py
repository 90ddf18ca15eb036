"""Intermediate tables in the folder that the driver and all executors share.

``staged`` writes a DataFrame as Parquet and reads it back: this cuts the lineage, survives the loss of
any executor, and gives later steps exact sizes and column pruning.  The folder is the one the session
names in ``spark.checkpoint.dir``; only where that is unset (tests, a laptop) is a temporary one made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="meshspark-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def staged(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read again; column names and types stay."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meshspark-{label}-{uuid.uuid4().hex}"
    names = df.columns
    df.toDF(*[f"c{i}" for i in range(len(names))]).write.parquet(path)
    back = spark.read.parquet(path).toDF(*names)
    back._meshspark_path = path
    return back


def dropped(df: DataFrame) -> None:
    """Remove the files behind a ``staged`` table that no later step reads."""
    path = getattr(df, "_meshspark_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
