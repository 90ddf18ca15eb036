"""A corpus pipeline: quality, near duplicates, benchmark contamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, with
extra ones that the input has.  Results are defined for every stage: an empty table gives an empty table, null and empty
texts, null ids and repeated rows are taken as the stage's docstring says, long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshspark.llm import op1_mixing, op2_quality, op3_jaccard, op5_sharding, op8_decontamination
from meshspark.llm.common import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects (score below 0.7).

    Null and empty texts have the score of a text of no bytes; repeated rows are judged alike.  Labels are learned from
    rows of ``docs`` that are not held out; with labels of one kind only, all rows get that kind's smoothed share.
    """
    return op2_quality.keep(docs, op2_quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones (five-word shingles, similarity 0.8), that of the smallest id.

    Texts without words are similar to none; of repeated rows of one id one stays; rows without an id all stay.
    """
    return op3_jaccard.unique(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark text: at least a twentieth of their words lies in its windows.

    Texts without words stay; repeated rows are judged alike; with no benchmark all rows stay.
    """
    return op8_decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to whole times: up to three, or not at all.

    Every row is mixed on its own, repeated rows too, under a number that is written beside it.  In a source whose target
    is under its size the documents beyond the target go; of each source at most one document is taken in part, and that
    part is rounded, so a source's words differ from its target by at most half a document.  Texts without words have
    no share in a mix of words and go; a null source is a source.
    """
    rows = staged(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline-rows")
    taken = op1_mixing.mix(rows, row=F.col("__row")).documents
    times = taken.select(F.col("row").alias("__row"), F.round(F.try_divide("taken", "size")).cast("int").alias("__times")).where("__times > 0")
    both = rows.join(times, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times")))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns])


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row: doc_id, size, text_crc32, shard, slot.

    Rows of equal texts go to one shard; a null text has size 1.
    """
    return op5_sharding.shard(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The classifier is learned, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{name}")
    return docs
