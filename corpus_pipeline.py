"""A corpus pipeline: quality classifier, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read again as the next
one's docs.  All but the last return the columns of ``documents``.

What holds for all stages: equal rows share a verdict, so a tie never drops one of them by chance; rows that repeat a doc_id
with other texts are judged each, but for near-dedup, which keeps them if one of them is kept; columns of ``documents`` beyond those that a stage needs pass through, also those
named like an operator's own; an empty table gives an empty one; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import drop_work_table, release, table, work_table
from cohortlake.llm.decontaminate import decontaminate
from cohortlake.llm.language_model import keep_good
from cohortlake.llm.minhash import near_duplicates
from cohortlake.llm.mixing import mix_documents
from cohortlake.llm.sharding import shard_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity classifier keeps; those without words, null texts too, go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, similarity 0.8) the rows with the smallest doc_id; null and empty texts are no copies of one another."""
    kept = near_duplicates(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("_cl_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_cl_id")), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; null and empty texts contain none."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, in its order; a repeated pass repeats its rows; a null source is a source, the last one."""
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with shard and slot; equal texts stay together, a null text counts one byte."""
    return shard_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("sharding", sharding),
]

ORACLE_SQL = None  # model scoring, component search and sampling can't be expressed in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = work_table(stage(spark, before, sf_dir), "stage")
        if before is not docs:
            drop_work_table(before)  # only work tables are removed
        release(spark)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
