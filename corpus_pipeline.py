"""From raw documents to packed training sequences, in five stages.

Every stage takes the documents its predecessor kept, written as Parquet and read again,
and decides on all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.llm import exact_dedup, mixing, near_dup, packing, quality
from opsight.llm.common import key_of, table
from opsight.scratch import scratch_path


def _row() -> Column:
    """What a verdict depends on, and the id, which deals copies of a text to different keys."""
    return F.struct(key_of("doc_id").alias("id"), key_of("lang").alias("lang"), F.sha2(key_of("text"), 256).alias("text"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    The verdict of a row is joined back by id, language and text, nulls included: rows that
    share an id, or have none, are judged each by its own text.
    """
    rows = docs.withColumn("_row", _row())
    stay = quality.quality_rules(rows, id_col="_row").filter("kept").select("_row").distinct()
    return rows.join(stay, "_row", "left_semi").select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_dup.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, in as many copies as it takes them."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
