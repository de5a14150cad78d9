"""Exact deduplication by skew-safe combining.

Texts are equal when they are identical after lower-casing A-Z. Three combining steps,
each of which groups by the whole text beside its digest, so that content and not a
digest decides:

1. every map task combines its own rows (partial aggregation);
2. rows of a text meet per salt, the salt being the task they came from, so the copies
   of a hot text are spread over ``salts`` groups of one row per task each;
3. the salts' winners of a text are combined, at most ``salts`` rows.

What then goes back to the single documents is one narrow row per text that has copies.
The join back is a plain shuffle join, whose hot partitions Spark splits at run time; it
pairs by SHA-256, a second 64-bit hash and the length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.llm.common import ascii_lower, text_of

_IDENTITY = ["_sha", "_hash", "_length"]


def _fingerprinted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs.select(F.col(id_col).alias("_id"), ascii_lower(text_of(text_col)).alias("_norm"))
    return text.select(
        "_id",
        "_norm",
        F.sha2("_norm", 256).alias("_sha"),
        F.xxhash64("_norm").alias("_hash"),
        F.length("_norm").alias("_length"),
    )


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per different text: its identity, ``keep_id`` (largest id) and ``group_size``."""
    rows = _fingerprinted(docs, id_col, text_col).withColumn("_salt", F.spark_partition_id() % salts)
    content = [*_IDENTITY, "_norm"]
    salted = rows.groupBy(*content, "_salt").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    return (
        salted.groupBy(*content)
        .agg(F.max("_keep").alias("keep_id"), F.sum("_n").alias("group_size"))
        .drop("_norm")
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Null text is empty text, so empty and null rows form one group. The largest id of a
    group stays; null ids rank below every id, and a group of null ids only has a null
    ``keep_id`` and keeps all its rows. Rows that repeat an id and its text are one
    document and get the same verdict (``deduplicate`` returns one of them). Other
    columns, whatever their names, are not read. An empty table gives an empty result.
    """
    groups = text_groups(docs, id_col, text_col, salts).filter("group_size > 1")
    rows = _fingerprinted(docs, id_col, text_col).drop("_norm").withColumnRenamed("_id", id_col)
    found = rows.join(groups, _IDENTITY, "left")
    keep = F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id"))
    return found.select(
        id_col,
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col(id_col).eqNullSafe(keep).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; each id once per text.

    A row without an id stays only if no row with an id has its text, and once.
    """
    verdicts = exact_duplicates(docs, id_col, text_col, salts).filter("kept")
    stay = verdicts.groupBy(F.col(id_col).alias("_stay"), F.col("text_sha256").alias("_stay_sha"))
    stay = stay.agg(F.count(F.lit(1)).alias("_rows"))
    sha = F.sha2(ascii_lower(text_of(text_col)), 256)
    rows = docs.withColumn("_sha_of_row", sha)
    kept = rows.join(
        stay, F.col(id_col).eqNullSafe(F.col("_stay")) & (F.col("_sha_of_row") == F.col("_stay_sha"))
    )
    alone = kept.filter("_rows = 1").select(docs.columns)
    again = kept.filter("_rows > 1").dropDuplicates(["_stay", "_sha_of_row"]).select(docs.columns)
    return alone.unionAll(again)
