"""Lossless incremental copy of a source that corrects and re-emits its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsight.functions.relational import latest_by


def latest_in_batch(batch: DataFrame, key: str, ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """One row per key: the newest, rows without a time last."""
    return latest_by(batch, [key], [ts, *tie])


def newest_wins(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: Sequence[str] = (),
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Target with the batch folded in, in one shuffle and without a join.

    A batch row replaces the target row if it is strictly newer or the target row has
    no time; other keys are inserted. Repeats and late rows therefore change nothing.
    """
    both = target.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    if spread_by:
        both = both.repartition(*spread_by)
    side = F.when(F.col(ts).isNull(), -F.col("_new")).otherwise(F.col("_new"))
    order = [F.col(ts).desc_nulls_last(), side, *[F.col(c).desc_nulls_last() for c in tie]]
    w = Window.partitionBy(*keys).orderBy(*order)
    return both.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank", "_new")


def upsert(target: DataFrame, batch: DataFrame, key: str, ts: str, tie: Sequence[str] = ()) -> DataFrame:
    return newest_wins(target, batch, [key], ts, tie)


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row counts of two sinks side by side."""
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return left.sparkSession.range(1).select(count(left).alias("rows_left"), count(right).alias("rows_right"))
