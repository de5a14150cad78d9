"""Plain result sinks: overwrite, append with an analysis time, partitioned copy."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from opsight.windows import ts_lit


def overwrite(df: DataFrame, path: str) -> None:
    """Replace a result; the schema may differ from the previous one."""
    df.write.mode("overwrite").parquet(path)


def append_snapshot(df: DataFrame, path: str, as_of: datetime, column: str = "analysis_timestamp") -> None:
    """Append a result stamped with its analysis time, so that analyses form a history."""
    df.withColumn(column, ts_lit(as_of)).write.mode("append").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def copy_table(df: DataFrame, path: str, partitions: Sequence[str] = (), refresh: bool = False) -> bool:
    """Copy with the partitioning kept. An existing target is skipped unless ``refresh``."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    if exists and not refresh:
        return False
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return True


def store_counted(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Write a result and count its rows in the same pass; gives the stored rows and their number."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get.get("rows", 0)
