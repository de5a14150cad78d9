"""Facts and rollups stored by calendar day, so that a window or a refresh touches only its days."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsight.windows import Lookback

DAY = "day"


@dataclass
class DayTable:
    """Parquet below ``path`` with one folder per ``day`` of the time column ``ts``.

    Rows without a time are in the null day's folder, which no window reads.
    """

    spark: SparkSession
    path: str
    ts: str

    def _dated(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(DAY, F.to_date(self.ts))

    def append(self, rows: DataFrame) -> None:
        """Add rows. A day is written by as many tasks as hold rows of it: no day meets in one task."""
        self._dated(rows).write.mode("append").partitionBy(DAY).parquet(self.path)

    def replace_days(self, rows: DataFrame) -> None:
        """Replace the days that ``rows`` has; the folders of other days are left as they are."""
        writer = self._dated(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(DAY).parquet(self.path)

    def read(self, schema: T.StructType | None = None) -> DataFrame:
        if schema is None:
            return self.spark.read.parquet(self.path)
        return self.spark.read.schema(T.StructType([*schema.fields, T.StructField(DAY, T.DateType())])).parquet(self.path)

    def within(self, window: Lookback, schema: T.StructType | None = None) -> DataFrame:
        """Rows of the days that a look-back window touches; the caller still cuts to the instant."""
        return self.read(schema).filter(in_days(window)).drop(DAY)

    def of_days(self, days: Iterable[date], schema: T.StructType | None = None) -> DataFrame:
        """Rows of the given days: the scan opens no other folder."""
        return self.read(schema).filter(F.col(DAY).isin(list(days))).drop(DAY)


def in_days(window: Lookback) -> Column:
    return F.col(DAY).between(F.lit(min(window.start, window.midnight).date()), F.lit(window.as_of.date()))


def days_of(rows: DataFrame, ts: str) -> list[date]:
    """The days that rows fall on: at most as many values as the calendar has days."""
    days = rows.select(F.to_date(ts).alias(DAY)).filter(F.col(DAY).isNotNull()).distinct().collect()
    return sorted(r[0] for r in days)
