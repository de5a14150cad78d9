"""Reading tables: parquet by name and the logical tables over them."""

from __future__ import annotations

import re
from datetime import datetime
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsight.sources.logical import LOGICAL

_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")
_SCHEMAS: dict[str, T.StructType] = {}


@lru_cache(maxsize=None)
def used_tables(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(_NAME.findall(text)))


class Tables:
    """The parquet tables of one folder; each is opened and each schema inferred once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._open: dict[str, DataFrame] = {}
        self._newest: datetime | None = None

    def given(self, name: str) -> DataFrame:
        if name not in self._open:
            path = f"{self.folder}/{name}.parquet"
            if path not in _SCHEMAS:
                _SCHEMAS[path] = self.spark.read.parquet(path).schema
            self._open[name] = self.spark.read.schema(_SCHEMAS[path]).parquet(path)
        return self._open[name]

    def logical(self, name: str) -> DataFrame:
        if name not in self._open:
            text = LOGICAL[name]
            self._open[name] = self.spark.sql(text, **{t: self.given(t) for t in used_tables(text)})
        return self._open[name]

    def as_of(self) -> datetime:
        """The newest event time: one row, one column read."""
        if self._newest is None:
            self._newest = self.given("events").agg(F.max("ts").alias("ts")).first()["ts"]
        return self._newest
