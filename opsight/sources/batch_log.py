"""A stream's micro-batches as plain parquet, and the current rows of a key over them.

Every batch is written to ``stream=<id>/batch=<n>`` and replaces what an earlier attempt at
the same batch left there, so a repeated batch changes nothing and nothing has to be
remembered about it. The current table is the newest row of each key over all batches, an
aggregation with map-side combine. From time to time the batches that are closed are folded
into one with a row per key, ``fold=<n>``: a read takes the newest whole fold and what came
after it, so it does not grow with history. Tables whose format has row-level MERGE take the
batch through :func:`merge_newest` instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsight.functions.relational import latest_by
from opsight.operators.ingest import latest_in_batch


@dataclass
class BatchLog:
    spark: SparkSession
    path: str
    schema: T.StructType
    key: str
    ts: str
    tie: Sequence[str] = ()

    def put(self, batch: DataFrame, stream: str, batch_id: int) -> None:
        """Write a batch, one row per key; writing it again gives the same files' content."""
        newest = latest_in_batch(batch.select(*self.schema.fieldNames()), self.key, self.ts, self.tie)
        newest.write.mode("overwrite").parquet(f"{self.path}/stream={stream}/batch={batch_id}")

    def _folders(self, path: str) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in system.listStatus(folder) if f.isDirectory()] if system.exists(folder) else []

    def _whole(self, path: str) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def _parts(self) -> tuple[str | None, dict[str, list[int]]]:
        """The newest whole fold, and the batches of every stream that it does not hold."""
        folders = self._folders(self.path)
        folds = sorted((int(f.partition("=")[2]) for f in folders if f.startswith("fold=")), reverse=True)
        fold = next((f"{self.path}/fold={n}" for n in folds if self._whole(f"{self.path}/fold={n}")), None)
        held = {}
        if fold:
            held = {r["stream"]: r["batch"] for r in self.spark.read.parquet(f"{fold}/held=true").collect()}
        later = {}
        for stream in (f.partition("=")[2] for f in folders if f.startswith("stream=")):
            numbers = sorted(int(f.partition("=")[2]) for f in self._folders(f"{self.path}/stream={stream}") if f.startswith("batch="))
            later[stream] = [n for n in numbers if n > held.get(stream, -1)]
        return fold, later

    @property
    def _placed(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())])

    def _read(self, fold: str | None, batches: dict[str, list[int]]) -> DataFrame:
        paths = [f"{self.path}/stream={s}/batch={n}" for s, numbers in batches.items() for n in numbers]
        reader = self.spark.read.schema(self._placed)
        rows = self.spark.createDataFrame([], self._placed)
        if paths:
            rows = reader.option("basePath", self.path).parquet(*paths)
        if fold:
            old = self.spark.read.schema(self._placed).parquet(f"{fold}/held=false")
            rows = old.unionByName(rows) if paths else old
        return rows

    def rows(self) -> DataFrame:
        """The newest fold's rows and those written since, with their ``stream`` and ``batch``."""
        return self._read(*self._parts())

    def _newest(self, rows: DataFrame) -> DataFrame:
        arrival = F.when(F.col(self.ts).isNull(), F.col("batch")).otherwise(-F.col("batch"))
        return latest_by(rows.withColumn("_arrival", arrival), [self.key], [self.ts, "_arrival", "stream", *self.tie])

    def read(self) -> DataFrame:
        """The current row of each key: the newest time, nulls last.

        Of equal times the earlier batch counts, of rows without a time the later one, as in
        an upsert that takes only strictly newer rows or fills in missing times.
        """
        return self._newest(self.rows()).select(*self.schema.fieldNames())

    def fold(self, keep_open: int = 1) -> str | None:
        """Fold all batches but the last ``keep_open`` of each stream, which may still be repeated.

        Rows keep the stream and batch they came in, so ties are settled as before. A fold counts once it
        is whole; one that broke off is passed over, and folding again gives the same rows. A batch
        that is written again after its fold changes nothing, as the newest row wins. The folded batches
        stay where they are; whoever owns the storage may remove them by age.
        """
        fold, later = self._parts()
        closed = {s: n[:-keep_open] if keep_open else n for s, n in later.items()}
        if not any(closed.values()):
            return fold
        number = max([0, *[int(f.partition("=")[2]) for f in self._folders(self.path) if f.startswith("fold=")]]) + 1
        held = {s: n[-1] for s, n in closed.items() if n}
        if fold:
            held = {r["stream"]: r["batch"] for r in self.spark.read.parquet(f"{fold}/held=true").collect()} | held
        path = f"{self.path}/fold={number}"
        newest = self._newest(self._read(fold, closed)).select(*self._placed.fieldNames())
        marks = self.spark.createDataFrame(list(held.items()), "stream string, batch long")
        newest.write.parquet(f"{path}/held=false")
        marks.coalesce(1).write.parquet(f"{path}/held=true")
        self.spark.range(0).write.mode("append").parquet(path)  # its success mark makes the fold whole
        return path


def merge_newest(batch: DataFrame, table: str, key: str, ts: str, tie: Sequence[str] = ()) -> None:
    """The same for a catalog table that supports row-level MERGE."""
    newest = latest_in_batch(batch, key, ts, tie).alias("s")
    newer = (F.col(f"s.{ts}") > F.col(f"{table}.{ts}")) | F.col(f"{table}.{ts}").isNull()
    same = F.col(f"s.{key}") == F.col(f"{table}.{key}")
    newest.mergeInto(table, same).whenMatched(newer).updateAll().whenNotMatched().insertAll().merge()
