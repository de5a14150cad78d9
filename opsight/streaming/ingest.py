"""The ingestion stream: drain what is available, log each micro-batch, stop."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from opsight.sources.batch_log import BatchLog


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id the checkpoint was created with: a new checkpoint restarts batch numbers."""
    row = spark.read.text(f"{checkpoint}/metadata").first()
    return json.loads(row[0])["id"]


def ingest(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    log: BatchLog,
    checkpoint: str,
    max_files_per_trigger: int | None = None,
) -> None:
    """Copy new files of ``source`` into ``log``; safe to run again at any time."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def keep(batch: DataFrame, batch_id: int) -> None:
        log.put(batch, stream_id(spark, checkpoint), batch_id)

    (
        reader.parquet(source)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
        .awaitTermination()
    )
