"""Table-update events folded into durable state, with dueness decided per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsight.operators.router import decisions, evaluate_due, parse_updates
from opsight.sources.batch_log import BatchLog
from opsight.streaming.ingest import stream_id

EVENTS = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("observed_ts", T.TimestampNTZType()),
        T.StructField("updated_tables", T.StringType()),
    ]
)
STATE = T.StructType(
    [
        T.StructField("source_table", T.StringType()),
        T.StructField("last_updated_ts", T.TimestampNTZType()),
        T.StructField("last_run_id", T.StringType()),
    ]
)


def state_log(spark: SparkSession, path: str) -> BatchLog:
    return BatchLog(spark, path, STATE, "source_table", "last_updated_ts", tie=["last_run_id"])


def fold_updates(events: DataFrame) -> DataFrame:
    """The newest observation per table of a batch of update events."""
    parsed = parse_updates(events)
    seen = F.struct(F.col("observed_ts"), F.col("run_id").cast("string").alias("run_id"))
    return (
        parsed.groupBy("source_table")
        .agg(F.max(seen).alias("_m"))
        .select("source_table", F.col("_m.observed_ts").alias("last_updated_ts"), F.col("_m.run_id").alias("last_run_id"))
    )


def route_stream(
    spark: SparkSession,
    source: str,
    state: BatchLog,
    config: DataFrame,
    dependencies: DataFrame,
    report_state: DataFrame,
    checkpoint: str,
    out: str,
    processing_time: str | None = None,
) -> None:
    """Drain the event files; each micro-batch settles a burst, then decides for every report.

    Decisions of a batch go to ``out/batch=<id>`` and are replaced if the batch is repeated.
    With ``processing_time`` the query keeps running and batches at least that far apart.
    """

    def route(batch: DataFrame, batch_id: int) -> None:
        newest = batch.agg(F.max("observed_ts")).first()[0]
        if newest is None:
            return
        state.put(fold_updates(batch), stream_id(spark, checkpoint), batch_id)
        due = evaluate_due(config, dependencies, state.read(), report_state)
        decided = decisions(due, newest).join(due.select("report_id", "reason"), "report_id")
        decided.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = (
        spark.readStream.schema(EVENTS)
        .parquet(source)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(route)
    )
    trigger = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    writer.trigger(**trigger).start().awaitTermination()
