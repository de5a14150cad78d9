"""Newest-wins upserts: any order, repetition or replay of batches gives the same table."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import types as T

from opsight.operators import ingest as i
from opsight.scratch import scratch_path
from opsight.sources.batch_log import BatchLog
from opsight.sources.sinks import append_snapshot, copy_table, overwrite
from opsight.streaming.ingest import ingest

T0 = datetime(2024, 1, 1)
SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("v", T.StringType())]
)


def row(key, minute, value):
    return key, None if minute is None else T0 + timedelta(minutes=minute), value


def test_in_batch_duplicates_keep_the_newest(spark, rows):
    df = spark.createDataFrame([row(1, 1, "a"), row(1, 3, "b"), row(1, None, "c"), row(2, None, "d")], SCHEMA)
    assert rows(i.latest_in_batch(df, "id", "ts"), "id", "v") == [(1, "b"), (2, "d")]


@pytest.mark.parametrize(
    "old, new, kept",
    [(1, 2, "new"), (2, 1, "old"), (1, 1, "old"), (None, 1, "new"), (None, None, "new"), (1, None, "old")],
)
def test_update_condition(spark, rows, old, new, kept):
    target = spark.createDataFrame([row(1, old, "old")], SCHEMA)
    batch = spark.createDataFrame([row(1, new, "new"), row(2, 5, "x")], SCHEMA)
    assert rows(i.upsert(target, batch, "id", "ts"), "id", "v") == [(1, kept), (2, "x")]


def test_log_ignores_order_and_replay(spark, rows):
    rnd = random.Random(5)
    data = [row(k, m, f"{k}-{m}") for k in range(12) for m in rnd.sample(range(60), 3)]
    newest = {}
    for k, ts, v in data:
        newest[k] = max(newest.get(k, (ts, v)), (ts, v))
    want = sorted(((k, v) for k, (_, v) in newest.items()), key=repr)
    for seed in (1, 2):
        random.Random(seed).shuffle(data)
        log = BatchLog(spark, scratch_path(spark, "log"), SCHEMA, "id", "ts")
        assert log.read().count() == 0
        for n in range(3):
            batch = spark.createDataFrame(data[n * 12 : n * 12 + 12] + data[:2], SCHEMA)
            log.put(batch, "s", n)
            log.put(batch, "s", n)  # repeated after a failure
        assert rows(log.read(), "id", "v") == want
        log.put(spark.createDataFrame(data[:5], SCHEMA), "other-stream", 0)
        assert rows(log.read(), "id", "v") == want


def test_log_keeps_the_first_of_equal_times_and_the_last_without(spark, rows):
    log = BatchLog(spark, scratch_path(spark, "log"), SCHEMA, "id", "ts")
    log.put(spark.createDataFrame([row(1, 5, "first"), row(2, None, "undated"), row(3, None, "x")], SCHEMA), "s", 9)
    log.put(spark.createDataFrame([row(1, 5, "second"), row(2, None, "later"), row(3, 1, "dated")], SCHEMA), "s", 10)
    log.put(spark.createDataFrame([row(3, None, "undated again"), row(1, 4, "late")], SCHEMA), "s", 11)
    assert rows(log.read(), "id", "v") == [(1, "first"), (2, "later"), (3, "dated")]


def test_stream_restarts_from_its_checkpoint(spark, rows):
    source, path, checkpoint = (scratch_path(spark, n) for n in ("src", "sink", "check"))
    sink = BatchLog(spark, path, SCHEMA, "id", "ts")
    for batch in ([row(1, 5, "a"), row(2, 1, "b")], [row(1, 4, "late"), row(2, 3, "c")], [row(1, 5, "again"), row(3, 0, "d")]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        ingest(spark, source, SCHEMA, sink, checkpoint, max_files_per_trigger=1)
    ingest(spark, source, SCHEMA, sink, checkpoint)
    assert rows(sink.read(), "id", "v") == [(1, "a"), (2, "c"), (3, "d")]
    # a new checkpoint reads everything again and changes nothing
    ingest(spark, source, SCHEMA, sink, scratch_path(spark, "check2"), max_files_per_trigger=1)
    assert rows(sink.read(), "id", "v") == [(1, "a"), (2, "c"), (3, "d")]


def test_plain_sinks(spark, rows):
    path = scratch_path(spark, "result")
    df = spark.createDataFrame([row(1, 1, "a")], SCHEMA)
    overwrite(df, path)
    overwrite(df.drop("v"), path)
    assert spark.read.parquet(path).columns == ["id", "ts"]
    history = scratch_path(spark, "history")
    for day in (1, 2):
        append_snapshot(df, history, T0 + timedelta(days=day))
    assert spark.read.parquet(history).select("analysis_timestamp").distinct().count() == 2
    copied = scratch_path(spark, "copy")
    assert copy_table(df, copied, ["id"]) and not copy_table(df, copied, ["id"])
    assert copy_table(df, copied, ["id"], refresh=True) and spark.read.parquet(copied).count() == 1
