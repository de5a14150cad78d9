"""Rollups refreshed by day, day tables and folded batch logs."""

from datetime import date, datetime
from pathlib import Path

from opsight.operators import rollups
from opsight.operators.rollups import CostRollups
from opsight.sources.batch_log import BatchLog
from opsight.sources.day_tables import DayTable, days_of
from opsight.windows import Lookback

HISTORY = "statement_id long, warehouse_id string, space_id string, executed_by string, total_duration_ms long, start_time timestamp_ntz"
USAGE = "warehouse_id string, usage_quantity double, usage_start_time timestamp_ntz"


def at(day, hour=1, minute=0):
    return datetime(2024, 1, day, hour, minute)


def history(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], HISTORY)


def stored(spark, tmp_path):
    tables = {n: str(tmp_path / n) for n in ("history", "usage", "wh", "user")}
    return CostRollups(
        DayTable(spark, tables["history"], "start_time"),
        DayTable(spark, tables["usage"], "usage_start_time"),
        DayTable(spark, tables["wh"], "hour_ts"),
        DayTable(spark, tables["user"], "hour_ts"),
    )


def files(path, day):
    return sorted(p.name for p in Path(path).glob(f"day=2024-01-{day:02d}/*.parquet"))


def test_late_rows_rewrite_their_days_only(spark, tmp_path, rows):
    r = stored(spark, tmp_path)
    first = history(spark, ("w", "s", "u", 10, at(1)), ("w", None, "u", 20, at(2)), ("v", None, "u", 5, at(3)), (None, "s", "u", 7, at(3)))
    bill = spark.createDataFrame([("w", 1.5, at(1)), ("x", 2.0, at(2)), ("v", 4.0, at(3))], USAGE)
    assert r.load(first, bill) == [date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3)]
    before = {d: (files(tmp_path / "wh", d), files(tmp_path / "user", d)) for d in (1, 2, 3)}
    late = history(spark, ("w", "s", "u", 30, at(2, 1, 30)), ("v", "t", None, 1, at(2, 5)), ("w", "s", "u", 9, None))
    assert r.load(late, bill.limit(0)) == [date(2024, 1, 2)]
    after = {d: (files(tmp_path / "wh", d), files(tmp_path / "user", d)) for d in (1, 2, 3)}
    assert after[1] == before[1] and after[3] == before[3]
    assert not set(after[2][0]) & set(before[2][0])
    every, bills = first.unionByName(late), bill
    assert rows(r.user_hours(), "space_id", "warehouse_id", "hour_ts", "user_email", "tagged_ms", "tagged_queries") == rows(
        rollups.space_user_hourly(every), "space_id", "warehouse_id", "hour_ts", "user_email", "tagged_ms", "tagged_queries"
    )
    full = rollups.wh_hourly(every, bills).filter("warehouse_id in ('w', 'v')")
    columns = ["warehouse_id", "hour_ts", "total_ms", "statements", "dbus"]
    assert rows(r.warehouse_hours(), *columns) == rows(full, *columns)  # v is seen by the late row, on its old day too
    assert len(rows(full)) == 4


def test_loading_nothing_and_twice(spark, tmp_path, rows):
    r = stored(spark, tmp_path)
    first, bill = history(spark, ("w", "s", "u", 10, at(1))), spark.createDataFrame([("w", 1.5, at(1))], USAGE)
    r.load(first, bill)
    assert r.load(first.limit(0), bill.limit(0)) == []
    r.refresh([date(2024, 1, 1)], first.schema, bill.schema)
    assert [tuple(x)[:4] for x in r.warehouse_hours().collect()] == [("w", at(1), 10, 1)]


def test_windows_open_their_days_only(spark, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"), "start_time")
    table.append(history(spark, *[("w", None, "u", d, at(d)) for d in range(1, 29)], ("w", None, "u", 99, None)))
    window = Lookback(datetime(2024, 1, 20, 12), 3)
    kept = table.within(window, spark.read.parquet(table.path).drop("day").schema)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-17" in plan
    assert sorted(r["total_duration_ms"] for r in kept.collect()) == [17, 18, 19, 20]
    assert len(kept.inputFiles()) <= len(spark.read.parquet(table.path).inputFiles())
    assert days_of(table.of_days([date(2024, 1, 5)]), "start_time") == [date(2024, 1, 5)]


LOG = "k string, ts long, v string"


def log(spark, tmp_path):
    schema = spark.createDataFrame([], LOG).schema
    return BatchLog(spark, str(tmp_path / "log"), schema, "k", "ts", ["v"])


def test_folds_leave_the_rows_as_they_were(spark, tmp_path, rows):
    store = log(spark, tmp_path)
    assert store.fold() is None and store.read().count() == 0
    batches = [
        [("a", 1, "one"), ("b", 5, "b5"), ("n", None, "first")],
        [("a", 1, "same time, later"), ("b", 4, "older"), ("n", None, "second")],
        [("a", 2, "two"), ("c", 1, "c")],
        [("n", None, "third"), ("d", 1, "d")],
    ]
    for stream in ("s", "t"):
        for n, batch in enumerate(batches):
            store.put(spark.createDataFrame(batch, LOG), stream, n)
    wanted = rows(store.read())
    path = store.fold()
    assert path.endswith("fold=1") and rows(store.read()) == wanted
    assert store.rows().count() == 4 + 2 * 2  # one row per key of the closed batches, and the open ones
    read = {f.rsplit("/", 2)[-2] for f in store.rows().inputFiles()}
    assert read == {"held=false", "batch=3"}
    store.put(spark.createDataFrame([("a", 9, "nine")], LOG), "s", 4)
    store.put(spark.createDataFrame(batches[0], LOG), "s", 0)  # a repeated batch that is folded already
    wanted = rows(store.read())
    assert ("a", 9, "nine") in wanted
    assert store.fold(keep_open=0).endswith("fold=2") and rows(store.read()) == wanted
    assert store.fold(keep_open=0).endswith("fold=2")


def test_a_broken_fold_is_passed_over(spark, tmp_path, rows):
    store = log(spark, tmp_path)
    for n in range(3):
        store.put(spark.createDataFrame([("a", n, str(n)), (str(n), n, "x")], LOG), "s", n)
    wanted = rows(store.read())
    broken = store.fold()
    (Path(broken) / "_SUCCESS").unlink()
    assert rows(store.read()) == wanted
    assert store.fold().endswith("fold=2") and rows(store.read()) == wanted


def test_storing_counts_in_the_same_pass(spark, tmp_path):
    from opsight.sources.sinks import store_counted

    stored, n = store_counted(spark.range(1000).filter("id % 3 = 0").repartition(5), str(tmp_path / "a"))
    assert n == stored.count() == 334
    stored, n = store_counted(spark.range(10).limit(0), str(tmp_path / "b"))
    assert n == stored.count() == 0
