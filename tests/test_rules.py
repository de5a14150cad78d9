"""Branches the derived data does not reach: flags, advice, price edges, maintenance rules."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsight.operators import cost as c
from opsight.operators import maintenance as m
from opsight.operators import utilization as u
from opsight.operators import versions as v
from opsight.windows import Lookback

NOW = datetime(2024, 1, 30)
WINDOW = Lookback(NOW, 20)
FLAGS = "cluster_id string, p95_cpu_percent double, p95_mem_percent double, avg_swap_percent double, avg_cpu_percent double, idle_percent double, p95_active_workers long, active_minutes long"
BASE = "cluster_id string, worker_count long, min_autoscale_workers long, max_autoscale_workers long, auto_termination_minutes long"


@pytest.mark.parametrize(
    "config, stats, category, advice",
    [
        ((4, None, None, 30), None, u.IDLE, "DELETE"),
        ((None, 1, 5, 30), (86.0, 10.0, 0.0, 50.0, 0.0, 5, 60), u.OVER, "SCALE UP: raise max_autoscale_workers above 5"),
        ((None, 1, 5, 30), (50.0, 10.0, 0.0, 50.0, 0.0, 5, 60), u.OVER, "Suggested new max: 8."),
        ((2, None, None, 30), (85.0, 90.0, 0.0, 50.0, 0.0, 2, 60), u.OVER, "memory-optimized"),
        ((2, None, None, 30), (85.0, 10.0, 5.0, 50.0, 0.0, 2, 60), u.OVER, "compute-optimized"),
        ((9, None, None, 30), (50.0, 60.0, 0.0, 24.0, 0.0, 9, 60), u.UNDER, "autoscaling min=2, max=9"),
        ((None, 2, 6, 30), (50.0, 60.0, 0.0, 29.0, 0.0, 2, 60), u.UNDER, "from 2 to 1"),
        ((None, 2, 6, None), (50.0, 60.0, 0.0, 40.0, 60.5, 4, 60), u.UNDER, "(currently DISABLED)"),
        ((None, 2, 6, 119), (50.0, 60.0, 0.0, 40.0, 60.5, 4, 60), u.RIGHT, "NO CHANGE"),
        ((2, None, None, 30), (39.0, 49.0, 0.0, 19.0, 0.0, 2, 60), u.UNDER, "DOWNSIZE"),
        ((None, 5, 5, 30), (50.0, 60.0, 0.0, 50.0, 0.0, 5, 60), u.RIGHT, "NO CHANGE"),
        ((2, None, None, 30), (90.0, 60.0, 0.0, 50.0, 0.0, 2, 59), u.IDLE, "DELETE"),
    ],
)
def test_cluster_rules(spark, config, stats, category, advice):
    base = spark.createDataFrame([("a", *config)], BASE)
    summary = spark.createDataFrame([("a", *stats)] if stats else [], FLAGS)
    cost = spark.createDataFrame([], "cluster_id string, total_dbus double, estimated_cost_usd double")
    row = u.with_recommendation(u.with_reason(u.categorize(u.with_flags(base, summary, cost)))).first()
    assert row.utilization_category == category and advice in row.recommendation
    assert bool(row.reason) == (category != u.RIGHT or stats[4] > 60 and config[3] is None)


USAGE = """workspace_id string, warehouse_id string, cluster_id string, job_id long, endpoint_id string, cloud string, sku_name string,
usage_unit string, usage_quantity double, usage_start_time timestamp_ntz, usage_end_time timestamp_ntz, usage_date date"""
PRICES = """cloud string, sku_name string, usage_unit string, currency_code string, price_default double, price_effective double,
price_start_time timestamp_ntz, price_end_time timestamp_ntz"""


def used(ts, quantity=1.0):
    return ("1", "w", "c", 1, "e", "AZ", "S", "DBU", quantity, ts, ts, ts.date())


def test_price_on_a_boundary_and_several_currencies(spark):
    edge = NOW - timedelta(days=5)
    usage = spark.createDataFrame([used(edge, 2.0), used(edge - timedelta(hours=1))], USAGE)
    old, new = ("AZ", "S", "DBU", "USD", 1.0, 1.0, datetime(2020, 1, 1), edge), ("AZ", "S", "DBU", "USD", 3.0, 3.0, edge, None)
    prices = spark.createDataFrame([old, new], PRICES)
    billed = {r.hour_ts: r.cost_usd for r in c.warehouse_billing(usage, prices, WINDOW).collect()}
    assert billed == {edge: 6.0, edge - timedelta(hours=1): 1.0}
    base = spark.createDataFrame([("c",)], "cluster_id string")
    closed = u.cluster_cost(usage, prices, base, WINDOW).first()
    assert (closed.total_dbus, closed.estimated_cost_usd, closed.billed_days) == (5.0, 9.0, 2)
    euro = spark.createDataFrame([old, new, ("AZ", "S", "DBU", "EUR", 5.0, 5.0, edge, None)], PRICES)
    doubled = {r.hour_ts: r.cost_usd for r in c.warehouse_billing(usage, euro, WINDOW).collect()}
    assert doubled[edge] == 16.0


def test_allocation_returns_the_whole_bill_when_every_query_is_tagged(spark):
    start = NOW - timedelta(days=2)
    history = spark.createDataFrame(
        [("w", f"u{i % 7}", "s", start + timedelta(minutes=i * 11), 1000 + i * 37) for i in range(200)],
        "warehouse_id string, executed_by string, space_id string, start_time timestamp_ntz, total_duration_ms long",
    )
    usage = spark.createDataFrame([used(start + timedelta(minutes=i * 30), 0.5 + i) for i in range(60)], USAGE)
    prices = spark.createDataFrame([("AZ", "S", "DBU", "USD", 2.0, 1.5, datetime(2020, 1, 1), None)], PRICES)
    billing = c.warehouse_billing(usage, prices, WINDOW)
    tagged = c.tagged_activity(history, WINDOW, ["s"], ["user_email"])
    split = c.allocate(tagged, c.all_activity(history, WINDOW), billing, ["user_email"])
    total = billing.agg(F.sum("cost_usd")).first()[0]
    assert split.agg(F.sum("est_tagged_cost_usd")).first()[0] == pytest.approx(total, abs=1e-3)


def test_ids_are_not_trimmed():
    assert c.split_ids("a, b") == ["a", " b"]


HISTORY = "table_name string, version long, op_ts timestamp_ntz, operation string, user_name string, operation_metrics map<string,string>"


def test_removable_files_and_candidates(spark):
    day = lambda n: NOW - timedelta(days=n)
    data = [
        ("t", 1, day(9), "DELETE", "u", {"numRemovedFiles": "100"}),
        ("t", 2, day(8), "VACUUM END", "u", {"numRemovedFiles": "999"}),
        ("t", 3, day(8), "DELETE", "u", {"numRemovedFiles": "50"}),
        ("t", 4, day(7), "MERGE", "u", {"numRemovedFiles": "3", "numTargetFilesRemoved": "4"}),
        ("t", 5, day(6), "MERGE", "u", {"numRemovedFiles": "n/a", "numTargetFilesRemoved": "2"}),
        ("t", 6, day(5), "WRITE", "u", {"numAddedFiles": "7"}),
        ("n", 1, day(1), "DELETE", "u", {"numRemovedFiles": "2000"}),
    ]
    history = spark.createDataFrame(data, HISTORY)
    got = {r.table_name: (r.removable_files, r.ops_since_last_vacuum) for r in m.removable_since(history, m.last_vacuum(history)).collect()}
    assert got == {"t": (9, 2), "n": (2000, 1)}
    scope = spark.createDataFrame([("t", "s"), ("n", "s"), ("lost", "s"), ("quiet", "s")], "table_name string, schema_name string")
    gb = 1024**3
    detail = spark.createDataFrame([("t", 100 * gb, 1), ("n", 100 * gb + 1, 1), ("quiet", None, None)], "table_name string, size_in_bytes long, num_files long")
    dry = spark.createDataFrame([("t", 5, None), ("n", 5, None), ("quiet", None, "Timeout")], "table_name string, dry_run_files long, dry_run_error string")
    rows = {r.table: r for r in m.vacuum_candidates(scope, detail, history, dry, NOW, "main").collect()}
    assert (rows["t"].estimation_method, rows["t"].est_files_to_clean) == ("dry_run", 5)
    assert (rows["n"].estimation_method, rows["n"].candidate_score) == ("dry_run", 10.0)
    assert rows["n"].reason == "never vacuumed; ~5 removable files; 1 mutating op(s) since last VACUUM (VACUUM ops excluded to prevent double-counting)"
    assert rows["t"].reason.startswith("last VACUUM 8.0d ago; ~5 removable files; 2 mutating")
    assert rows["quiet"].estimation_method == "history_fallback (Timeout)" and rows["quiet"].reason == "never vacuumed"
    assert rows["lost"].error and rows["lost"].candidate_score is None and rows["lost"].reason is None
    assert m.top_candidates(m.vacuum_candidates(scope, detail, history, dry, NOW, "main")).count() == 3


def test_version_counts_skip_unparsable_entries(spark):
    data = [
        ("t", 1, NOW - timedelta(days=3, hours=1), "WRITE", "a", {"numAddedFiles": "5", "numRemovedFiles": "1"}),
        ("t", 2, NOW - timedelta(days=2), "MERGE", "b", {"numAddedFiles": "5", "numRemovedFiles": "x"}),
        ("t", 3, NOW - timedelta(hours=30), "WRITE", "c", {"numRecords": "12", "numRows": "13"}),
        ("single", 1, NOW, "WRITE", "c", None),
    ]
    detail = spark.createDataFrame([("t", "db", "S3://b/x", 0)], "table_name string, schema_name string, location string, size_in_bytes long")
    row = v.version_analysis(spark.createDataFrame(data, HISTORY), detail, NOW).collect()
    assert len(row) == 1
    row = row[0]
    assert (row.total_files_added, row.total_files_removed, row.latest_row_count) == (5, 1, 12)
    assert (row.days_since_modification, row.version_span_days, row.table_size_mb) == (1, 1, None)
    assert row.operation_summary == "{'WRITE': 2, 'MERGE': 1}" and row.storage_type == "Managed"


@pytest.mark.parametrize(
    "location, want",
    [
        (None, ("External", False, False)),
        ("DBFS:/mnt/a", ("Azure Mount Point", False, True)),
        ("abfss://c@a/x", ("Azure External", False, False)),
        ("wasb://c@a/x", ("Azure External", False, False)),
        ("dbfs:/user/hive/warehouse/x", ("Managed", True, False)),
        ("gs://b/x", ("Managed", True, False)),
    ],
)
def test_storage_class(spark, location, want):
    row = v.with_storage_class(spark.createDataFrame([(location,)], "location string")).first()
    assert (row.storage_type, row.is_managed_storage, row.is_mount_point) == want


def test_schema_filter_text():
    assert m.parse_schemas(" all ") is None and m.parse_schemas("") is None
    assert m.parse_schemas("a, b,,") == ["a", "b"]
