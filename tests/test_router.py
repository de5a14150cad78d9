"""Refresh router: payloads, the worked example, and dueness at its edges."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from opsight.operators import router as r
from opsight.plans import sinks
from tools.compare import rows as shown

T0 = datetime(2024, 1, 1)
CONFIG = "report_id string, report_name string, refresh_mode string, dependency_window_minutes int, enabled boolean"
DEPS = "report_id string, source_table string"
STATE = "source_table string, last_updated_ts timestamp_ntz, last_run_id string"
MARKS = "report_id string, last_refresh_ts timestamp_ntz, last_refresh_run_id string"


def due(spark, config, deps, state, marks=(), force=False):
    frames = [
        spark.createDataFrame(config, CONFIG),
        spark.createDataFrame(deps, DEPS),
        spark.createDataFrame([(t, T0 + timedelta(minutes=m), "x") for t, m in state], STATE),
        spark.createDataFrame([(i, T0 + timedelta(minutes=m), "x") for i, m in marks], MARKS),
    ]
    return {x.report_id: (x.is_due, x.reason) for x in r.evaluate_due(*frames, force).collect()}


@pytest.mark.parametrize(
    "payload, names",
    [
        ('["A.B.C", " a.b.c ", "x"]', ["a.b.c", "x"]),
        ('  ["A"]', ["a"]),
        ("", []),
        (None, []),
        ("not json", []),
        ('{"a": 1}', []),
        ('["", "  "]', []),
        ("[broken", []),
    ],
)
def test_payloads(spark, payload, names):
    df = spark.createDataFrame([(1, payload)], "run_id long, updated_tables string")
    assert sorted(x.source_table for x in r.parse_updates(df).collect()) == names


def test_worked_example(spark, rows):
    """Two ALL reports, three trigger runs, each naming one table."""
    config = spark.createDataFrame([("r1", "one", None, None, True), ("r2", "two", "all", None, True)], CONFIG)
    deps = spark.createDataFrame([("r1", "A"), ("r1", "b"), ("r2", "B"), ("r2", "c")], DEPS)
    state, marks = spark.createDataFrame([], STATE), spark.createDataFrame([], MARKS)
    seen = []
    for minute, table in enumerate(["a", "b", "c"], 1):
        now = T0 + timedelta(minutes=minute)
        updates = spark.createDataFrame([(table,)], "source_table string")
        state = r.upsert_table_state(state, updates, now, f"run{minute}")
        decided = r.evaluate_due(config, deps, state, marks)
        seen.append({x.report_id: x.reason for x in decided.collect() if x.is_due})
        marks = r.commit_state(marks, r.decisions(decided, now), f"run{minute}")
    assert seen == [{}, {"r1": "ALL 2/2"}, {"r2": "ALL 2/2"}]
    assert rows(marks, "report_id", "last_refresh_run_id") == [("r1", "run2"), ("r2", "run3")]


def test_state_keeps_its_spelling(spark, rows):
    state = spark.createDataFrame([("Cat.T", T0, "old"), ("other", T0, "old")], STATE)
    updates = spark.createDataFrame([("cat.t",), ("cat.t",), ("fresh",)], "source_table string")
    merged = r.upsert_table_state(state, updates, T0, "new")
    assert rows(merged, "source_table", "last_run_id") == [("Cat.T", "new"), ("fresh", "new"), ("other", "old")]


def test_modes_windows_and_repeated_dependencies(spark):
    config = [
        ("any", "", "Any", None, True),
        ("all", "", "", None, True),
        ("edge", "", "ALL", 30, True),
        ("wide", "", "ALL", 29, True),
        ("off", "", "ALL", 0, True),
        ("twice", "", "ALL", None, True),
        ("none", "", "ANY", None, True),
        ("paused", "", "ANY", None, False),
        ("equal", "", "ANY", None, True),
    ]
    deps = [("any", "T1"), ("any", "t9"), ("all", "t1"), ("all", "t9"), ("twice", "t1"), ("twice", "T1"), ("paused", "t1"), ("equal", "t1")]
    deps += [(x, t) for x in ("edge", "wide", "off") for t in ("t1", "t2")]
    state = [("T1", 10), ("t2", 40)]
    got = due(spark, config, deps, state, [("equal", 10)])
    assert got == {
        "any": (True, "ANY 1/2"),
        "all": (False, "ALL 1/2"),
        "edge": (True, "ALL 2/2"),
        "wide": (False, "ALL 2/2; window 30.0m>29m"),
        "off": (True, "ALL 2/2"),
        "twice": (False, "ALL 1/2"),
        "none": (False, "no dependencies configured"),
        "equal": (False, "ANY 0/1"),
    }
    forced = due(spark, config, deps, state, [], True)
    assert forced["wide"] == (True, "force_all") and forced["none"] == (False, "no dependencies configured")


def test_split_name(spark):
    df = spark.createDataFrame([("a.b.c",), ("a.b",), ("t",)], "n string").select("n", *r.split_name(F.col("n")))
    assert {tuple(x) for x in df.collect()} == {("a.b.c", "a", "b", "c"), ("a.b", None, None, "a.b"), ("t", None, None, "t")}


def test_refresh_list_carries_the_payload(spark):
    mapping = spark.createDataFrame(
        [("r1", "one", "A.B.C", True), ("r1", "one", "x", True), ("r2", "two", "x", False)],
        "report_id string, report_name string, source_table string, enabled boolean",
    )
    payloads = spark.createDataFrame([(7, '["a.b.C", "Z\\"q"]'), (8, "[]")], "run_id long, updated_tables string")
    got = r.refresh_list(mapping, payloads).collect()
    assert [(x.run_id, x.report_id, x.triggering_tables) for x in got] == [(7, "r1", '["a.b.c", "z\\"q"]')]
    matched = r.match_reports(mapping, r.parse_updates(payloads)).collect()
    assert [(x.report_id, x.refresh) for x in matched] == [("r1", True)]


def test_rows_of_one_table_are_made_by_several_tasks(spark):
    mapping = spark.createDataFrame(
        [(f"r{i}", None if i % 9 == 0 else "same", "A.B.C" if i < 200 else None, True) for i in range(210)],
        "report_id string, report_name string, source_table string, enabled boolean",
    )
    payloads = spark.createDataFrame([(i, '["a.b.C", "x"]') for i in range(50)], "run_id long, updated_tables string")
    limits = {f"spark.sql.{n}autoBroadcastJoinThreshold": "-1" for n in ("", "adaptive.")}
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        for got in (r.refresh_list(mapping, payloads), r.refresh_list_named(mapping, payloads)):
            sizes = [x["count"] for x in got.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 200 * 50 and len(sizes) == 4 and max(sizes) < 6000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got.columns == ["report_id", "report_name", "run_id", "triggering_tables", "catalog", "schema", "table"]
    assert {tuple(x)[3:] for x in got.collect()} == {('["a.b.c", "x"]', "A", "B", "C")}


def test_stored_audit_keeps_every_payload(spark, tmp_path):
    """Payloads of one hour stay apart, also those of one run; a list is kept in its order, with what it repeats."""
    events = [(7, 5, 8), (7, 6, 7), (37, 40, 1), (50, 41, 7), (67, 70, 1), (67, 70, 1)]
    tables = {
        "events": spark.createDataFrame(
            [(i, T0 + timedelta(minutes=m), u) for i, m, u in events], "event_id long, ts timestamp_ntz, user_id long"
        ),
        "supplier": spark.createDataFrame([(1, "one"), (18, "off")], "s_suppkey long, s_name string"),
        "lineitem": spark.createDataFrame([(1, 0), (1, 1), (1, 4), (18, 1)], "l_suppkey long, l_partkey long"),
    }
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = sinks.QUERIES["stored_audit"](spark, str(tmp_path))
    t1, t7, t8 = ('"cat.sch.t1"', '"cat.sch.t7"', '"cat.sch.t8"')
    assert sorted((x.run_id, x.report_id, x.triggering_tables) for x in got.collect()) == [
        (7, "r1", f"[{t7}, {t7}]"),
        (7, "r1", f"[{t8}, {t7}]"),
        (7, "r1", f"[{t8}, {t7}]"),
        (37, "r1", f"[{t1}, {t7}]"),
        (67, "r1", f"[{t1}, {t7}]"),
        (67, "r1", f"[{t1}, {t7}]"),
    ]
    result = con.execute(sinks.ORACLE["stored_audit"])
    columns = [d[0] for d in result.description]
    assert shown(got.columns, [tuple(x) for x in got.collect()]) == shown(columns, result.fetchall())


def test_many_payloads_give_the_same_rows(spark, rows):
    mapping = spark.createDataFrame(
        [(f"r{i % 40}", None, f"A.b.{'cD'[i % 2]}", i % 9 != 0) for i in range(90)] + [("r1", "one", None, True)],
        "report_id string, report_name string, source_table string, enabled boolean",
    )
    payloads = spark.createDataFrame(
        [(None if i % 7 == 0 else i // 2, '["a.b.C", "a.b.c", "x"]' if i % 3 else '["a.b.d", " A.B.C "]') for i in range(60)]
        + [(1, None), (2, "[broken")],
        "run_id long, updated_tables string",
    )
    few, many = r.refresh_list(mapping, payloads), r.refresh_list(mapping, payloads, many=True)
    assert many.columns == few.columns and rows(many) == rows(few)
    assert many.select(F.spark_partition_id()).distinct().count() > 1
