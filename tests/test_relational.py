"""Shared relational helpers: boundaries, ties, hot keys, nulls."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsight.functions.columns import settled
from opsight.functions.relational import (
    as_of_join,
    exact_percentiles,
    hot_key_join,
    interval_join,
    latest_by,
    share_of_total,
    spread_join,
    validity_intervals,
)

T0 = datetime(2024, 1, 10)
DAYS = (date(2024, 1, 8), date(2024, 1, 12))


def at(hours):
    return T0 + timedelta(hours=hours)


def test_latest_by_nulls_last_and_tie_break(spark, rows):
    data = [("a", None, 1), ("a", 3, 1), ("a", 3, 2), ("b", None, 7)]
    df = spark.createDataFrame(data, "k string, ts int, tie int")
    assert rows(latest_by(df, ["k"], ["ts", "tie"])) == [("a", 3, 2), ("b", None, 7)]


def test_share_of_total_sums_to_hundred(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n int")
    assert [r[2] for r in rows(share_of_total(df, "n", "p"))] == [33.3, 33.3, 33.3]


@pytest.mark.parametrize("closed, on_end", [(False, ["new"]), (True, ["new", "old"])])
def test_interval_boundaries(spark, closed, on_end):
    facts = spark.createDataFrame(
        [("k", at(0)), ("k", at(24)), ("k", at(-24)), ("x", at(0)), ("k", at(24 * 400)), ("k", at(-24 * 400))],
        "key string, ts timestamp_ntz",
    )
    spans = spark.createDataFrame(
        [("k", "old", at(0), at(24)), ("k", "new", at(24), None), ("k", "bad", at(5), at(1))],
        "key string, label string, s timestamp_ntz, e timestamp_ntz",
    )
    joined = interval_join(facts, spans, ["key"], "ts", "s", "e", DAYS, closed=closed).collect()
    found = {}
    for r in joined:
        found.setdefault((r.key, r.ts), []).append(r.label)
    assert sorted(found[("k", at(24))]) == on_end
    assert found[("k", at(0))] == ["old"]
    assert found[("k", at(-24))] == [None] and found[("x", at(0))] == [None]
    # far outside the clipped days: the open span still covers, the past still does not
    assert found[("k", at(24 * 400))] == ["new"] and found[("k", at(-24 * 400))] == [None]


def test_interval_join_matches_brute_force(spark):
    rnd = random.Random(1)
    facts = [(rnd.choice("hhhhab"), at(rnd.randint(-300, 300)), i) for i in range(300)]
    spans = []
    for key in "hab":
        for i in range(40):
            start = rnd.randint(-400, 300)
            spans.append((key, f"{key}{i}", at(start), None if rnd.random() < 0.2 else at(start + rnd.randint(0, 90))))
    got = interval_join(
        spark.createDataFrame(facts, "key string, ts timestamp_ntz, i int"),
        spark.createDataFrame(spans, "key string, label string, s timestamp_ntz, e timestamp_ntz"),
        ["key"], "ts", "s", "e", DAYS, how="inner",
    )
    want = sorted(
        (i, label) for k, ts, i in facts for key, label, s, e in spans if k == key and ts >= s and (e is None or ts < e)
    )
    assert sorted((r.i, r.label) for r in got.collect()) == want


def test_repeated_spans_are_broadcast_only_below_the_limit(spark):
    facts = spark.range(10).select((F.col("id") % 2).alias("key"), F.lit(T0).cast("timestamp_ntz").alias("ts"))
    spans = spark.range(2).select(
        F.col("id").alias("key"), F.lit(at(-1)).cast("timestamp_ntz").alias("s"), F.lit(at(1)).cast("timestamp_ntz").alias("e")
    )
    plan = lambda: interval_join(facts, spans, ["key"], "ts", "s", "e", DAYS)
    shown = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        assert "BroadcastHashJoin" in shown(plan())
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "150")  # below five copies of the spans
        assert "SortMergeJoin" in shown(plan()) and plan().count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_validity_and_as_of_match_brute_force(spark):
    rnd = random.Random(2)
    changes = [(rnd.choice("hhha"), at(rnd.randint(-200, 100)), i) for i in range(120)]
    changes = list({(k, t): (k, t, i) for k, t, i in changes}.values())
    df = spark.createDataFrame(changes, "key string, ts timestamp_ntz, i int")
    for r in validity_intervals(df, ["key"], "ts", "until").collect():
        later = [t for k, t, _ in changes if k == r.key and t > r.ts]
        assert r.until == (min(later) if later else None)
    facts = [(k, at(h)) for k in "hab" for h in range(-250, 150, 7)]
    joined = as_of_join(
        spark.createDataFrame(facts, "key string, at timestamp_ntz"), df, ["key"], "at", "ts", DAYS
    ).collect()
    assert len(joined) == len(facts)
    for r in joined:
        past = [(t, i) for k, t, i in changes if k == r.key and t <= r.at]
        assert r.i == (max(past)[1] if past else None)


def test_exact_percentiles_with_hot_key(spark):
    rnd = random.Random(3)
    data = [("hot", float(rnd.lognormvariate(3, 2)), rnd.randint(0, 5)) for _ in range(5000)]
    data += [("one", 7.0, None), ("two", 1.0, 1), ("two", 2.0, 1), (None, 5.0, 2)]
    data += [("few", float(i), i) for i in range(11)] + [("nil", None, 3)]
    df = spark.createDataFrame(data, "k string, v double, w int")
    wanted = {"p50": ("v", 0.5), "p95": ("v", 0.95), "w90": ("w", 0.9)}
    got = {r.k: r for r in exact_percentiles(df, ["k"], wanted, buckets=16).collect()}
    for key in ("hot", "one", "two", "few", "nil", None):
        v = [b for a, b, _ in data if a == key and b is not None]
        w = [c for a, _, c in data if a == key and c is not None]
        for out, values, p in (("p50", v, 50), ("p95", v, 95), ("w90", w, 90)):
            if values:
                assert got[key][out] == pytest.approx(np.percentile(values, p), rel=1e-12)
            else:
                assert got[key][out] is None


def test_percentile_agrees_with_builtin(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    a = exact_percentiles(df, ["k"], {"p": ("v", 0.9)}).orderBy("k").collect()
    b = df.groupBy("k").agg(F.percentile("v", 0.9).alias("p")).orderBy("k").collect()
    assert [(r.k, pytest.approx(r.p)) for r in a] == [(r.k, r.p) for r in b]


def test_rounding_is_one_rounding(spark):
    df = spark.createDataFrame([(2.44999996, 0.1 + 0.2), (2.45, 2.675)], "a double, b double")
    got = df.select(settled("a", 1), settled("b", 2)).collect()
    assert [tuple(r) for r in got] == [(2.4, 0.3), (2.5, 2.68)]


@pytest.mark.parametrize("join", [spread_join, hot_key_join])
@pytest.mark.parametrize("deals", [1, 3, 64])
def test_dealt_joins_give_the_rows_of_a_plain_one(spark, rows, join, deals):
    left = spark.createDataFrame([(None if i % 10 == 0 else i % 7 * (i % 3), i // 2) for i in range(300)] + [(99, None)], "k int, v int")
    right = spark.createDataFrame([(i % 9 if i % 11 else None, f"t{i // 2}") for i in range(40)], "k int, t string")
    want = left.join(right, "k")
    got = join(left, right, "k", deals)
    assert got.columns == want.columns and rows(got) == rows(want)
    assert rows(join(left.limit(0), right, "k", deals)) == [] == rows(join(left, right.limit(0), "k", deals))


def test_a_hot_key_is_dealt_out(spark):
    facts = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(4000)], "k int, v int")
    dims = spark.createDataFrame([(i, str(i)) for i in range(4000)], "k int, t string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = hot_key_join(facts, dims.hint("merge"), "k").withColumn("p", F.spark_partition_id())
        sizes = [x["count"] for x in got.filter("k = 1").groupBy("p").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 2000 and len(sizes) == 4
