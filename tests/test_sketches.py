import random

from pyspark.sql import functions as F

from opsight.operators.sketches import daily_sketches, merged_quantiles, rank_within


def test_merged_quantiles_are_close_and_nulls_do_not_count(spark):
    rng = random.Random(1)
    data = [("a", f"2024-01-{1 + i % 9:02} 10:00:00", rng.gauss(0, 1) if i % 7 else None) for i in range(20000)]
    data += [("b", "2024-01-01 00:00:00", None), ("c", "2024-01-02 00:00:00", 5.0), (None, "2024-01-02 00:00:00", 1.0)]
    rows = spark.createDataFrame(data, "k string, at string, x double").withColumn("at", F.col("at").cast("timestamp_ntz"))
    stored = daily_sketches(rows, ["k"], "at", {"x": F.col("x")})
    assert stored.filter("k = 'a'").count() == 9
    found = merged_quantiles(stored, ["k"], {"x": [0.5, 0.95]})
    got = {r["k"]: (r["x_p50"], r["x_p95"], r["n"]) for r in found.collect()}
    assert got["b"] == (None, None, 1) and got["c"] == (5.0, 5.0, 1) and got[None][2] == 1 and got["a"][2] == 20000
    checks = {"x_p50": (F.col("x"), 0.5), "x_p95": (F.col("x"), 0.95)}
    near = {r["k"]: r["x_p50_close"] and r["x_p95_close"] for r in rank_within(rows, found, ["k"], checks, 0.01).collect()}
    assert near["a"] and near["c"]
    off = found.withColumn("x_p50", F.col("x_p50") + 1)
    assert not {r["k"]: r["x_p50_close"] for r in rank_within(rows, off, ["k"], checks, 0.01).collect()}["a"]


def test_empty_table(spark):
    rows = spark.createDataFrame([], "k string, at timestamp_ntz, x double")
    assert merged_quantiles(daily_sketches(rows, ["k"], "at", {"x": F.col("x")}), ["k"], {"x": [0.5]}).count() == 0
