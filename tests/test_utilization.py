"""Node samples to cluster statistics."""

from datetime import datetime, timedelta

from opsight.operators import utilization as u

T0 = datetime(2024, 1, 10)
RAW = "cluster_id string, instance_id string, start_time timestamp_ntz, driver boolean, cpu_active_percent int, mem_used_percent int, mem_swap_percent int"


def samples(spark):
    rows = [(f"c{i % 2}", f"i{i % 60}", T0 + timedelta(seconds=20 * i), i % 5 == 0, i % 100, i % 50, 0) for i in range(1000)]
    rows += [(None, "x", T0, True, 7, None, None), (None, None, T0, None, None, 3, 1), ("lone", None, T0, False, None, None, None)]
    return spark.createDataFrame(rows, RAW)


def test_statistics_of_clusters(spark):
    got = {r.cluster_id: r for r in u.cluster_stats(samples(spark)).collect()}
    assert {k: (r.distinct_nodes_seen, r.total_minute_samples) for k, r in got.items()} == {"c0": (30, 500), "c1": (30, 500), None: (1, 2), "lone": (0, 1)}
    assert (got["c0"].p50_cpu_percent, got["c0"].p95_cpu_percent, got["c1"].p95_mem_percent) == (48, 94, 47)
    assert (got[None].p50_cpu_percent, got[None].max_mem_percent, got["lone"].avg_cpu_percent) == (7, 3, None)


def test_instances_carry_no_sketches(spark):
    plan = u.utilization_summary(samples(spark))._jdf.queryExecution().sparkPlan().toString()
    sketched = [line for line in plan.splitlines() if "percentile_approx(cpu_active_percent" in line]
    assert sketched and not any("instance_id" in line for line in sketched)
