"""Interactive-cluster utilization: per-cluster statistics, flags, category, advice, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.functions.columns import pct, settled, text_or, trunc_ts
from opsight.functions.relational import interval_join, latest_by, null_safe_join
from opsight.functions.rules import by_value, fired, first_match
from opsight.windows import Lookback, ts_lit

ACCURACY = 100_000

# Category names and the thresholds behind the flags.
IDLE, OVER, UNDER, RIGHT = "IDLE_OR_UNUSED", "OVER_UTILIZED", "UNDER_UTILIZED", "RIGHT_SIZED"
SAVINGS_SHARE = 0.4


def cluster_base(clusters: DataFrame, window: Lookback) -> DataFrame:
    """Newest configuration of each interactive cluster that still lived in the window."""
    alive = F.col("delete_time").isNull() | window.since(F.col("delete_time"))
    tie = ["o_key"] if "o_key" in clusters.columns else []
    kept = clusters.filter(F.col("cluster_source").isin("UI", "API") & alive)
    return latest_by(kept, ["cluster_id"], ["change_time", *tie])


def utilization_raw(nodes: DataFrame, base: DataFrame, window: Lookback) -> DataFrame:
    """Node minutes of the base clusters; a missing CPU part counts as 0."""
    cpu = F.coalesce("cpu_user_percent", F.lit(0)) + F.coalesce("cpu_system_percent", F.lit(0))
    return (
        nodes.filter(window.since(F.col("start_time")))
        .join(base, "cluster_id", "left_semi")
        .withColumn("cpu_active_percent", cpu)
    )


def _approx(col: str, p: float) -> Column:
    return F.percentile_approx(col, p, ACCURACY)


def cluster_stats(raw: DataFrame) -> DataFrame:
    """Statistics over node samples; an idle sample has less than 10 % CPU.

    Instances are counted apart: in one aggregation with the percentiles, every instance would carry sketches.
    """
    cpu, mem = "cpu_active_percent", "mem_used_percent"
    nodes = raw.groupBy("cluster_id").agg(F.countDistinct("instance_id").alias("distinct_nodes_seen"))
    stats = raw.groupBy("cluster_id").agg(
        F.avg(cpu).alias("avg_cpu_percent"),
        _approx(cpu, 0.50).alias("p50_cpu_percent"),
        _approx(cpu, 0.95).alias("p95_cpu_percent"),
        F.max(cpu).alias("max_cpu_percent"),
        F.stddev(cpu).alias("stddev_cpu_percent"),
        F.avg(mem).alias("avg_mem_percent"),
        _approx(mem, 0.95).alias("p95_mem_percent"),
        F.max(mem).alias("max_mem_percent"),
        F.avg("mem_swap_percent").alias("avg_swap_percent"),
        F.count_if(F.col(cpu) < 10).alias("idle_minute_samples"),
        F.count(F.lit(1)).alias("total_minute_samples"),
    )
    return null_safe_join(nodes, stats, ["cluster_id"])


def scaling_stats(raw: DataFrame) -> DataFrame:
    """Worker-count series per minute; its rows also give the distinct minutes and days."""
    workers = F.col("workers_active")
    return (
        raw.groupBy("cluster_id", trunc_ts("minute", F.col("start_time")).alias("minute"))
        .agg(F.count_if(~F.col("driver")).alias("workers_active"))
        .groupBy("cluster_id")
        .agg(
            F.count(F.lit(1)).alias("active_minutes"),
            F.countDistinct(F.to_date("minute")).alias("active_days"),
            F.avg(workers).alias("avg_active_workers"),
            F.min(workers).alias("min_active_workers"),
            F.max(workers).alias("max_active_workers"),
            _approx("workers_active", 0.50).alias("p50_active_workers"),
            _approx("workers_active", 0.95).alias("p95_active_workers"),
            F.countDistinct(workers).alias("distinct_worker_counts"),
        )
    )


def utilization_summary(raw: DataFrame) -> DataFrame:
    rounded = [
        "avg_cpu_percent",
        "p50_cpu_percent",
        "p95_cpu_percent",
        "max_cpu_percent",
        "stddev_cpu_percent",
        "avg_mem_percent",
        "p95_mem_percent",
        "max_mem_percent",
        "avg_swap_percent",
    ]
    return (
        cluster_stats(raw)
        .join(scaling_stats(raw), "cluster_id", "left")
        .withColumns({c: settled(c, 2) for c in rounded})
        .withColumn("idle_percent", pct(F.col("idle_minute_samples"), F.col("total_minute_samples"), 2))
    )


def cluster_cost(usage: DataFrame, prices: DataFrame, base: DataFrame, window: Lookback) -> DataFrame:
    """Units and cost per cluster at prices valid, bounds included, at usage end.

    A row on a price boundary meets both prices and counts twice, in units as well.
    Rows with equal cluster, product and time are summed before the price join.
    """
    keys = ["cluster_id", "sku_name", "usage_unit", "usage_end_time", "usage_date"]
    billed = (
        usage.filter(F.col("cluster_id").isNotNull() & window.since_date(F.col("usage_date")))
        .join(base, "cluster_id", "left_semi")
        .groupBy(*keys)
        .agg(F.sum("usage_quantity").alias("usage_quantity"))
    )
    spans = prices.select(
        "sku_name",
        "usage_unit",
        "price_default",
        "price_start_time",
        F.coalesce("price_end_time", ts_lit(window.as_of)).alias("price_end_time"),
    )
    priced = interval_join(
        billed,
        spans,
        ["sku_name", "usage_unit"],
        "usage_end_time",
        "price_start_time",
        "price_end_time",
        (window.start.date(), window.as_of.date()),
        closed=True,
    )
    return priced.groupBy("cluster_id").agg(
        F.sum("usage_quantity").alias("total_dbus"),
        F.sum(F.col("usage_quantity") * F.coalesce("price_default", F.lit(0.0))).alias("estimated_cost_usd"),
        F.countDistinct("usage_date").alias("billed_days"),
    )


def with_flags(base: DataFrame, summary: DataFrame, cost: DataFrame) -> DataFrame:
    """Configuration, utilization and cost side by side, with ten three-valued flags."""
    auto, p95w = F.col("autoscale_enabled"), F.col("p95_active_workers")
    low, high = F.col("min_autoscale_workers"), F.col("max_autoscale_workers")
    cpu, p95 = F.col("avg_cpu_percent"), F.col("p95_cpu_percent")
    term, minutes = F.col("auto_termination_minutes"), F.col("active_minutes")
    return (
        base.withColumn("autoscale_enabled", high.isNotNull())
        .join(summary, "cluster_id", "left")
        .join(cost, "cluster_id", "left")
        .withColumns(
            {
                "flag_cpu_pressure": p95 >= 85,
                "flag_mem_pressure": F.col("p95_mem_percent") >= 90,
                "flag_swap_pressure": F.col("avg_swap_percent") > 5,
                "flag_autoscale_pinned": auto & (p95w >= high) & (high > low),
                "flag_low_util": (cpu < 20) & (p95 < 40) & (F.col("p95_mem_percent") < 50),
                "flag_high_idle": F.col("idle_percent") > 60,
                "flag_loose_termination": term.isNull() | (term >= 120),
                "flag_autoscale_floor_only": auto & (p95w <= low) & (low < high) & (cpu < 30),
                "flag_essentially_unused": minutes.isNull() | (minutes < 60),
                "flag_fixed_oversized": ~auto
                & F.col("worker_count").isNotNull()
                & (F.col("worker_count") >= 4)
                & (cpu < 25),
            }
        )
    )


def _flag(name: str) -> Column:
    return F.col(f"flag_{name}")


def categorize(flags: DataFrame) -> DataFrame:
    pressed = _flag("cpu_pressure") | _flag("mem_pressure") | _flag("swap_pressure") | _flag("autoscale_pinned")
    slack = (
        _flag("low_util")
        | _flag("fixed_oversized")
        | (_flag("high_idle") & _flag("loose_termination"))
        | _flag("autoscale_floor_only")
    )
    rules = [(_flag("essentially_unused"), IDLE), (pressed, OVER), (slack, UNDER)]
    return flags.withColumn("utilization_category", first_match(rules, RIGHT))


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def with_reason(df: DataFrame) -> DataFrame:
    """The flags that fired, in words. The texts are fixed values."""
    c = F.col
    parts = [
        (_flag("cpu_pressure"), _say("CPU p95 ", c("p95_cpu_percent"), "% >= 85% (sustained CPU pressure)")),
        (_flag("mem_pressure"), _say("Memory p95 ", c("p95_mem_percent"), "% >= 90% (memory pressure)")),
        (_flag("swap_pressure"), _say("Avg swap ", c("avg_swap_percent"), "% > 5% (memory thrashing)")),
        (
            _flag("autoscale_pinned"),
            _say("Autoscale pinned at max (", c("max_autoscale_workers"), " workers) at p95"),
        ),
        (
            _flag("low_util"),
            _say(
                "Low utilization: avg CPU ",
                c("avg_cpu_percent"),
                "%, p95 CPU ",
                c("p95_cpu_percent"),
                "%, p95 mem ",
                c("p95_mem_percent"),
                "%",
            ),
        ),
        (
            _flag("high_idle") & _flag("loose_termination"),
            _say(
                "Idle ",
                c("idle_percent"),
                "% of runtime with auto-termination = ",
                text_or(c("auto_termination_minutes"), "DISABLED"),
                " min",
            ),
        ),
        (
            _flag("autoscale_floor_only"),
            _say(
                "Autoscale never exceeded floor (",
                c("min_autoscale_workers"),
                " workers); ceiling of ",
                c("max_autoscale_workers"),
                " unused",
            ),
        ),
        (
            _flag("fixed_oversized"),
            _say(
                "Fixed-size cluster with ", c("worker_count"), " workers but avg CPU only ", c("avg_cpu_percent"), "%"
            ),
        ),
        (
            _flag("essentially_unused"),
            _say(
                "Cluster ran <60 minutes total in window (",
                text_or(c("active_minutes"), "0"),
                " min) — likely abandoned",
            ),
        ),
    ]
    return df.withColumn("reason", fired(parts, " | "))


def with_recommendation(df: DataFrame) -> DataFrame:
    """One piece of advice per cluster, first rule wins. The texts are fixed values."""
    c = F.col
    term = text_or(c("auto_termination_minutes"), "DISABLED")
    ceiling = F.ceil(c("max_autoscale_workers") * F.lit(1.5))
    quarter = F.greatest(F.lit(1), (c("worker_count") / 4).cast("int"))
    rules = [
        (
            _flag("essentially_unused"),
            "DELETE: cluster has been essentially unused. If retained for ad-hoc use, ensure auto-termination is set to 30 minutes or less.",
        ),
        (
            _flag("autoscale_pinned") & _flag("cpu_pressure"),
            _say(
                "SCALE UP: raise max_autoscale_workers above ",
                c("max_autoscale_workers"),
                " (workload routinely hits the ceiling). Also consider a larger worker node type since CPU p95 = ",
                c("p95_cpu_percent"),
                "%.",
            ),
        ),
        (
            _flag("autoscale_pinned"),
            _say(
                "RAISE CEILING: increase max_autoscale_workers from ",
                c("max_autoscale_workers"),
                " (workload is pinned at the ceiling at p95). Suggested new max: ",
                ceiling,
                ".",
            ),
        ),
        (
            _flag("mem_pressure") | _flag("swap_pressure"),
            "UPGRADE NODE TYPE: move to a memory-optimized worker (e.g., r-series) — sustained memory pressure / swap detected. Also enable elastic disk if not already on.",
        ),
        (
            _flag("cpu_pressure"),
            "UPGRADE NODE TYPE: move to a compute-optimized worker (e.g., c-series) or one with more vCPUs — sustained CPU pressure detected.",
        ),
        (
            _flag("fixed_oversized"),
            _say(
                "CONVERT TO AUTOSCALING: replace fixed worker_count=",
                c("worker_count"),
                " with autoscaling min=",
                quarter,
                ", max=",
                c("worker_count"),
                ". Average CPU is only ",
                c("avg_cpu_percent"),
                "%.",
            ),
        ),
        (
            _flag("autoscale_floor_only"),
            _say(
                "LOWER FLOOR: reduce min_autoscale_workers from ",
                c("min_autoscale_workers"),
                " to 1 — workload never scaled above the floor. Keep max at ",
                c("max_autoscale_workers"),
                ".",
            ),
        ),
        (
            _flag("high_idle") & _flag("loose_termination"),
            _say(
                "TIGHTEN AUTO-TERMINATION: set auto_termination_minutes to 30 (currently ",
                term,
                "). Cluster sits idle ",
                c("idle_percent"),
                "% of runtime.",
            ),
        ),
        (
            _flag("low_util"),
            _say(
                "DOWNSIZE: shift to a smaller worker node type and/or reduce max workers. Avg CPU = ",
                c("avg_cpu_percent"),
                "%, p95 mem = ",
                c("p95_mem_percent"),
                "%. If usage is bursty and intermittent, consider migrating workloads to a serverless or job cluster.",
            ),
        ),
    ]
    fine = "NO CHANGE: cluster is appropriately sized for its current workload. Continue to monitor."
    return df.withColumn("recommendation", first_match(rules, fine))


def cluster_assessment(
    clusters: DataFrame, nodes: DataFrame, usage: DataFrame, prices: DataFrame, window: Lookback
) -> DataFrame:
    base = cluster_base(clusters, window)
    summary = utilization_summary(utilization_raw(nodes, base, window))
    cost = cluster_cost(usage, prices, base, window).drop("billed_days")
    return with_recommendation(with_reason(categorize(with_flags(base, summary, cost))))


# ---- dashboard datasets over the assessment (one row per cluster) ---------------------


def _is(category: str) -> Column:
    return F.col("utilization_category") == category


def _cost_sum(name: str) -> Column:
    return settled(F.sum("estimated_cost_usd"), 2).alias(name)


def kpis(a: DataFrame) -> DataFrame:
    saved = F.when(_is(UNDER) | _is(IDLE), F.col("estimated_cost_usd") * SAVINGS_SHARE).otherwise(0.0)
    return a.agg(
        F.count(F.lit(1)).alias("total_clusters"),
        F.count_if(_is(OVER)).alias("over_utilized"),
        F.count_if(_is(UNDER)).alias("under_utilized"),
        F.count_if(_is(RIGHT)).alias("right_sized"),
        F.count_if(_is(IDLE)).alias("idle_or_unused"),
        _cost_sum("total_cost_usd"),
        settled(F.sum(saved), 2).alias("estimated_savings_usd"),
        settled(F.sum("total_dbus"), 2).alias("total_dbus"),
    )


def category_distribution(a: DataFrame) -> DataFrame:
    return (
        a.groupBy("utilization_category")
        .agg(F.count(F.lit(1)).alias("cluster_count"), _cost_sum("cost_usd"))
        .orderBy(F.col("cluster_count").desc())
    )


def top_cost(a: DataFrame, n: int = 20) -> DataFrame:
    return (
        a.filter("estimated_cost_usd is not null")
        .orderBy(F.col("estimated_cost_usd").desc(), "cluster_id")
        .limit(n)
        .select(
            "cluster_name",
            "utilization_category",
            settled("estimated_cost_usd", 2).alias("cost_usd"),
            "avg_cpu_percent",
            "p95_cpu_percent",
        )
    )


def scatter(a: DataFrame) -> DataFrame:
    zeroed = ["avg_cpu_percent", "p95_cpu_percent", "estimated_cost_usd", "total_dbus"]
    return a.select(
        "cluster_id",
        "cluster_name",
        "utilization_category",
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in zeroed],
    )


def owners(a: DataFrame, n: int = 25) -> DataFrame:
    return (
        a.filter("owned_by is not null")
        .groupBy("owned_by")
        .agg(
            F.count(F.lit(1)).alias("cluster_count"),
            F.count_if(_is(UNDER)).alias("under_utilized"),
            F.count_if(_is(OVER)).alias("over_utilized"),
            F.count_if(_is(IDLE)).alias("idle_or_unused"),
            _cost_sum("total_cost_usd"),
        )
        .orderBy(F.col("total_cost_usd").desc_nulls_last(), "owned_by")
        .limit(n)
    )


def detail(a: DataFrame) -> DataFrame:
    scaled = _say(F.col("min_autoscale_workers"), " – ", F.col("max_autoscale_workers"), " (autoscale)")
    fixed = _say(F.col("worker_count"), " (fixed)")
    rank = by_value(F.col("utilization_category"), {OVER: 1, UNDER: 2, IDLE: 3}, 4)
    return a.orderBy(rank, F.col("estimated_cost_usd").desc_nulls_last()).select(
        "cluster_name",
        F.col("utilization_category").alias("category"),
        "owned_by",
        "driver_node_type",
        "worker_node_type",
        F.when(F.col("autoscale_enabled"), scaled).otherwise(fixed).alias("worker_config"),
        F.col("auto_termination_minutes").alias("auto_term_min"),
        "active_days",
        "avg_cpu_percent",
        "p95_cpu_percent",
        "p95_mem_percent",
        "idle_percent",
        "p95_active_workers",
        settled("estimated_cost_usd", 2).alias("cost_usd"),
        "reason",
        "recommendation",
    )


def _banded(a: DataFrame, band: Column, name: str, metric: str, out: str) -> DataFrame:
    return (
        a.groupBy(band.alias(name))
        .agg(
            F.count(F.lit(1)).alias("cluster_count"),
            settled(F.avg(metric), 2).alias(out),
            _cost_sum("total_cost_usd"),
        )
        .orderBy(F.col("cluster_count").desc())
    )


def autoscale_status(a: DataFrame) -> DataFrame:
    p95, low, high = F.col("p95_active_workers"), F.col("min_autoscale_workers"), F.col("max_autoscale_workers")
    rules = [
        (~F.col("autoscale_enabled"), "No autoscale (fixed)"),
        (p95 >= high, "Pinned at ceiling"),
        ((p95 <= low) & (low < high), "Stuck at floor"),
    ]
    return _banded(a, first_match(rules, "Scaling normally"), "autoscale_status", "avg_cpu_percent", "avg_cpu")


def termination_bands(a: DataFrame) -> DataFrame:
    minutes = F.col("auto_termination_minutes")
    rules = [
        (minutes.isNull(), "DISABLED (risky)"),
        (minutes <= 30, "<= 30 min (good)"),
        (minutes <= 60, "31 – 60 min (ok)"),
        (minutes <= 120, "61 – 120 min (loose)"),
    ]
    band = first_match(rules, "> 120 min (too loose)")
    return _banded(a, band, "termination_band", "idle_percent", "avg_idle_percent")


def daily_trend(raw: DataFrame) -> DataFrame:
    return (
        raw.groupBy(trunc_ts("day", F.col("start_time")).alias("day"))
        .agg(
            settled(F.avg("cpu_active_percent"), 2).alias("avg_cpu_percent"),
            settled(F.avg("mem_used_percent"), 2).alias("avg_mem_percent"),
            F.countDistinct("cluster_id").alias("active_clusters"),
        )
        .orderBy("day")
    )
