"""Right-sizing advisor: a second, separate rule set over all clusters, with exact percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.functions.columns import hour_of, settled, text_or
from opsight.functions.relational import exact_percentiles, interval_join, latest_by
from opsight.functions.rules import fired, first_match
from opsight.windows import Lookback

CLUSTER = ["workspace_id", "cluster_id"]


def _busy(nodes: DataFrame, window: Lookback) -> DataFrame:
    """Node samples of the window; the CPU sum is null when a part is missing."""
    cpu = F.col("cpu_user_percent") + F.col("cpu_system_percent")
    return nodes.filter(window.since(F.col("start_time"))).withColumn("cpu_busy_percent", cpu)


def advisor_stats(nodes: DataFrame, window: Lookback, min_samples: int = 10) -> DataFrame:
    """Per cluster with at least ``min_samples`` samples."""
    busy = _busy(nodes, window)
    stats = (
        busy.groupBy(*CLUSTER)
        .agg(
            F.count(F.lit(1)).alias("sample_count"),
            F.countDistinct("instance_id").alias("distinct_instances"),
            F.avg("cpu_busy_percent").alias("avg_cpu_busy_pct"),
            F.max("cpu_busy_percent").alias("max_cpu_busy_pct"),
            F.avg("mem_used_percent").alias("avg_mem_used_pct"),
            F.max("mem_used_percent").alias("max_mem_used_pct"),
            F.avg("mem_swap_percent").alias("avg_mem_swap_pct"),
            F.max("mem_swap_percent").alias("max_mem_swap_pct"),
            F.min("start_time").alias("first_sample"),
            F.max("start_time").alias("last_sample"),
        )
        .filter(F.col("sample_count") >= min_samples)
    )
    quantiles = exact_percentiles(
        busy,
        CLUSTER,
        {
            "p50_cpu_busy_pct": ("cpu_busy_percent", 0.5),
            "p95_cpu_busy_pct": ("cpu_busy_percent", 0.95),
            "p95_mem_used_pct": ("mem_used_percent", 0.95),
        },
    )
    return stats.join(quantiles, CLUSTER, "left")


def _priced(usage: DataFrame, prices: DataFrame, window: Lookback, keys: list[str]) -> DataFrame:
    """Usage summed per key, product and start time, with the list price in USD at that time."""
    grain = [*keys, "cloud", "sku_name", "usage_start_time"]
    billed = usage.groupBy(*grain).agg(F.sum("usage_quantity").alias("usage_quantity"))
    dollars = prices.filter(F.col("currency_code") == "USD").select(
        "cloud", "sku_name", "price_default", "price_start_time", "price_end_time"
    )
    priced = interval_join(
        billed,
        dollars,
        ["cloud", "sku_name"],
        "usage_start_time",
        "price_start_time",
        "price_end_time",
        (window.start.date(), window.as_of.date()),
    )
    return priced.withColumn("cost", F.col("usage_quantity") * F.coalesce("price_default", F.lit(0.0)))


def cluster_spend(usage: DataFrame, prices: DataFrame, window: Lookback) -> DataFrame:
    """Units and list cost per cluster, with the jobs and all-purpose parts of the units."""
    mine = usage.filter(F.col("cluster_id").isNotNull() & window.since(F.col("usage_start_time")))
    quantity, sku = F.col("usage_quantity"), F.col("sku_name")
    return (
        _priced(mine, prices, window, CLUSTER)
        .groupBy(*CLUSTER)
        .agg(
            F.sum(quantity).alias("dbus"),
            F.sum("cost").alias("list_cost_usd"),
            F.sum(F.when(sku.ilike("%JOBS%"), quantity).otherwise(0.0)).alias("jobs_dbus"),
            F.sum(F.when(sku.ilike("%ALL_PURPOSE%"), quantity).otherwise(0.0)).alias("allpurpose_dbus"),
        )
    )


def per_cluster_utilization(
    nodes: DataFrame,
    clusters: DataFrame,
    usage: DataFrame,
    prices: DataFrame,
    window: Lookback,
    min_samples: int = 10,
) -> DataFrame:
    """Verdict, estimated waste and one recommendation per cluster. The texts are fixed values."""
    tie = ["o_key"] if "o_key" in clusters.columns else []
    config = latest_by(clusters, CLUSTER, ["change_time", *tie]).select(
        *CLUSTER,
        "cluster_name",
        "owned_by",
        "cluster_source",
        "driver_node_type",
        "worker_node_type",
        "worker_count",
        "min_autoscale_workers",
        "max_autoscale_workers",
        "auto_termination_minutes",
    )
    c = F.col
    cpu, p95, mem, p95_mem, swap = (
        c("avg_cpu_busy_pct"),
        c("p95_cpu_busy_pct"),
        c("avg_mem_used_pct"),
        c("p95_mem_used_pct"),
        c("max_mem_swap_pct"),
    )
    cost, term = F.coalesce("list_cost_usd", F.lit(0.0)), c("auto_termination_minutes")
    quiet = (cpu < 20) & (p95 < 40) & (mem < 50)
    verdict = first_match(
        [
            ((swap > 1) | (p95_mem > 90) | (p95 > 90), "OVER_UTILIZED"),
            (quiet, "UNDER_UTILIZED"),
            (cpu.between(20, 80) & (p95 < 95), "RIGHT_SIZED"),
        ],
        "REVIEW",
    )
    advice = first_match(
        [
            (
                swap > 1,
                "Memory pressure (swap > 1%). Move to memory-optimized worker type or add workers.",
            ),
            (p95_mem > 90, "p95 memory > 90%. Move to a larger memory-optimized instance type."),
            (
                p95 > 90,
                "p95 CPU > 90%. Raise max workers or move to a larger compute-optimized instance type.",
            ),
            (
                (cpu < 20) & (p95 < 40),
                "Low CPU. Consider Serverless, smaller node type, lower max_autoscale_workers, or shorter auto_termination.",
            ),
            (
                term.isNull() | (term > 60),
                "auto_termination_minutes high or unset. Reduce to <= 60 for interactive clusters.",
            ),
        ],
        "Healthy. Continue monitoring.",
    )
    waste = F.when(quiet, settled(cost * (1 - cpu / 100.0) * 0.6, 2)).otherwise(0.0)
    tenths = ["avg_cpu_busy_pct", "p50_cpu_busy_pct", "p95_cpu_busy_pct", "max_cpu_busy_pct"]
    tenths += ["avg_mem_used_pct", "p95_mem_used_pct", "max_mem_used_pct"]
    return (
        advisor_stats(nodes, window, min_samples)
        .join(config, CLUSTER, "left")
        .join(cluster_spend(usage, prices, window), CLUSTER, "left")
        .withColumns({"utilization_verdict": verdict, "estimated_waste_usd": waste, "recommendation": advice})
        .select(
            *config.columns,
            "sample_count",
            "distinct_instances",
            *[settled(name, 1).alias(name) for name in tenths],
            settled(swap, 2).alias("max_mem_swap_pct"),
            F.coalesce("dbus", F.lit(0.0)).alias("dbus_consumed"),
            settled(cost, 2).alias("list_cost_usd"),
            F.coalesce("jobs_dbus", F.lit(0.0)).alias("jobs_dbus"),
            F.coalesce("allpurpose_dbus", F.lit(0.0)).alias("allpurpose_dbus"),
            "utilization_verdict",
            "estimated_waste_usd",
            "recommendation",
            "first_sample",
            "last_sample",
        )
    )


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def rightsizing(utilization: DataFrame, node_types: DataFrame) -> DataFrame:
    """Reasons, target worker count (about 60 % CPU) and an action. The texts are fixed values."""
    c = F.col
    specs = node_types.select(
        c("node_type").alias("worker_node_type"),
        c("core_count").alias("worker_cores"),
        settled(c("memory_mb") / 1024.0, 1).alias("worker_memory_gb"),
    )
    cpu, p95, mem, p95_mem, swap = (
        c("avg_cpu_busy_pct"),
        c("p95_cpu_busy_pct"),
        c("avg_mem_used_pct"),
        c("p95_mem_used_pct"),
        c("max_mem_swap_pct"),
    )
    term = c("auto_termination_minutes")
    loose = term.isNull() | (term > 60)
    top = F.coalesce("max_autoscale_workers", "worker_count")
    target = F.greatest(F.lit(1), F.ceil(F.coalesce(top, F.lit(1)) * (cpu / 60.0)))
    grown = top + F.greatest(F.lit(1), F.ceil(top * F.lit(0.5)))
    under = c("utilization_verdict") == "UNDER_UTILIZED"
    reasons = fired(
        [
            (cpu < 20, "avg CPU < 20% (idle)"),
            (p95 < 40, "p95 CPU < 40% (no bursts)"),
            (mem < 50, "avg memory < 50% (RAM headroom)"),
            (p95 > 90, "p95 CPU > 90% (CPU-bound)"),
            (p95_mem > 90, "p95 memory > 90% (memory-bound)"),
            (swap > 1, "swap > 1% (memory pressure)"),
            (loose, _say("auto_termination = ", text_or(term, "unset"), " min (high)")),
        ],
        " | ",
    )
    cores, memory = text_or(c("worker_cores"), "?"), text_or(c("worker_memory_gb"), "?")
    top_text, node = text_or(top, "?"), text_or(c("worker_node_type"), "unknown")
    smaller = F.when(
        (mem < 30) & (c("worker_cores") >= 8),
        _say(
            "Both CPU and memory are low; consider downsizing node type from ",
            text_or(c("worker_node_type"), "current"),
            " to a smaller tier.",
        ),
    ).otherwise("Keep worker node type the same.")
    shorter = F.when(
        loose, _say(" Also reduce auto_termination from ", text_or(term, "unset"), " min to 60.")
    ).otherwise("")
    action = first_match(
        [
            (
                (swap > 1) | (p95_mem > 90),
                _say(
                    "Memory-bound. Move to a memory-optimized worker type (e.g., r-family) or increase worker count from ",
                    top_text,
                    " to ",
                    text_or(grown, "?"),
                    ". Current: ",
                    node,
                    " (",
                    cores,
                    " vCPU / ",
                    memory,
                    " GB).",
                ),
            ),
            (
                p95 > 90,
                _say(
                    "CPU-bound. Raise max_autoscale_workers from ",
                    top_text,
                    " to ",
                    text_or(top * 2, "?"),
                    ", or move to a compute-optimized worker (e.g., c-family). Current: ",
                    node,
                    " (",
                    cores,
                    " vCPU).",
                ),
            ),
            (
                (cpu < 10) & (p95 < 30),
                _say(
                    "Mostly idle (avg ",
                    settled(cpu, 1),
                    "%, p95 ",
                    settled(p95, 1),
                    "%). Strongly consider Serverless or shutting down. If kept, reduce max workers from ",
                    top_text,
                    " to ",
                    target,
                    ".",
                ),
            ),
            (
                under,
                _say(
                    "Reduce max_autoscale_workers from ",
                    top_text,
                    " to ",
                    target,
                    " (targets ~60% avg CPU). ",
                    smaller,
                    shorter,
                ),
            ),
            (
                loose,
                _say(
                    "Healthy CPU/memory. Reduce auto_termination from ",
                    text_or(term, "unset"),
                    " min to 60 to free idle time.",
                ),
            ),
        ],
        "Within healthy utilization band. No action needed.",
    )
    return utilization.join(specs, "worker_node_type", "left").select(
        *CLUSTER,
        "cluster_name",
        "owned_by",
        "cluster_source",
        "utilization_verdict",
        reasons.alias("reasons"),
        c("worker_node_type").alias("current_worker_type"),
        c("worker_cores").alias("current_worker_cores"),
        c("worker_memory_gb").alias("current_worker_memory_gb"),
        c("worker_count").alias("current_worker_count"),
        c("min_autoscale_workers").alias("current_min_workers"),
        c("max_autoscale_workers").alias("current_max_workers"),
        term.alias("current_auto_term_minutes"),
        "avg_cpu_busy_pct",
        "p95_cpu_busy_pct",
        "avg_mem_used_pct",
        "p95_mem_used_pct",
        "max_mem_swap_pct",
        "list_cost_usd",
        "estimated_waste_usd",
        F.when(under, target).alias("recommended_workers"),
        action.alias("recommended_action"),
        _say("#setting/clusters/", c("cluster_id"), "/configuration").alias("cluster_config_path"),
    )


def hourly_utilization(nodes: DataFrame, window: Lookback) -> DataFrame:
    """Per cluster and hour. A group is one cluster's nodes times 60 minutes, so the
    built-in exact percentile holds little."""
    return (
        _busy(nodes, window)
        .groupBy(*CLUSTER, hour_of(F.col("start_time")).alias("hour_bucket"))
        .agg(
            F.avg("cpu_busy_percent").alias("avg_cpu_busy_pct"),
            F.percentile("cpu_busy_percent", 0.95).alias("p95_cpu_busy_pct"),
            F.avg("mem_used_percent").alias("avg_mem_used_pct"),
            F.percentile("mem_used_percent", 0.95).alias("p95_mem_used_pct"),
            F.max("mem_swap_percent").alias("max_mem_swap_pct"),
            F.countDistinct("instance_id").alias("active_instances"),
        )
    )


def per_job_utilization(
    usage: DataFrame, prices: DataFrame, jobs: DataFrame, utilization: DataFrame, window: Lookback
) -> DataFrame:
    """Job cost with the verdict of the cluster it ran on and the newest job name."""
    mine = usage.filter(
        F.col("job_id").isNotNull()
        & window.since(F.col("usage_start_time"))
        & F.col("sku_name").ilike("%JOBS%")
    )
    spent = (
        _priced(mine, prices, window, ["workspace_id", "job_id", "cluster_id"])
        .groupBy("workspace_id", "job_id", "cluster_id")
        .agg(
            settled(F.sum("usage_quantity"), 2).alias("dbus"),
            settled(F.sum("cost"), 2).alias("list_cost_usd"),
        )
    )
    names = latest_by(jobs, ["workspace_id", "job_id"], ["change_time", "name"]).select(
        "workspace_id", "job_id", F.col("name").alias("job_name")
    )
    verdicts = utilization.select(
        *CLUSTER,
        "utilization_verdict",
        "recommendation",
        "avg_cpu_busy_pct",
        "p95_cpu_busy_pct",
        "avg_mem_used_pct",
        "p95_mem_used_pct",
        "estimated_waste_usd",
    )
    return spent.join(names, ["workspace_id", "job_id"], "left").join(verdicts, CLUSTER, "left")


_TOP = ["cluster_id", "cluster_name", "cluster_source", "worker_node_type", "worker_count"]


def _top(utilization: DataFrame, verdict: str, order: str, columns: list[str], n: int) -> DataFrame:
    return (
        utilization.filter(F.col("utilization_verdict") == verdict)
        .orderBy(F.col(order).desc(), "workspace_id", "cluster_id")
        .limit(n)
        .select(*columns)
    )


def top_waste(utilization: DataFrame, n: int = 25) -> DataFrame:
    metrics = ["avg_cpu_busy_pct", "p95_cpu_busy_pct", "avg_mem_used_pct", "list_cost_usd"]
    columns = [*_TOP, *metrics, "estimated_waste_usd", "recommendation"]
    return _top(utilization, "UNDER_UTILIZED", "estimated_waste_usd", columns, n)


def top_pressure(utilization: DataFrame, n: int = 25) -> DataFrame:
    metrics = ["p95_cpu_busy_pct", "p95_mem_used_pct", "max_mem_swap_pct", "list_cost_usd"]
    return _top(utilization, "OVER_UTILIZED", "list_cost_usd", [*_TOP, *metrics, "recommendation"], n)


def verdict_summary(utilization: DataFrame) -> DataFrame:
    return (
        utilization.groupBy("utilization_verdict")
        .agg(
            F.count(F.lit(1)).alias("cluster_count"),
            settled(F.sum("list_cost_usd"), 2).alias("list_cost_usd"),
            settled(F.sum("estimated_waste_usd"), 2).alias("estimated_waste_usd"),
        )
        .orderBy(F.col("list_cost_usd").desc())
    )
