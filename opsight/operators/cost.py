"""Cost of tagged queries on shared warehouses, allocated by share of active time.

Inputs are the flat columns of :mod:`opsight.sources.platform`. Facts are summed to
warehouse-hours before any join, so joins see hours and not statements.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.functions.columns import hour_of, pct, settled
from opsight.functions.relational import (
    as_of_join,
    exact_percentiles,
    interval_join,
    latest_by,
    null_safe_join,
)
from opsight.windows import Lookback, ts_lit

HOUR = ["warehouse_id", "hour_ts"]
CONFIG = ["warehouse_name", "warehouse_size", "warehouse_type", "min_clusters", "max_clusters", "auto_stop_minutes"]


def split_ids(text: str) -> list[str]:
    """A comma-separated id list, cut at the commas and not trimmed."""
    return text.split(",")


def _days(window: Lookback):
    return (window.start.date(), window.as_of.date())


def _on_warehouse(history: DataFrame, window: Lookback) -> DataFrame:
    return history.filter(F.col("warehouse_id").isNotNull() & window.within(F.col("start_time")))


def all_activity(history: DataFrame, window: Lookback) -> DataFrame:
    """Active milliseconds of every statement per warehouse-hour: the denominator."""
    return (
        _on_warehouse(history, window)
        .groupBy("warehouse_id", hour_of(F.col("start_time")).alias("hour_ts"))
        .agg(F.sum("total_duration_ms").alias("total_ms"))
    )


def tagged_activity(
    history: DataFrame, window: Lookback, space_ids: Sequence[str], grain: Sequence[str] = ()
) -> DataFrame:
    """Active milliseconds and statements of the given spaces per warehouse-hour and ``grain``.

    ``grain`` may hold ``usage_date``, ``space_id`` and ``user_email``.
    """
    extra = {
        "usage_date": F.to_date("start_time").alias("usage_date"),
        "space_id": F.col("space_id"),
        "user_email": F.col("executed_by").alias("user_email"),
    }
    return (
        _on_warehouse(history, window)
        .filter(F.col("space_id").isin(list(space_ids)))
        .groupBy("warehouse_id", hour_of(F.col("start_time")).alias("hour_ts"), *[extra[g] for g in grain])
        .agg(F.sum("total_duration_ms").alias("tagged_ms"), F.count(F.lit(1)).alias("tagged_queries"))
    )


def tagged_activity_with_users(history: DataFrame, window: Lookback, space_ids: Sequence[str]) -> DataFrame:
    """Per warehouse-hour and space, with the distinct users and their sorted list.

    Users are reduced to one row per (hour, space, user) before the list is built.
    """
    per_user = tagged_activity(history, window, space_ids, ["space_id", "user_email"])
    return per_user.groupBy(*HOUR, "space_id").agg(
        F.sum("tagged_ms").alias("tagged_ms"),
        F.sum("tagged_queries").alias("tagged_queries"),
        F.count("user_email").alias("active_users"),
        F.array_join(F.array_sort(F.collect_list("user_email")), ", ").alias("user_list"),
    )


def warehouse_billing(usage: DataFrame, prices: DataFrame, window: Lookback) -> DataFrame:
    """Billed units and cost per warehouse-hour at the price valid at usage time.

    Usage rows that share warehouse, product and start time are summed first: they
    have the same price, and the price join then sees far fewer rows.
    """
    keys = ["warehouse_id", "cloud", "sku_name", "usage_start_time"]
    billed = (
        usage.filter(F.col("warehouse_id").isNotNull() & window.within(F.col("usage_start_time")))
        .groupBy(*keys)
        .agg(F.sum("usage_quantity").alias("usage_quantity"))
    )
    priced = interval_join(
        billed,
        prices.select("cloud", "sku_name", "price_effective", "price_start_time", "price_end_time"),
        ["cloud", "sku_name"],
        "usage_start_time",
        "price_start_time",
        "price_end_time",
        _days(window),
        how="inner",
    )
    return priced.groupBy("warehouse_id", hour_of(F.col("usage_start_time")).alias("hour_ts")).agg(
        F.sum("usage_quantity").alias("dbus"),
        F.sum(F.col("usage_quantity") * F.col("price_effective")).alias("cost_usd"),
    )


def warehouse_totals(billing: DataFrame) -> DataFrame:
    """Totals and hourly-rate distribution; a warehouse has at most one row per hour."""
    cost = F.col("cost_usd")
    return billing.groupBy("warehouse_id").agg(
        F.countDistinct("hour_ts").alias("running_hours"),
        settled(F.sum("dbus"), 2).alias("wh_total_dbus"),
        settled(F.sum(cost), 2).alias("wh_total_cost_usd"),
        settled(F.avg(cost), 2).alias("avg_cost_per_hour"),
        settled(F.min(cost), 2).alias("min_cost_per_hour"),
        settled(F.percentile(cost, 0.5), 2).alias("median_cost_per_hour"),
        settled(F.percentile(cost, 0.9), 2).alias("p90_cost_per_hour"),
        settled(F.max(cost), 2).alias("max_cost_per_hour"),
    )


def _shared(tagged: DataFrame, activity: DataFrame, billing: DataFrame) -> DataFrame:
    """Tagged hours that were also active and billed; other hours drop out."""
    return tagged.join(activity.filter("total_ms > 0"), HOUR).join(billing, HOUR)


def _part(amount: str) -> Column:
    return F.col(amount) * F.col("tagged_ms") / F.col("total_ms")


def allocate(
    tagged: DataFrame, activity: DataFrame, billing: DataFrame, by: Sequence[str], prefix: str = "tagged"
) -> DataFrame:
    """Billed amounts of each hour split by share of active time and summed over ``by``."""
    return (
        _shared(tagged, activity, billing)
        .groupBy(*by)
        .agg(
            F.sum("tagged_queries").alias("tagged_queries"),
            settled(F.sum("tagged_ms") / 1000.0, 1).alias("tagged_active_sec"),
            settled(F.sum(_part("dbus")), 4).alias(f"est_{prefix}_dbus"),
            settled(F.sum(_part("cost_usd")), 4).alias(f"est_{prefix}_cost_usd"),
        )
    )


def warehouse_config(warehouses: DataFrame) -> DataFrame:
    return latest_by(warehouses, ["warehouse_id"], ["change_time"]).select("warehouse_id", *CONFIG)


def warehouse_summary(
    history: DataFrame,
    usage: DataFrame,
    prices: DataFrame,
    warehouses: DataFrame,
    window: Lookback,
    space_ids: Sequence[str],
) -> DataFrame:
    """Per warehouse: latest config, bill, rate distribution, and the tagged share of the bill."""
    billing = warehouse_billing(usage, prices, window)
    cost = allocate(
        tagged_activity(history, window, space_ids), all_activity(history, window), billing, ["warehouse_id"]
    ).drop("tagged_active_sec")
    totals = warehouse_totals(billing).withColumnRenamed("avg_cost_per_hour", "avg_cost_per_running_hour")
    return (
        cost.join(totals, "warehouse_id")
        .join(warehouse_config(warehouses), "warehouse_id", "left")
        .withColumn("tagged_pct_of_wh_cost", pct(F.col("est_tagged_cost_usd"), F.col("wh_total_cost_usd"), 4))
        .orderBy(F.col("est_tagged_cost_usd").desc_nulls_last())
    )


def user_daily(
    history: DataFrame, usage: DataFrame, prices: DataFrame, window: Lookback, space_ids: Sequence[str]
) -> DataFrame:
    """Per day, space, user and warehouse: allocated cost and share of the warehouse's day."""
    billing = warehouse_billing(usage, prices, window)
    keys = ["usage_date", "space_id", "user_email", "warehouse_id"]
    tagged = tagged_activity(history, window, space_ids, ["usage_date", "space_id", "user_email"])
    cost = allocate(tagged, all_activity(history, window), billing, keys, "user")
    day = billing.groupBy("warehouse_id", F.to_date("hour_ts").alias("usage_date")).agg(
        F.sum("cost_usd").alias("wh_day_cost")
    )
    return (
        cost.join(day, ["warehouse_id", "usage_date"], "left")
        .withColumn("warehouse_day_cost_usd", settled("wh_day_cost", 2))
        .withColumn("user_pct_of_wh_day_cost", pct(F.col("est_user_cost_usd"), F.col("wh_day_cost"), 4))
        .drop("wh_day_cost")
        .orderBy(F.col("usage_date").desc(), F.col("est_user_cost_usd").desc_nulls_last())
    )


def user_combined(
    history: DataFrame,
    usage: DataFrame,
    prices: DataFrame,
    warehouses: DataFrame,
    window: Lookback,
    space_ids: Sequence[str],
) -> DataFrame:
    """One flat row per space, user and warehouse over the whole window."""
    billing = warehouse_billing(usage, prices, window)
    tagged = tagged_activity(history, window, space_ids, ["space_id", "user_email"])
    cost = allocate(
        tagged, all_activity(history, window), billing, ["space_id", "user_email", "warehouse_id"], "user"
    )
    return (
        cost.join(warehouse_totals(billing).drop("wh_total_dbus"), "warehouse_id")
        .join(warehouse_config(warehouses), "warehouse_id", "left")
        .withColumn("user_pct_of_wh_cost", pct(F.col("est_user_cost_usd"), F.col("wh_total_cost_usd"), 4))
        .drop("warehouse_id")
        .orderBy(F.col("est_user_cost_usd").desc_nulls_last())
    )


def config_at_hour(hours: DataFrame, warehouses: DataFrame, window: Lookback) -> DataFrame:
    """The configuration in force at each warehouse-hour; null columns before the first change."""
    config = ["warehouse_name", "warehouse_size", "min_clusters", "max_clusters", "auto_stop_minutes"]
    changes = warehouses.select("warehouse_id", *config, "change_time")
    return as_of_join(hours, changes, ["warehouse_id"], "hour_ts", "change_time", _days(window))


def hourly_breakdown(
    history: DataFrame,
    usage: DataFrame,
    prices: DataFrame,
    warehouses: DataFrame,
    window: Lookback,
    space_ids: Sequence[str],
) -> DataFrame:
    """One row per warehouse-hour and space, with the configuration of that hour."""
    shared = _shared(
        tagged_activity_with_users(history, window, space_ids),
        all_activity(history, window),
        warehouse_billing(usage, prices, window),
    )
    return (
        config_at_hour(shared, warehouses, window)
        .withColumns(
            {
                "wh_hour_dbus": settled("dbus", 2),
                "wh_hour_cost_usd": settled("cost_usd", 2),
                "all_active_sec": settled(F.col("total_ms") / 1000.0, 1),
                "tagged_active_sec": settled(F.col("tagged_ms") / 1000.0, 1),
                "est_tagged_dbus": settled(_part("dbus"), 4),
                "est_tagged_cost_usd": settled(_part("cost_usd"), 4),
                "tagged_pct_of_hour": pct(F.col("tagged_ms"), F.col("total_ms"), 2),
            }
        )
        .drop("dbus", "cost_usd", "total_ms", "tagged_ms")
        .orderBy(F.col("hour_ts").desc(), "warehouse_id", "space_id")
    )


# ---- rollup tables -------------------------------------------------------------------


def rollup_wh_hourly(history: DataFrame, usage: DataFrame, window: Lookback) -> DataFrame:
    """Warehouse x hour: activity and billed units, for warehouses that saw tagged statements.

    Hours with only one of the two sides stay, with the other side null.
    """
    seen = _on_warehouse(history, window).filter("space_id is not null").select("warehouse_id").distinct()
    active = all_activity(history, window).join(seen, "warehouse_id", "left_semi")
    billed = (
        usage.filter(F.col("warehouse_id").isNotNull() & window.within(F.col("usage_start_time")))
        .groupBy("warehouse_id", hour_of(F.col("usage_start_time")).alias("hour_ts"))
        .agg(F.sum("usage_quantity").alias("dbus"))
        .join(seen, "warehouse_id", "left_semi")
    )
    return active.join(billed, HOUR, "full_outer")


def rollup_space_user_hourly(history: DataFrame, window: Lookback) -> DataFrame:
    return (
        _on_warehouse(history, window)
        .filter("space_id is not null")
        .groupBy(
            "space_id",
            "warehouse_id",
            hour_of(F.col("start_time")).alias("hour_ts"),
            F.col("executed_by").alias("user_email"),
        )
        .agg(F.sum("total_duration_ms").alias("tagged_ms"), F.count(F.lit(1)).alias("tagged_queries"))
    )


def rollup_wh_config(warehouses: DataFrame) -> DataFrame:
    return warehouse_config(warehouses).drop("warehouse_type")


def apply_unit_price(rollup: DataFrame, price: float) -> DataFrame:
    """Dollars at read time: stored units times the caller's unit price."""
    return rollup.withColumn("cost_usd", settled(F.col("dbus") * F.lit(price), 4))


# ---- statement history views ---------------------------------------------------------


def recent_tagged(history: DataFrame, window: Lookback, n: int = 1000) -> DataFrame:
    columns = [
        "statement_id",
        "executed_by",
        "statement_text",
        "space_id",
        "client_application",
        "execution_status",
        "total_duration_ms",
        "start_time",
    ]
    return (
        history.filter(window.since_midnight(F.col("start_time")) & F.col("space_id").isNotNull())
        .select(*[c for c in columns if c in history.columns])
        .orderBy(F.col("start_time").desc(), F.col("statement_id").desc())
        .limit(n)
    )


def user_query_stats(history: DataFrame, window: Lookback) -> DataFrame:
    """Per space and user: counts, success rate, exact duration percentiles, first and last time."""
    keys = ["space_id", "executed_by"]
    tagged = history.filter(window.since_midnight(F.col("start_time")) & F.col("space_id").isNotNull())
    done, failed = F.col("execution_status") == "FINISHED", F.col("execution_status") == "FAILED"
    stats = tagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if(done).alias("successful_queries"),
        F.count_if(failed).alias("failed_queries"),
        pct(F.count_if(done), F.count(F.lit(1)), 1).alias("success_rate_pct"),
        settled(F.avg("total_duration_ms"), 0).alias("avg_duration_ms"),
        F.min("start_time").alias("first_query_time"),
        F.max("start_time").alias("last_query_time"),
    )
    wanted = {"p50_duration_ms": ("total_duration_ms", 0.5), "p95_duration_ms": ("total_duration_ms", 0.95)}
    quantiles = exact_percentiles(tagged, keys, wanted).select(
        *keys, *[settled(c, 0).alias(c) for c in wanted]
    )
    return null_safe_join(stats, quantiles, keys, "left").orderBy(F.col("total_queries").desc())


def task_share(history: DataFrame, window: Lookback) -> DataFrame:
    """Share of a warehouse's task time per user, application and space."""
    keys = ["warehouse_id", "executed_by", "space_id", "client_application"]
    used = (
        history.filter(window.since_midnight(F.col("start_time")) & F.col("warehouse_id").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("query_count"),
            F.sum("total_duration_ms").alias("_wall_ms"),
            F.coalesce(F.sum("total_task_duration_ms"), F.lit(0)).alias("total_task_ms"),
            F.sum("read_bytes").alias("_read"),
        )
    )
    totals = used.groupBy("warehouse_id").agg(F.sum("total_task_ms").alias("_wh_ms")).filter("_wh_ms > 0")
    return (
        used.join(totals, "warehouse_id")
        .withColumns(
            {
                "pct_of_warehouse_cost": pct(F.col("total_task_ms"), F.col("_wh_ms"), 2),
                "task_hours": settled(F.col("total_task_ms") / 1000.0 / 3600.0, 2),
                "read_gb": settled(F.col("_read") / F.lit(1073741824.0), 2),
                "avg_query_duration_ms": settled(F.try_divide(F.col("_wall_ms"), F.col("query_count")), 0),
            }
        )
        .drop("_wall_ms", "_read", "_wh_ms")
        .orderBy("warehouse_id", F.col("pct_of_warehouse_cost").desc())
    )


def attributed_cost(
    history: DataFrame, usage: DataFrame, prices: DataFrame, window: Lookback, space_id: str
) -> DataFrame:
    """A space's users' share of each warehouse's bill, by task time.

    Units are summed per product before prices are joined, and each product has one
    price, so no join multiplies rows; a product without a price costs 0.
    """
    recent = history.filter(window.since_midnight(F.col("start_time")) & F.col("warehouse_id").isNotNull())
    total = recent.groupBy("warehouse_id").agg(F.sum("total_task_duration_ms").alias("_wh_ms"))
    mine = (
        recent.filter(F.col("space_id") == space_id)
        .groupBy("warehouse_id", "executed_by", "space_id")
        .agg(F.sum("total_task_duration_ms").alias("_ms"))
    )
    billed = usage.filter(
        window.since_midnight(F.col("usage_start_time")) & F.col("warehouse_id").isNotNull()
    )
    billed = billed.filter(F.col("billing_origin_product") == "SQL")
    units = billed.groupBy("warehouse_id", "sku_name", "cloud").agg(F.sum("usage_quantity").alias("_units"))
    current = prices.filter(
        F.col("price_end_time").isNull() | (F.col("price_end_time") > ts_lit(window.midnight))
    )
    price = latest_by(current, ["sku_name", "cloud"], ["price_start_time"]).select(
        "sku_name", "cloud", "price_effective"
    )
    bill = (
        units.join(price, ["sku_name", "cloud"], "left")
        .groupBy("warehouse_id")
        .agg(
            F.sum("_units").alias("_wh_units"),
            F.sum(F.col("_units") * F.coalesce("price_effective", F.lit(0.0))).alias("_wh_cost"),
        )
    )
    share = F.col("_ms") / F.col("_wh_ms")
    return (
        mine.join(total.filter("_wh_ms > 0"), "warehouse_id")
        .join(bill, "warehouse_id", "left")
        .select(
            "warehouse_id",
            "executed_by",
            "space_id",
            pct(F.col("_ms"), F.col("_wh_ms"), 2).alias("pct_share_of_warehouse"),
            settled(F.col("_wh_units") * share, 2).alias("attributed_dbus"),
            settled("_wh_cost", 2).alias("warehouse_total_cost_usd"),
            settled(F.col("_wh_cost") * share, 2).alias("attributed_cost_usd"),
        )
        .orderBy(F.col("attributed_cost_usd").desc_nulls_last())
    )

