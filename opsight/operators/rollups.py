"""Hourly rollups that are kept up to date by rewriting the days that new or late rows fall on.

What an hour holds depends on rows of that hour alone, so the days touched by a load can be built again
from the facts of those days. Which warehouses count (those that ever saw tagged statements) does not
depend on the hour, so that rule is applied when a rollup is read, not stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.functions.columns import hour_of
from opsight.sources.day_tables import DayTable, days_of

HOUR = ["warehouse_id", "hour_ts"]


def wh_hourly(history: DataFrame, usage: DataFrame) -> DataFrame:
    """Warehouse x hour: active milliseconds, statements and billed units; a side without rows is null."""
    active = (
        history.filter("warehouse_id is not null and start_time is not null")
        .groupBy("warehouse_id", hour_of(F.col("start_time")).alias("hour_ts"))
        .agg(F.sum("total_duration_ms").alias("total_ms"), F.count(F.lit(1)).alias("statements"))
    )
    billed = (
        usage.filter("warehouse_id is not null and usage_start_time is not null")
        .groupBy("warehouse_id", hour_of(F.col("usage_start_time")).alias("hour_ts"))
        .agg(F.sum(F.col("usage_quantity").cast("decimal(38,9)")).alias("dbus"))
    )
    return active.join(billed, HOUR, "full_outer")


def space_user_hourly(history: DataFrame) -> DataFrame:
    """Space x warehouse x hour x user: tagged milliseconds and statements."""
    tagged = history.filter("warehouse_id is not null and space_id is not null and start_time is not null")
    keys = ["space_id", "warehouse_id", hour_of(F.col("start_time")).alias("hour_ts"), F.col("executed_by").alias("user_email")]
    return tagged.groupBy(*keys).agg(
        F.sum("total_duration_ms").alias("tagged_ms"), F.count(F.lit(1)).alias("tagged_queries")
    )


@dataclass
class CostRollups:
    """Facts and their two hourly rollups, each in a folder per day."""

    history: DayTable
    usage: DayTable
    by_warehouse: DayTable
    by_user: DayTable

    def load(self, history: DataFrame, usage: DataFrame) -> list:
        """Add facts, however late, and rewrite the rollups of the days they fall on; gives those days.

        Loading stops and starts between the steps without harm: rollups of a day are built from all facts
        of the day, so building them again gives the same. A load that broke off is repaired by
        ``refresh`` with its days.
        """
        days = sorted({*days_of(history, "start_time"), *days_of(usage, "usage_start_time")})
        self.history.append(history)
        self.usage.append(usage)
        self.refresh(days, history.schema, usage.schema)
        return days

    def refresh(self, days: list, history_schema, usage_schema) -> None:
        if not days:
            return
        facts = self.history.of_days(days, history_schema)
        self.by_warehouse.replace_days(wh_hourly(facts, self.usage.of_days(days, usage_schema)))
        self.by_user.replace_days(space_user_hourly(facts))

    def warehouse_hours(self) -> DataFrame:
        """The stored hours of warehouses that saw tagged statements."""
        seen = self.by_user.read().select("warehouse_id").distinct()
        return self.by_warehouse.read().drop("day").join(seen, "warehouse_id", "left_semi")

    def user_hours(self) -> DataFrame:
        return self.by_user.read().drop("day")
