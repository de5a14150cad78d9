"""Version history of tables: churn, vacuum priority, storage class, generated commands."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.functions.columns import micros, settled
from opsight.functions.rules import by_value, first_match
from opsight.windows import ts_lit

# Row-count keys in order of preference, and location patterns.
ROW_KEYS = [
    "numOutputRows",
    "numRecords",
    "numRows",
    "numTargetRowsInserted",
    "numTargetRowsUpdated",
    "numTargetRowsCopied",
]
MOUNTS = ["dbfs:/mnt/", "/dbfs/mnt/"]
CLOUD = ["abfss://", "wasbs://", "wasb://"]
DAY_MICROS = 86_400_000_000


def _any(text: Column, needles: list[str]) -> Column:
    cond = text.contains(needles[0])
    for needle in needles[1:]:
        cond = cond | text.contains(needle)
    return cond


def with_storage_class(df: DataFrame, location: str = "location") -> DataFrame:
    """Storage label and managed / mount marks of a location.

    Only mounts and the listed cloud schemes are external; every other location,
    other clouds included, counts as managed. A blank location is external.
    """
    text = F.lower(F.coalesce(F.col(location), F.lit("")))
    blank, mount = text == "", _any(text, MOUNTS)
    cloud = ~mount & _any(text, CLOUD)
    label = first_match([(blank, "External"), (mount, "Azure Mount Point"), (cloud, "Azure External")], "Managed")
    return df.withColumns(
        {
            "storage_type": label,
            "is_managed_storage": ~blank & ~mount & ~cloud,
            "is_mount_point": mount,
        }
    )


def _whole_days(later: Column, earlier: Column) -> Column:
    return F.floor((micros(later) - micros(earlier)) / F.lit(float(DAY_MICROS)))


def version_analysis(
    history: DataFrame, detail: DataFrame, as_of: datetime, min_versions: int = 5, managed_only: bool = False
) -> DataFrame:
    """One row per table with more than one version.

    The history is first reduced to one row per (table, operation), then to one per
    table, so a table with a very long history is summed in many tasks. If either file
    count of an entry is no number, the entry adds nothing.
    """
    metrics = F.col("operation_metrics")
    added = F.coalesce(metrics.getItem("numAddedFiles"), F.lit("0")).try_cast("bigint")
    removed = F.coalesce(metrics.getItem("numRemovedFiles"), F.lit("0")).try_cast("bigint")
    good = added.isNotNull() & removed.isNotNull()
    rows = F.coalesce(*[metrics.getItem(k) for k in ROW_KEYS]).try_cast("bigint")
    entry = F.struct("version", "operation", "user_name", "op_ts", rows.alias("rows"))
    per_op = history.groupBy("table_name", "operation").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(good, added).otherwise(0)).alias("added"),
        F.sum(F.when(good, removed).otherwise(0)).alias("removed"),
        F.max_by(entry, "version").alias("newest"),
        F.min_by(F.col("op_ts"), "version").alias("oldest_ts"),
        F.min("version").alias("oldest_version"),
    )
    ops = F.array_sort(
        F.collect_list(F.struct((-F.col("newest.version")).alias("order"), "operation", "n"))
    )
    shown = F.concat(
        F.lit("{"),
        F.array_join(F.transform("_ops", lambda o: F.format_string("'%s': %d", o["operation"], o["n"])), ", "),
        F.lit("}"),
    )
    per_table = (
        per_op.groupBy("table_name")
        .agg(
            F.sum("n").alias("version_count"),
            F.sum("added").alias("total_files_added"),
            F.sum("removed").alias("total_files_removed"),
            F.max_by("newest", "newest.version").alias("_last"),
            F.min_by("oldest_ts", "oldest_version").alias("oldest_version_timestamp"),
            ops.alias("_ops"),
        )
        .filter("version_count > 1")
    )
    sizes = detail.select("table_name", F.col("schema_name").alias("database"), "location", "size_in_bytes")
    size = F.col("size_in_bytes")
    analyzed = (
        with_storage_class(per_table.join(sizes, "table_name"))
        .withColumns(
            {
                "latest_version": F.col("_last.version"),
                "latest_operation": F.col("_last.operation"),
                "last_modified_by": F.col("_last.user_name"),
                "last_modified_timestamp": F.col("_last.op_ts"),
                "latest_row_count": F.col("_last.rows"),
                "days_since_modification": _whole_days(ts_lit(as_of), F.col("_last.op_ts")).cast("int"),
                "version_span_days": _whole_days(F.col("_last.op_ts"), F.col("oldest_version_timestamp")).cast("int"),
                "table_size_bytes": size,
                "table_size_mb": F.when(size != 0, settled(size / (1024.0 * 1024.0), 2)),
                "potential_vacuum_files": F.col("total_files_removed"),
                "operation_summary": shown,
            }
        )
        .withColumnsRenamed({"location": "table_location"})
        .drop("_last", "_ops", "size_in_bytes")
    )
    if managed_only:
        analyzed = analyzed.filter("is_managed_storage")
    return by_priority(vacuum_priority(analyzed, min_versions))


def vacuum_priority(df: DataFrame, min_versions: int = 5) -> DataFrame:
    enough, files = F.col("version_count") >= min_versions, F.col("potential_vacuum_files")
    rules = [(enough & (files > 100), "HIGH"), (enough & (files > 50), "MEDIUM")]
    return df.withColumn("vacuum_priority", first_match(rules, "LOW"))


def by_priority(df: DataFrame) -> DataFrame:
    rank = by_value(F.col("vacuum_priority"), {"HIGH": 1, "MEDIUM": 2}, 3)
    return df.orderBy(rank, F.col("version_count").desc())


def priority_distribution(analysis: DataFrame) -> DataFrame:
    return analysis.groupBy("vacuum_priority").agg(F.count(F.lit(1)).alias("count")).orderBy("vacuum_priority")


def top_versions(analysis: DataFrame, n: int = 10) -> DataFrame:
    columns = ["database", "table_name", "version_count", "potential_vacuum_files", "vacuum_priority"]
    return analysis.select(*columns).orderBy(F.col("version_count").desc(), "table_name").limit(n)


def version_statistics(analysis: DataFrame) -> DataFrame:
    return analysis.agg(
        F.avg("version_count").alias("avg_versions"),
        F.max("version_count").alias("max_versions"),
        F.sum("potential_vacuum_files").alias("total_potential_vacuum_files"),
        F.sum("table_size_mb").alias("total_size_mb"),
    )


def maintenance_commands(analysis: DataFrame, catalog: str, retain_hours: int = 168) -> DataFrame:
    """High-priority tables with the command text to run. The wording is a fixed value."""
    name = F.concat_ws(".", F.lit(catalog), "database", "table_name")
    retain = f" RETAIN {retain_hours} HOURS"
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("-- "), name),
        F.format_string(
            "-- Versions: %d, Potential files to remove: %d", "version_count", "potential_vacuum_files"
        ),
        F.concat(F.lit("VACUUM "), name, F.lit(f"{retain};")),
        F.concat(F.lit("-- To perform dry run first: VACUUM "), name, F.lit(f"{retain} DRY RUN;")),
    )
    return analysis.filter("vacuum_priority = 'HIGH'").select(
        "database", "table_name", "version_count", "potential_vacuum_files", text.alias("command")
    )
