"""From the platform's nested layout to the flat columns the operators read.

Times become zone-free (the session runs in UTC). Only the fields that are read
reach the scan: these are plain projections that Catalyst prunes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ntz(name: str) -> Column:
    return F.col(name).cast("timestamp_ntz")


def query_history(df: DataFrame, space_field: str = "query_source.space_id") -> DataFrame:
    """Statement history; ``space_field`` is the path of the tag that costs are attributed to."""
    kept = [c for c in ("statement_text", "written_bytes", "spilled_local_bytes") if c in df.columns]
    return df.select(
        "statement_id",
        F.col("compute.warehouse_id").alias("warehouse_id"),
        "executed_by",
        F.col(space_field).alias("space_id"),
        "client_application",
        "execution_status",
        "total_duration_ms",
        "total_task_duration_ms",
        "read_bytes",
        _ntz("start_time").alias("start_time"),
        _ntz("update_time").alias("update_time"),
        *kept,
    )


def usage(df: DataFrame) -> DataFrame:
    return df.select(
        "workspace_id",
        F.col("usage_metadata.warehouse_id").alias("warehouse_id"),
        F.col("usage_metadata.cluster_id").alias("cluster_id"),
        F.col("usage_metadata.job_id").alias("job_id"),
        F.col("usage_metadata.endpoint_id").alias("endpoint_id"),
        "cloud",
        "sku_name",
        "usage_unit",
        "usage_quantity",
        _ntz("usage_start_time").alias("usage_start_time"),
        _ntz("usage_end_time").alias("usage_end_time"),
        "usage_date",
        "billing_origin_product",
    )


def prices(df: DataFrame) -> DataFrame:
    return df.select(
        "cloud",
        "sku_name",
        "usage_unit",
        "currency_code",
        F.col("pricing.default").alias("price_default"),
        F.col("pricing.effective_list.default").alias("price_effective"),
        _ntz("price_start_time").alias("price_start_time"),
        _ntz("price_end_time").alias("price_end_time"),
    )


def nested_history(flat: DataFrame) -> DataFrame:
    """The inverse of :func:`query_history`, to feed flat test tables through it."""
    return flat.select(
        "*",
        F.struct("warehouse_id").alias("compute"),
        F.struct("space_id").alias("query_source"),
    ).drop("warehouse_id", "space_id")


def nested_usage(flat: DataFrame) -> DataFrame:
    ids = ("warehouse_id", "cluster_id", "job_id", "endpoint_id")
    return flat.withColumn("usage_metadata", F.struct(*ids)).drop(*ids)


def nested_prices(flat: DataFrame) -> DataFrame:
    effective = F.struct(F.col("price_effective").alias("default"))
    pricing = F.struct(F.col("price_default").alias("default"), effective.alias("effective_list"))
    return flat.withColumn("pricing", pricing).drop("price_default", "price_effective")


def table_history(df: DataFrame) -> DataFrame:
    """Operation history with its ``operation_metrics`` string map."""
    return df.withColumn("op_ts", _ntz("op_ts"))


# Metric keys of an operation, as the history reports them (fixed values).
M_REMOVED = "numRemovedFiles"
M_TARGET_REMOVED = "numTargetFilesRemoved"
M_ADDED = "numAddedFiles"
M_ROWS = "numOutputRows"


def mapped_history(flat: DataFrame) -> DataFrame:
    """Collect flat metric columns into the string map, absent keys left out."""
    pairs = {M_REMOVED: "m_removed", M_TARGET_REMOVED: "m_target_removed", M_ADDED: "m_added", M_ROWS: "m_rows"}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in pairs.items()])
    present = F.filter(entries, lambda e: e["value"].isNotNull())
    return flat.withColumn("operation_metrics", F.map_from_entries(present)).drop(*pairs.values())


def table_detail(flat: DataFrame) -> DataFrame:
    """Comma-joined column lists to arrays; times zone-free."""
    to_list = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return flat.withColumns(
        {
            "partition_columns": to_list(F.col("partition_columns")),
            "clustering_columns": to_list(F.col("clustering_columns")),
            "last_modified": _ntz("last_modified"),
        }
    )
