"""Table maintenance: which tables to vacuum, storage health, and the maintenance report.

All tables are analyzed at once from exported relations (one row per table, per history
entry, per metric, per property) instead of one command after another per table.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.functions.columns import days_between, settled
from opsight.functions.rules import fired, first_match
from opsight.windows import ts_lit

# Metric keys, property keys and byte units.
REMOVED_KEYS = ["numRemovedFiles", "numTargetFilesRemoved"]
STORAGE_METRICS = ["total_bytes", "active_bytes", "vacuumable_bytes", "time_travel_bytes"]
PROPERTY_COLUMNS = {
    "delta_deletion_vectors": "delta.enableDeletionVectors",
    "delta_auto_optimize": "delta.autoOptimize.optimizeWrite",
    "delta_auto_compact": "delta.autoOptimize.autoCompact",
    "delta_log_retention": "delta.logRetentionDuration",
    "delta_deleted_file_retention": "delta.deletedFileRetentionDuration",
    "delta_checkpoint_interval": "delta.checkpointInterval",
    "delta_data_skipping_cols": "delta.dataSkippingNumIndexedCols",
    "delta_append_only": "delta.appendOnly",
    "delta_target_file_size": "delta.targetFileSize",
    "delta_tune_file_sizes": "delta.tuneFileSizesForRewrites",
}
WRITE_OPS = ["WRITE", "MERGE", "DELETE", "UPDATE", "CREATE TABLE", "CREATE TABLE AS SELECT"]
MB, GB, TB = 1024.0**2, 1024.0**3, 1024.0**4
NEVER_VACUUMED_DAYS, MAX_AGE_DAYS = 30.0, 365.0


# ---- scope ---------------------------------------------------------------------------


def _names(spark: SparkSession, values: Sequence[str], column: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in dict.fromkeys(values)], f"{column} string")


def parse_schemas(text: str) -> list[str] | None:
    """``ALL`` or blank means every schema; else a comma-separated list, trimmed."""
    if not text.strip() or text.strip().upper() == "ALL":
        return None
    return [part.strip() for part in text.split(",") if part.strip()]


def table_scope(
    tables: DataFrame,
    schemas: Sequence[str] | None = None,
    table_type: str = "EXTERNAL",
    data_format: str = "DELTA",
) -> DataFrame:
    kept = tables.filter(
        (F.col("table_type") == table_type)
        & (F.upper("data_source_format") == data_format)
        & (F.lower("schema_name") != "information_schema")
    )
    return kept.filter(F.col("schema_name").isin(list(schemas))) if schemas is not None else kept


def missing_schemas(tables: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Requested schemas that do not exist."""
    return _names(tables.sparkSession, wanted, "schema_name").join(
        tables.select("schema_name").distinct(), "schema_name", "left_anti"
    )


def db_scope(databases: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Databases to scan: the include list if any, less the exclude list."""
    kept = databases
    if include:
        kept = kept.filter(F.col("schema_name").isin(list(include)))
    return kept.filter(~F.col("schema_name").isin(list(exclude))) if exclude else kept


# ---- vacuum candidates ---------------------------------------------------------------


def last_vacuum(history: DataFrame) -> DataFrame:
    """Newest ``VACUUM END`` per table; null for tables never vacuumed."""
    ended = F.when(F.col("operation") == "VACUUM END", F.col("op_ts"))
    return history.groupBy("table_name").agg(F.max(ended).alias("last_vacuum_ts"))


def _metric(key: str) -> Column:
    return F.col("operation_metrics").getItem(key).try_cast("bigint")


def removable_since(history: DataFrame, vacuumed: DataFrame) -> DataFrame:
    """Files tombstoned after the last vacuum, and the operations that reported any.

    Vacuum rows are left out: their numbers are files already deleted. Both keys add
    up when an operation reports both; text that is no number is ignored.
    """
    parsed = [_metric(k) for k in REMOVED_KEYS]
    files = reduce(lambda x, y: x + y, [F.coalesce(m, F.lit(0)) for m in parsed])
    counted = F.coalesce(*parsed).isNotNull()
    ops = (
        history.filter(~F.coalesce("operation", F.lit("")).startswith("VACUUM"))
        .withColumns({"_files": files, "_counted": counted})
        .filter("_counted")
        .select("table_name", "op_ts", "_files")
    )
    after = F.col("last_vacuum_ts").isNull() | (F.col("op_ts") > F.col("last_vacuum_ts"))
    return (
        ops.join(vacuumed, "table_name", "left")
        .filter(after)
        .groupBy("table_name")
        .agg(F.sum("_files").alias("removable_files"), F.count(F.lit(1)).alias("ops_since_last_vacuum"))
    )


def estimate_removable(df: DataFrame) -> DataFrame:
    """The dry run's number where it worked, else the history's, whatever the table's size."""
    fallback = F.concat(F.lit("history_fallback ("), F.col("dry_run_error"), F.lit(")"))
    method = first_match(
        [(F.col("dry_run_files").isNotNull(), "dry_run"), (F.col("dry_run_error").isNotNull(), fallback)], "history"
    )
    files = F.coalesce("dry_run_files", "removable_files", F.lit(0))
    return df.withColumn("estimation_method", method).withColumn("est_files_to_clean", files)


def candidate_score(df: DataFrame, as_of: datetime) -> DataFrame:
    """Files times an age factor; the reason names what counted. The texts are fixed values."""
    age = F.coalesce("days_since_last_vacuum", F.lit(NEVER_VACUUMED_DAYS))
    files, ops = F.col("est_files_to_clean"), F.col("ops_since_last_vacuum")
    aged = F.format_string("last VACUUM %.1fd ago", settled(age, 1))
    reason = fired(
        [
            (~F.col("ever_vacuumed"), "never vacuumed"),
            (F.col("ever_vacuumed"), aged),
            (files > 0, F.concat(F.lit("~"), F.format_number(files, 0), F.lit(" removable files"))),
            (
                ops > 0,
                F.concat(
                    ops.cast("string"),
                    F.lit(" mutating op(s) since last VACUUM (VACUUM ops excluded to prevent double-counting)"),
                ),
            ),
        ],
        "; ",
    )
    factor = 1.0 + F.least(age, F.lit(MAX_AGE_DAYS)) / 30.0
    return df.withColumn("candidate_score", files * factor).withColumn("reason", reason)


CANDIDATE_COLUMNS = [
    "catalog",
    "schema",
    "table",
    "full_name",
    "is_delta",
    "size_bytes",
    "num_files",
    "last_vacuum_ts",
    "days_since_last_vacuum",
    "ever_vacuumed",
    "ops_since_last_vacuum",
    "est_files_to_clean",
    "estimation_method",
    "candidate_score",
    "reason",
    "error",
    "analyzed_at",
]


def vacuum_candidates(
    scope: DataFrame,
    detail: DataFrame,
    history: DataFrame,
    dry_run: DataFrame,
    as_of: datetime,
    catalog: str,
) -> DataFrame:
    """One row per table in scope, best candidate first; a table without detail keeps an error row."""
    vacuumed = last_vacuum(history)
    sizes = detail.select(
        "table_name",
        F.coalesce("size_in_bytes", F.lit(0)).cast("bigint").alias("size_bytes"),
        F.coalesce("num_files", F.lit(0)).cast("bigint").alias("num_files"),
        F.lit(True).alias("_described"),
    )
    joined = (
        scope.select("table_name", "schema_name")
        .join(sizes, "table_name", "left")
        .join(vacuumed, "table_name", "left")
        .join(removable_since(history, vacuumed), "table_name", "left")
        .join(dry_run.select("table_name", "dry_run_files", "dry_run_error"), "table_name", "left")
        .withColumns(
            {
                "ever_vacuumed": F.col("last_vacuum_ts").isNotNull(),
                "days_since_last_vacuum": days_between(ts_lit(as_of), F.col("last_vacuum_ts")),
                "ops_since_last_vacuum": F.coalesce("ops_since_last_vacuum", F.lit(0)).cast("int"),
            }
        )
    )
    scored = candidate_score(estimate_removable(joined), as_of)
    known = F.col("_described").isNotNull()
    blanked = [c for c in CANDIDATE_COLUMNS[7:15] if c != "days_since_last_vacuum"] + ["days_since_last_vacuum"]
    return (
        scored.withColumns({c: F.when(known, F.col(c)) for c in blanked})
        .withColumns(
            {
                "catalog": F.lit(catalog),
                "schema": F.col("schema_name"),
                "table": F.col("table_name"),
                "full_name": F.concat_ws(".", F.lit(catalog), "schema_name", "table_name"),
                "is_delta": F.lit(True),
                "error": F.when(~known, F.lit("table detail not available")),
                "analyzed_at": ts_lit(as_of),
            }
        )
        .select(*CANDIDATE_COLUMNS)
        .orderBy(F.col("candidate_score").desc_nulls_last(), "table")
    )


def top_candidates(candidates: DataFrame, n: int = 50) -> DataFrame:
    return (
        candidates.filter("is_delta and error is null")
        .orderBy(F.col("candidate_score").desc_nulls_last(), "table")
        .limit(n)
    )


def failed_steps(scope: DataFrame, collected: dict[str, DataFrame]) -> DataFrame:
    """Tables in scope for which a collection step returned nothing, one row per step.

    What a step returned is reduced to its table names first: a table with most of the
    history is one row of the anti join.
    """
    parts = [
        scope.select("table_name")
        .join(df.select("table_name").distinct(), "table_name", "left_anti")
        .select("table_name", F.lit(step).alias("step"), F.lit("no rows collected").alias("error"))
        for step, df in collected.items()
    ]
    return reduce(DataFrame.unionByName, parts)


# ---- storage report ------------------------------------------------------------------


def storage_pivot(metrics: DataFrame) -> DataFrame:
    """One row per table, one column per metric; a missing value is 0."""
    value = F.coalesce("metric_value", F.lit(0.0))
    return metrics.groupBy("table_name").pivot("metric_name", STORAGE_METRICS).agg(F.max(value))


def storage_ratios(pivoted: DataFrame) -> DataFrame:
    """Bytes in MB, GB and TB, share that vacuum would free, and total to active bytes."""
    out: dict[str, Column] = {}
    for name in STORAGE_METRICS:
        base = name.removesuffix("_bytes")
        targets = [base, "space_saving"] if base == "vacuumable" else [base]
        for target in targets:
            for unit, size, digits in (("mb", MB, 2), ("gb", GB, 4), ("tb", TB, 6)):
                out[f"{target}_{unit}"] = settled(F.col(name) / size, digits)
    total, active, vacuumable = F.col("total_bytes"), F.col("active_bytes"), F.col("vacuumable_bytes")
    out["saving_pct"] = settled(F.when(total > 0, vacuumable / total * 100).otherwise(0.0), 2)
    out["bloat_ratio"] = settled(F.when(active > 0, total / active).otherwise(0.0), 2)
    return pivoted.withColumns(out)


def _day_count(as_of: datetime, ts: str) -> Column:
    return F.datediff(ts_lit(as_of), F.col(ts))


def detail_features(detail: DataFrame, as_of: datetime) -> DataFrame:
    """Joined column lists, average file size, partitioned and clustered marks, staleness.

    ``partition_columns``, ``clustering_columns`` and ``table_features`` are arrays.
    """
    files, size = F.col("num_files"), F.col("size_in_bytes")
    lists = ["partition_columns", "clustering_columns", "table_features"]
    present = [c for c in lists if c in detail.columns]
    kept = ["table_name", "table_type", "location", "last_modified", "num_files", "size_in_bytes"]
    kept += [c for c in ("created_at", "min_reader_version", "min_writer_version") if c in detail.columns]
    yes = lambda cond: F.when(cond, F.lit("Yes")).otherwise("No")
    return detail.select(
        *kept,
        F.col("data_source_format").alias("format"),
        *[F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in present],
        F.coalesce(F.size("partition_columns"), F.lit(0)).alias("num_partitions"),
        settled(F.when(files > 0, size / files / MB).otherwise(0.0), 2).alias("avg_file_size_mb"),
        yes(F.size("partition_columns") > 0).alias("is_partitioned"),
        yes(F.size("clustering_columns") > 0).alias("has_liquid_clustering"),
        _day_count(as_of, "last_modified").alias("days_since_last_modified"),
    )


def table_properties(props: DataFrame) -> DataFrame:
    """Ten properties as columns, ``not set`` where a table lacks one."""
    keys = list(PROPERTY_COLUMNS.values())
    wide = props.groupBy("table_name").pivot("prop_key", keys).agg(F.max("prop_value"))
    columns = [F.coalesce(F.col(f"`{key}`"), F.lit("not set")).alias(name) for name, key in PROPERTY_COLUMNS.items()]
    return wide.select("table_name", *columns)


def maintenance_history(history: DataFrame, as_of: datetime) -> DataFrame:
    """Last optimize, vacuum and write, their counts, and days since (-1 = never).

    The last vacuum is a start or an end; only ends are counted.
    """
    op, ts = F.col("operation"), F.col("op_ts")
    days = lambda c: F.when(F.col(c).isNotNull(), _day_count(as_of, c)).otherwise(-1)
    yes = lambda c: F.when(F.col(c) > 0, F.lit("Yes")).otherwise("No")
    return (
        history.groupBy("table_name")
        .agg(
            F.max(F.when(op == "OPTIMIZE", ts)).alias("last_optimize"),
            F.max(F.when(op.isin("VACUUM START", "VACUUM END"), ts)).alias("last_vacuum"),
            F.max(F.when(op.isin(WRITE_OPS), ts)).alias("last_write_operation"),
            F.count_if(op == "OPTIMIZE").alias("optimize_count_in_history"),
            F.count_if(op == "VACUUM END").alias("vacuum_count_in_history"),
            F.count(F.lit(1)).alias("total_versions_in_history"),
        )
        .withColumns(
            {
                "days_since_last_optimize": days("last_optimize"),
                "days_since_last_vacuum": days("last_vacuum"),
                "days_since_last_write": days("last_write_operation"),
                "vacuum_ever_run": yes("vacuum_count_in_history"),
                "optimize_ever_run": yes("optimize_count_in_history"),
            }
        )
    )


def maintenance_report(
    metrics: DataFrame,
    detail: DataFrame,
    props: DataFrame,
    history: DataFrame,
    as_of: datetime,
    catalog: str,
    schema: str,
) -> DataFrame:
    """Everything known per table that has storage metrics, with one recommendation (fixed texts)."""
    never, saving = F.col("vacuum_ever_run") == "No", F.col("saving_pct")
    recommendation = first_match(
        [
            (never & (saving > 20), "CRITICAL: VACUUM never run, high reclaimable space"),
            (never, "WARNING: VACUUM has never been run"),
            (F.col("days_since_last_vacuum") > 30, "WARNING: VACUUM not run in 30+ days"),
            (
                (F.col("avg_file_size_mb") < 8) & (F.col("num_files") > 100),
                "WARNING: Small file problem detected - run OPTIMIZE",
            ),
            (F.col("bloat_ratio") > 3, "WARNING: High bloat ratio - run VACUUM"),
            (saving > 50, "INFO: >50% storage is reclaimable"),
        ],
        "OK",
    )
    report = (
        storage_ratios(storage_pivot(metrics))
        .join(detail_features(detail, as_of), "table_name", "left")
        .join(table_properties(props), "table_name", "left")
        .join(maintenance_history(history, as_of), "table_name", "left")
        .withColumns({"recommendation": recommendation, "catalog": F.lit(catalog), "schema": F.lit(schema)})
    )
    front = ["catalog", "schema", "table_name", "table_type", "format", "recommendation"]
    return report.select(*front, *[c for c in report.columns if c not in front])


def storage_summary(report: DataFrame) -> DataFrame:
    gb = lambda c: settled(F.sum(c) / GB, 2)
    total = F.sum("total_bytes")
    return report.agg(
        gb("total_bytes").alias("total_storage_gb"),
        gb("active_bytes").alias("active_storage_gb"),
        gb("vacuumable_bytes").alias("reclaimable_by_vacuum_gb"),
        gb("time_travel_bytes").alias("time_travel_gb"),
        settled(F.when(total > 0, F.sum("vacuumable_bytes") / total * 100).otherwise(0.0), 2).alias(
            "overall_saving_pct"
        ),
        F.sum("num_files").cast("long").alias("total_files"),
        F.count("table_name").alias("total_tables"),
    )


def top_reclaimable(report: DataFrame, n: int = 20) -> DataFrame:
    columns = ["table_name", "table_type", "total_gb", "active_gb", "space_saving_gb", "saving_pct"]
    columns += ["bloat_ratio", "vacuum_ever_run", "days_since_last_vacuum", "recommendation"]
    return report.select(*columns).orderBy(F.col("space_saving_gb").desc(), "table_name").limit(n)


def needs_attention(report: DataFrame) -> DataFrame:
    columns = ["table_name", "table_type", "recommendation", "total_gb", "space_saving_gb", "saving_pct"]
    columns += ["vacuum_ever_run", "days_since_last_vacuum", "optimize_ever_run", "days_since_last_optimize"]
    columns += ["avg_file_size_mb", "num_files"]
    wanted = report.filter(F.col("recommendation") != "OK")
    return wanted.select(*columns).orderBy(F.col("space_saving_gb").desc())


def feature_matrix(report: DataFrame) -> DataFrame:
    columns = ["table_name", "table_type", "format", "is_partitioned", "partition_columns"]
    columns += ["has_liquid_clustering", "clustering_columns", "table_features", "delta_deletion_vectors"]
    columns += ["delta_auto_optimize", "delta_auto_compact", "delta_log_retention"]
    columns += ["delta_deleted_file_retention", "min_reader_version", "min_writer_version"]
    return report.select(*[c for c in columns if c in report.columns]).orderBy("table_name")


def staleness(report: DataFrame) -> DataFrame:
    columns = ["table_name", "table_type", "last_modified", "days_since_last_modified"]
    columns += ["last_write_operation", "days_since_last_write", "last_optimize", "days_since_last_optimize"]
    columns += ["last_vacuum", "days_since_last_vacuum", "total_versions_in_history"]
    columns += ["optimize_count_in_history", "vacuum_count_in_history"]
    return report.select(*columns).orderBy(F.col("days_since_last_modified").desc())


def file_size_assessment(report: DataFrame) -> DataFrame:
    size = F.col("avg_file_size_mb")
    band = first_match([(size < 8, "Too Small (< 8 MB)"), (size > 1024, "Too Large (> 1 GB)")], "Healthy")
    columns = ["table_name", "num_files", "size_in_bytes", "avg_file_size_mb", "total_gb", "is_partitioned"]
    columns += ["has_liquid_clustering", "optimize_ever_run", "days_since_last_optimize"]
    return report.select(*columns, band.alias("file_size_assessment")).orderBy("avg_file_size_mb")
