"""Refresh router: which reports are due after which table updates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.functions.columns import micros, settled
from opsight.functions.relational import latest_by, spread_join
from opsight.functions.rules import first_match
from opsight.windows import ts_lit


def payload_tables(payload: Column) -> Column:
    """The table names of a JSON array text, trimmed and lower-cased; empty if it is no such text."""
    listed = F.when(F.trim(payload).startswith("["), F.from_json(payload, "array<string>"))
    names = F.transform(listed, lambda t: F.lower(F.trim(t)))
    return F.coalesce(F.filter(names, lambda t: t != ""), F.array().cast("array<string>"))


def parse_updates(payloads: DataFrame, payload: str = "updated_tables") -> DataFrame:
    """One row per payload and distinct table name. Each row is parsed in place, no shuffle."""
    kept = [c for c in payloads.columns if c != payload]
    names = F.array_distinct(payload_tables(F.col(payload)))
    return payloads.select(*kept, F.explode(names).alias("source_table"))


def _updated_names(updates: DataFrame) -> DataFrame:
    return updates.select(F.col("source_table").alias("_updated")).distinct()


def match_reports(mapping: DataFrame, updates: DataFrame) -> DataFrame:
    """Per enabled report, whether any of its source tables was updated."""
    enabled = mapping.filter("enabled")
    hits = enabled.join(_updated_names(updates), F.lower("source_table") == F.col("_updated"), "left")
    return hits.groupBy("report_id").agg(F.bool_or(F.col("_updated").isNotNull()).alias("refresh"))


def split_name(name: Column) -> list[Column]:
    """Catalog, schema and table of a three-part name; any other name is a table only."""
    parts = F.split(name, r"\.")
    full = F.size(parts) == 3
    return [
        F.when(full, parts[0]).alias("catalog"),
        F.when(full, parts[1]).alias("schema"),
        F.when(full, parts[2]).otherwise(name).alias("table"),
    ]


def _json_list(names: Column) -> Column:
    quoted = F.transform(names, lambda t: F.regexp_replace(F.to_json(F.array(t)), r"^\[|\]$", ""))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def refresh_list(
    mapping: DataFrame, payloads: DataFrame, payload: str = "updated_tables", many: bool = False
) -> DataFrame:
    """Per payload, one row per mapping row of an updated table, with the whole payload as JSON.

    A table may be in many payloads and in many mapping rows, so the rows of a table are made by several tasks.
    If there are ``many`` payloads, mapping rows are repeated for these tasks instead of payloads, the rows of a
    payload come together, and payloads are dealt out before they are parsed, as a few small files may hold millions.
    """
    if many:
        payloads = payloads.repartition(int(payloads.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    listed = payload_tables(F.col(payload))
    updates = payloads.select(
        "run_id",
        _json_list(listed).alias("triggering_tables"),
        F.explode(F.array_distinct(listed)).alias("_updated"),
    )
    enabled = mapping.filter("enabled").drop("enabled").withColumn("_updated", F.lower("source_table"))
    columns = [c for c in [*enabled.columns, *updates.columns] if c != "_updated"]
    return spread_join(*((updates, enabled) if many else (enabled, updates)), "_updated").select(*columns)


def refresh_list_named(mapping: DataFrame, payloads: DataFrame) -> DataFrame:
    """:func:`refresh_list` with the source table split into its parts, which is done once per mapping row."""
    rows = refresh_list(mapping.withColumn("_parts", F.struct(*split_name(F.col("source_table")))), payloads)
    return rows.select(*[c for c in rows.columns if c not in ("source_table", "_parts")], "_parts.*")


# ---- durable state -------------------------------------------------------------------


def upsert_table_state(state: DataFrame, updates: DataFrame, now: datetime, run_id: str) -> DataFrame:
    """Move the watermark of every updated table to ``now``; names meet in lower case."""
    return _merge_state(
        state,
        _updated_names(updates),
        F.lower("source_table") == F.col("_updated"),
        "source_table",
        {"last_updated_ts": ts_lit(now), "last_run_id": F.lit(run_id)},
    )


def commit_state(state: DataFrame, commits: DataFrame, run_id: str) -> DataFrame:
    """Move report watermarks to their candidate times, once their refresh succeeded."""
    done = commits.select(F.col("report_id").alias("_updated"), F.col("candidate_ts").alias("_ts"))
    return _merge_state(
        state,
        latest_by(done.filter("_ts is not null"), ["_updated"], ["_ts"]),
        F.col("report_id") == F.col("_updated"),
        "report_id",
        {"last_refresh_ts": F.col("_ts"), "last_refresh_run_id": F.lit(run_id)},
    ).drop("_ts")


def _merge_state(
    state: DataFrame, changes: DataFrame, match: Column, key: str, values: dict[str, Column]
) -> DataFrame:
    changed = F.col("_updated").isNotNull()
    merged = state.join(changes, match, "full_outer").withColumns(
        {key: F.coalesce(key, "_updated"), **{c: F.when(changed, v).otherwise(F.col(c)) for c, v in values.items()}}
    )
    return merged.drop("_updated")


# ---- dueness -------------------------------------------------------------------------


def evaluate_due(
    config: DataFrame,
    dependencies: DataFrame,
    table_state: DataFrame,
    report_state: DataFrame,
    force_all: bool = False,
) -> DataFrame:
    """Per enabled report: is it due, and why.

    A dependency is fresh if it was updated after the report's watermark. Repeated
    dependency rows count as needed but only once as fresh, so they block ALL.
    """
    names = F.lower("source_table").alias("source_table")
    tables = latest_by(
        table_state.select(names, "last_updated_ts"), ["source_table"], ["last_updated_ts"]
    )
    marks = report_state.select("report_id", "last_refresh_ts")
    enabled = config.filter("enabled")
    seen = F.col("last_updated_ts")
    fresh = seen.isNotNull() & (F.col("last_refresh_ts").isNull() | (seen > F.col("last_refresh_ts")))
    counts = (
        dependencies.select("report_id", names)
        .join(enabled, "report_id", "left_semi")
        .join(tables, "source_table", "left")
        .join(marks, "report_id", "left")
        .groupBy("report_id")
        .agg(
            F.count(F.lit(1)).alias("_needed"),
            F.countDistinct(F.when(fresh, F.col("source_table"))).alias("_fresh"),
            F.max(F.when(fresh, seen)).alias("_newest"),
            F.min(F.when(fresh, seen)).alias("_oldest"),
        )
    )
    any_mode = F.upper(F.coalesce(F.nullif("refresh_mode", F.lit("")), F.lit("ALL"))) == "ANY"
    none = F.col("_needed").isNull()
    limit = F.col("dependency_window_minutes")
    span = (micros(F.col("_newest")) - micros(F.col("_oldest"))) / F.lit(60e6)
    ready = F.when(any_mode, F.col("_fresh") >= 1).otherwise(F.col("_fresh") == F.col("_needed"))
    why = F.format_string("%s %d/%d", F.when(any_mode, F.lit("ANY")).otherwise("ALL"), "_fresh", "_needed")
    apart = ready & (limit.isNotNull() & (limit != 0)) & (F.col("_fresh") > 1) & (span > limit)
    forced = F.lit(force_all)
    due = first_match([(none, False), (forced, True), (apart, False)], ready)
    reason = first_match(
        [
            (none, "no dependencies configured"),
            (forced, "force_all"),
            (apart, F.concat(why, F.format_string("; window %.1fm>%dm", settled(span, 1), limit))),
        ],
        why,
    )
    return enabled.join(counts, "report_id", "left").select(
        "report_id", due.alias("is_due"), reason.alias("reason")
    )


def decisions(due: DataFrame, now: datetime) -> DataFrame:
    """The refresh flag of every enabled report and the time to commit once it succeeded."""
    return due.select(
        "report_id",
        F.col("is_due").cast("string").alias("refresh"),
        F.when(F.col("is_due"), ts_lit(now)).alias("candidate_ts"),
    )


def audit(refreshed: DataFrame, now: datetime, status: str = "SUCCESS") -> DataFrame:
    """Audit rows for refreshed reports, to be appended."""
    return refreshed.select(
        "run_id",
        "report_id",
        "report_name",
        "triggering_tables",
        ts_lit(now).alias("refreshed_at"),
        F.lit(status).alias("status"),
    )


def stale_reports(report_state: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    limit = ts_lit(as_of) - F.expr(f"interval {int(hours)} hours")
    return report_state.filter(F.col("last_refresh_ts") < limit)


# ---- dependency graph ----------------------------------------------------------------


def dependency_report(config: DataFrame, dependencies: DataFrame, max_tables: int = 10) -> DataFrame:
    """Per enabled report: dependency rows, distinct tables, and the two warnings."""
    counts = dependencies.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("dependencies"), F.countDistinct(F.lower("source_table")).alias("tables")
    )
    tables = F.coalesce("tables", F.lit(0))
    return (
        config.filter("enabled")
        .join(counts, "report_id", "left")
        .select(
            "report_id",
            F.coalesce("dependencies", F.lit(0)).alias("dependencies"),
            tables.alias("tables"),
            (tables == 0).alias("has_no_dependencies"),
            (tables > max_tables).alias("over_table_limit"),
        )
    )


def reports_by_table(config: DataFrame, dependencies: DataFrame) -> DataFrame:
    """The reverse map as counts: reports of enabled reports per source table."""
    return (
        dependencies.join(config.filter("enabled"), "report_id", "left_semi")
        .groupBy(F.lower("source_table").alias("source_table"))
        .agg(F.count(F.lit(1)).alias("dependencies"), F.countDistinct("report_id").alias("reports"))
    )
