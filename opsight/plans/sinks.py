"""Registered queries that store a result with each sink and read it back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.plans import failures, maintenance, planning, router
from opsight.plans.common import AS_OF, Inputs, Query, query
from opsight.scratch import scratch_path
from opsight.sources import sinks


def _stored(inner: Query, store: Callable[[DataFrame, str, Inputs], None]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = scratch_path(spark, "stored")
        store(inner(spark, folder), path, Inputs(spark, folder))
        return spark.read.parquet(path)

    return run


def _overwritten(df: DataFrame, path: str, t: Inputs) -> None:
    """First with other columns, then with the result."""
    sinks.overwrite(df.limit(1).select(F.lit(1).alias("old")), path)
    sinks.overwrite(df, path)


def _snapshot(df: DataFrame, path: str, t: Inputs) -> None:
    sinks.append_snapshot(df, path, t.as_of())


def _appended(df: DataFrame, path: str, t: Inputs) -> None:
    """Nothing at first, then all rows."""
    sinks.append(df.limit(0), path)
    sinks.append(df, path)


def _copied(df: DataFrame, path: str, t: Inputs) -> None:
    """A second copy onto the first is skipped."""
    sinks.copy_table(df, path, ["o_orderstatus"])
    sinks.copy_table(df.limit(0), path, ["o_orderstatus"])


QUERIES = {
    "stored_matrix": _stored(failures.QUERIES["daily_failure_matrix"], _overwritten),
    "stored_vacuum_priority": _stored(maintenance.QUERIES["vacuum_priority"], _snapshot),
    "stored_copy": _stored(query(lambda t: t.given("orders")), _copied),
    "stored_audit": _stored(router.EACH_AUDIT, _appended),
    "stored_migration_log": _stored(planning.QUERIES["migration_log"], _appended),
    "stored_top_candidates": _stored(maintenance.QUERIES["top_candidates"], _appended),
}

ORACLE = {
    "stored_matrix": failures.ORACLE["daily_failure_matrix"],
    "stored_vacuum_priority": f"select q.*, {AS_OF} as analysis_timestamp from ({maintenance.ORACLE['vacuum_priority']}) q",
    "stored_copy": "select * from orders",
    "stored_audit": router.EACH_AUDIT_SQL,
    "stored_migration_log": planning.ORACLE["migration_log"],
    "stored_top_candidates": maintenance.ORACLE["top_candidates"],
}
