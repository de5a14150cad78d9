"""Job-failure taxonomy: terminal runs, categories, rollups, repeat offenders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsight.functions.columns import settled
from opsight.functions.relational import latest_by, share_of_total
from opsight.functions.rules import first_match
from opsight.windows import Lookback

# Termination codes per category, labels and advice texts.
TRANSIENT = ["INTERNAL_ERROR", "CLOUD_FAILURE", "CLUSTER_ERROR", "DRIVER_ERROR"]
CONFIG = [
    "INVALID_RUN_CONFIGURATION",
    "INVALID_CLUSTER_REQUEST",
    "RESOURCE_NOT_FOUND",
    "REPOSITORY_CHECKOUT_FAILED",
    "LIBRARY_INSTALLATION_ERROR",
    "FEATURE_DISABLED",
]
PERMISSIONS = ["UNAUTHORIZED_ERROR", "STORAGE_ACCESS_ERROR"]
LIMITS = [
    "MAX_CONCURRENT_RUNS_EXCEEDED",
    "MAX_JOB_QUEUE_SIZE_EXCEEDED",
    "WORKSPACE_RUN_LIMIT_EXCEEDED",
    "CLUSTER_REQUEST_LIMIT_EXCEEDED",
    "MAX_SPARK_CONTEXTS_EXCEEDED",
]
EXECUTION_ERROR = "RUN_EXECUTION_ERROR"
FAILED_STATES = ["FAILED", "ERROR", "SKIPPED", "TIMEDOUT"]
CATEGORIES = [
    (TRANSIENT, "1. Transient / Infra"),
    (CONFIG, "2. Config / Definition (tech debt)"),
    (PERMISSIONS, "3. Permissions / Governance"),
    (LIMITS, "4. Concurrency / Limits"),
    ([EXECUTION_ERROR], "5. Code / Data logic (needs triage)"),
]
OTHER_CATEGORY = "6. Other / Uncategorized"
LEVERS = {
    "generic": [
        (TRANSIENT, "Job retries + serverless (auto-recover)"),
        (CONFIG, "DABs + CI/CD + serverless (eliminate config drift)"),
        (PERMISSIONS, "Unity Catalog governance + service principals"),
        (LIMITS, "Orchestration design + serverless elasticity"),
        ([EXECUTION_ERROR], "Lakeflow/DLT expectations + Auto Loader; triage agent for residual"),
    ],
    "pipelines": [
        (
            TRANSIENT,
            "Lakeflow Declarative Pipelines on serverless — automatic retries + managed compute self-heal transient infra",
        ),
        (
            CONFIG,
            "Lakeflow Declarative Pipelines + DABs on serverless — no hand-built ADF/cluster config to drift",
        ),
        (
            PERMISSIONS,
            "Auto Loader on UC external locations + service principals — one governed ingestion path",
        ),
        (
            LIMITS,
            "Lakeflow orchestration replaces ADF triggers — serverless elasticity absorbs concurrency spikes",
        ),
        (
            [EXECUTION_ERROR],
            "Auto Loader (schema evolution) + DLT expectations (data-quality gates); RCA/triage agent for residual",
        ),
    ],
}
AGENT = "Agent candidate (long tail)"
SOLVED = "Solved by best practices"
BANDS = (
    (20, "chronic (20+ fails) -> remediate pipeline"),
    (5, "recurring (5-19)    -> remediate pipeline"),
)
SPORADIC = "sporadic (1-4)      -> genuine triage-agent surface"


def _code_in(codes: list[str]) -> Column:
    return F.col("termination_code").isin(codes)


def _in_scope(periods: DataFrame, window: Lookback, code: str | None = None) -> DataFrame:
    kept = periods.filter(
        window.since(F.col("period_end_time"))
        & (F.col("run_type") == "JOB_RUN")
        & F.col("result_state").isNotNull()
    )
    return kept.filter(F.col("termination_code") == code) if code else kept


def terminal_runs(periods: DataFrame, window: Lookback, workspace: str | None = None) -> DataFrame:
    """One row per run: its latest period in the window that has a result."""
    kept = _in_scope(periods, window)
    if workspace:
        kept = kept.filter(F.col("workspace_id") == workspace)
    runs = latest_by(kept, ["workspace_id", "run_id"], ["period_end_time"])
    return runs.withColumn("run_date", F.to_date("period_end_time"))


def execution_errors(periods: DataFrame, window: Lookback) -> DataFrame:
    """As :func:`terminal_runs`, but only execution-error periods compete for the last place."""
    return latest_by(
        _in_scope(periods, window, EXECUTION_ERROR), ["workspace_id", "run_id"], ["period_end_time"]
    )


def with_failure_category(runs: DataFrame) -> DataFrame:
    cancelled = (F.col("result_state") == "CANCELLED") | (F.col("termination_code") == "USER_CANCELLED")
    rules = [
        (F.col("result_state") == "SUCCEEDED", "0. Succeeded"),
        (cancelled, "0. Cancelled (expected)"),
        *[(_code_in(codes), label) for codes, label in CATEGORIES],
    ]
    return runs.withColumn("failure_category", first_match(rules, OTHER_CATEGORY))


def _not_a_failure() -> Column:
    return (F.col("result_state") == "SUCCEEDED") | (F.col("termination_code") == "USER_CANCELLED")


def with_resolution_lever(runs: DataFrame, wording: str = "generic") -> DataFrame:
    rules = [(_not_a_failure(), "n/a"), *[(_code_in(codes), text) for codes, text in LEVERS[wording]]]
    return runs.withColumn("resolution_lever", first_match(rules, "Investigate"))


def with_disposition(runs: DataFrame) -> DataFrame:
    rules = [
        (_not_a_failure(), "Not a failure"),
        (_code_in([EXECUTION_ERROR]), AGENT),
        (F.col("result_state").isin(FAILED_STATES), SOLVED),
    ]
    return runs.withColumn("disposition", first_match(rules, "Review"))


def classify_runs(runs: DataFrame, wording: str = "generic") -> DataFrame:
    return with_disposition(with_resolution_lever(with_failure_category(runs), wording))


def daily_failure_matrix(runs: DataFrame, names: DataFrame | None = None, wording: str = "generic") -> DataFrame:
    """Workspace x day x category; names are joined to the aggregated rows, not to the runs."""
    keys = ["workspace_id", "run_date", "failure_category", "resolution_lever", "disposition"]
    matrix = (
        classify_runs(runs, wording)
        .filter(~F.col("failure_category").like("0.%"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("run_id").alias("distinct_runs"))
    )
    if names is not None:
        matrix = matrix.join(names.select("workspace_id", "workspace_name"), "workspace_id", "left")
    return matrix


def exec_rollup(runs: DataFrame, by: str | None = None) -> DataFrame:
    """Failed runs per category with their share of all failures (or of the workspace's)."""
    category = first_match([(_code_in(codes), label) for codes, label in CATEGORIES], OTHER_CATEGORY)
    disposition = first_match([(_code_in([EXECUTION_ERROR]), AGENT)], SOLVED)
    keys = [by] if by else []
    counted = (
        runs.filter(F.col("result_state").isin(FAILED_STATES))
        .withColumn("failure_category", category)
        .withColumn("disposition", disposition)
        .groupBy(*keys, "failure_category", "disposition")
        .agg(F.count(F.lit(1)).alias("failed_runs"))
    )
    return share_of_total(counted, "failed_runs", "pct_of_failures", keys)


def _per_job(errors: DataFrame) -> DataFrame:
    return errors.groupBy("workspace_id", "job_id").agg(F.count(F.lit(1)).alias("failed_runs"))


def failure_bands(errors: DataFrame) -> DataFrame:
    """How concentrated execution errors are: jobs and runs per band of failure count."""
    fails = F.col("failed_runs")
    banded = (
        _per_job(errors)
        .withColumn("job_failure_band", first_match([(fails >= n, text) for n, text in BANDS], SPORADIC))
        .groupBy("job_failure_band")
        .agg(F.count(F.lit(1)).alias("num_jobs"), F.sum("failed_runs").alias("failed_runs"))
    )
    return share_of_total(banded, "failed_runs", "pct_of_exec_errors")


def repeat_offenders(errors: DataFrame, jobs: DataFrame, names: DataFrame, n: int = 25) -> DataFrame:
    """Top ``n`` jobs with share and running share of all execution errors.

    The running share of the first ``n`` rows depends on those rows and the grand
    total only, so the ordered window runs over the ``n`` kept rows.
    """
    per_job = _per_job(errors)
    total = per_job.agg(F.sum("failed_runs")).scalar().cast("double")
    order = [F.col("failed_runs").desc(), F.col("job_id"), F.col("workspace_id")]
    top = per_job.orderBy(*order).limit(n)
    running = F.sum("failed_runs").over(
        Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = top.withColumns(
        {
            "pct_of_exec_errors": settled(100.0 * F.col("failed_runs").cast("double") / total, 1),
            "running_pct_cumulative": settled(100.0 * running.cast("double") / total, 1),
        }
    )
    named = latest_by(
        jobs.join(top.select("workspace_id", "job_id"), ["workspace_id", "job_id"], "left_semi"),
        ["workspace_id", "job_id"],
        ["change_time", "name"],
    ).select("workspace_id", "job_id", F.col("name").alias("job_name"))
    return (
        ranked.join(named, ["workspace_id", "job_id"], "left")
        .join(names.select("workspace_id", "workspace_name"), "workspace_id", "left")
        .orderBy(*order)
    )


def scope_workspace(
    df: DataFrame, names: DataFrame, workspace_id: str | None = None, workspace_name: str | None = None
) -> DataFrame:
    """An explicit id wins; else the ids that carry the name; else everything."""
    if workspace_id:
        return df.filter(F.col("workspace_id") == workspace_id)
    if workspace_name:
        wanted = names.filter(F.col("workspace_name") == workspace_name)
        return df.join(wanted, "workspace_id", "left_semi")
    return df


def enrichment_candidates(
    periods: DataFrame, window: Lookback, workspace: str, scope: str = "sporadic_triage"
) -> DataFrame:
    """Failed runs worth a closer look, one row per run.

    ``sporadic_triage`` keeps jobs with 1-4 execution-error *period rows*;
    ``all_exec_errors`` and ``all_failures`` keep every such run.
    """
    mine = periods.filter(F.col("workspace_id") == workspace)
    if scope == "all_failures":
        kept = _in_scope(mine, window).filter(F.col("result_state").isin("FAILED", "ERROR", "TIMEDOUT"))
    elif scope in ("all_exec_errors", "sporadic_triage"):
        kept = _in_scope(mine, window, EXECUTION_ERROR)
    else:
        raise ValueError(f"unknown scope {scope!r}")
    if scope == "sporadic_triage":
        few = kept.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).filter("n between 1 and 4")
        kept = kept.join(few, "job_id", "left_semi")
    return latest_by(kept, ["run_id"], ["period_end_time"]).withColumn("run_date", F.to_date("period_end_time"))
