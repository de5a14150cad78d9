"""Failure taxonomy: every branch, hidden execution errors, bands at their edges."""

from datetime import datetime, timedelta

import pytest

from opsight.operators import failures as f
from opsight.operators import root_cause as rc
from opsight.windows import Lookback

NOW = datetime(2024, 1, 30, 12)
WINDOW = Lookback(NOW, 10)
SCHEMA = """workspace_id string, job_id long, run_id long, period_end_time timestamp_ntz, run_type string,
result_state string, termination_code string"""


def period(run, state, code, hours=1, job=1, ws="1", kind="JOB_RUN"):
    return (ws, job, run, NOW - timedelta(hours=hours), kind, state, code)


CASES = [
    ("SUCCEEDED", "SUCCESS", "0. Succeeded", "n/a", "Not a failure"),
    ("CANCELLED", "INTERNAL_ERROR", "0. Cancelled (expected)", f.LEVERS["generic"][0][1], "Review"),
    ("FAILED", "USER_CANCELLED", "0. Cancelled (expected)", "n/a", "Not a failure"),
    ("FAILED", "CLOUD_FAILURE", "1. Transient / Infra", f.LEVERS["generic"][0][1], f.SOLVED),
    ("ERROR", "FEATURE_DISABLED", "2. Config / Definition (tech debt)", f.LEVERS["generic"][1][1], f.SOLVED),
    ("FAILED", "STORAGE_ACCESS_ERROR", "3. Permissions / Governance", f.LEVERS["generic"][2][1], f.SOLVED),
    ("SKIPPED", "MAX_JOB_QUEUE_SIZE_EXCEEDED", "4. Concurrency / Limits", f.LEVERS["generic"][3][1], f.SOLVED),
    ("FAILED", "RUN_EXECUTION_ERROR", "5. Code / Data logic (needs triage)", f.LEVERS["generic"][4][1], f.AGENT),
    ("TIMEDOUT", None, "6. Other / Uncategorized", "Investigate", f.SOLVED),
    ("BLOCKED", "SOMETHING_NEW", "6. Other / Uncategorized", "Investigate", "Review"),
]


@pytest.mark.parametrize("state, code, category, lever, disposition", CASES)
def test_classification(spark, state, code, category, lever, disposition):
    df = spark.createDataFrame([period(1, state, code)], SCHEMA)
    row = f.classify_runs(df).first()
    assert (row.failure_category, row.resolution_lever, row.disposition) == (category, lever, disposition)


def test_scope_is_filtered_before_ranking(spark, rows):
    data = [
        period(1, "FAILED", "RUN_EXECUTION_ERROR", 5),
        period(1, "SUCCEEDED", "SUCCESS", 1),
        period(1, None, None, 0),
        period(2, "FAILED", "CLOUD_FAILURE", 3, kind="SUBMIT_RUN"),
        period(3, "FAILED", "CLOUD_FAILURE", 24 * 11),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(f.terminal_runs(df, WINDOW), "run_id", "result_state") == [(1, "SUCCEEDED")]
    # the later success does not hide the execution error
    assert rows(f.execution_errors(df, WINDOW), "run_id", "result_state") == [(1, "FAILED")]


def test_bands_at_edges_and_running_share(spark, rows):
    counts = {1: 20, 2: 19, 3: 5, 4: 4}
    data, run = [], 0
    for job, n in counts.items():
        for _ in range(n):
            run += 1
            data.append(period(run, "FAILED", "RUN_EXECUTION_ERROR", job=job))
    errors = f.execution_errors(spark.createDataFrame(data, SCHEMA), WINDOW)
    bands = {r.job_failure_band: (r.num_jobs, r.failed_runs, r.pct_of_exec_errors) for r in f.failure_bands(errors).collect()}
    assert bands == {f.BANDS[0][1]: (1, 20, 41.7), f.BANDS[1][1]: (2, 24, 50.0), f.SPORADIC: (1, 4, 8.3)}
    jobs = spark.createDataFrame([("1", 1, NOW, "b"), ("1", 1, NOW, "c")], "workspace_id string, job_id long, change_time timestamp_ntz, name string")
    names = spark.createDataFrame([("2", "other")], "workspace_id string, workspace_name string")
    top = f.repeat_offenders(errors, jobs, names, 3).collect()
    assert [(r.job_id, r.job_name, r.workspace_name, r.running_pct_cumulative) for r in top] == [
        (1, "c", None, 41.7), (2, None, None, 81.3), (3, None, None, 91.7),
    ]


def test_sporadic_scope_counts_periods_not_runs(spark, rows):
    data = [period(1, "FAILED", "RUN_EXECUTION_ERROR", h, job=1) for h in range(1, 6)]  # one run, five periods
    data += [period(2, "FAILED", "RUN_EXECUTION_ERROR", 2, job=2), period(3, "TIMEDOUT", None, 1, job=3)]
    df = spark.createDataFrame(data, SCHEMA)
    picked = lambda scope: rows(f.enrichment_candidates(df, WINDOW, "1", scope), "run_id")
    assert picked("sporadic_triage") == [(2,)]
    assert picked("all_exec_errors") == [(1,), (2,)]
    assert picked("all_failures") == [(1,), (2,), (3,)]


def test_scope_workspace_precedence(spark, rows):
    df = spark.createDataFrame([("1",), ("2",), ("3",)], "workspace_id string")
    names = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "y")], "workspace_id string, workspace_name string")
    assert rows(f.scope_workspace(df, names, "1", "y")) == [("1",)]
    assert rows(f.scope_workspace(df, names, None, "y")) == [("2",), ("3",)]
    assert len(rows(f.scope_workspace(df, names))) == 3


def test_every_reason_has_an_example(spark):
    examples = {
        "Cascading skip (upstream failed)": "Run result unavailable: dlt",
        "Lakeflow/DLT pipeline error (nested)": "see the pipeline web page, schema",
        "Kernel / driver crash": "Fatal error: schema",
        "Serverless incompatibility": "[x] no",
        "Schema / object mismatch": "org.AnalysisException: does not exist",
        "Missing / late-arriving files": "FileNotFound, timeout",
        "Memory pressure / OOM": "GC overhead limit exceeded",
        "Timeout": "exceeded the time, 403",
        "Data access / permissions": "HTTP 403 exception",
        "Monitoring / setup config": "SqlWarehouseId is required",
        "Missing parameter / widget": "parameter x required",
        "Null / type errors on dirty data": "NoneType has no attribute",
        "Missing dependency / library": "ImportError",
        "Malformed / parse errors": "corrupt unique",
        "Data quality / dedup": "merge must match one row, refused",
        "Source connectivity (JDBC/API)": "Socket closed, quota",
        "Capacity / quota": "limit exceeded exception",
        "Application code bug (unhandled exception)": "KeyError: 'k'",
        rc.OTHER_REASON: "odd",
    }
    examples["Serverless incompatibility"] = "PySpark RDDs: schema"
    data = [(text, want) for want, text in examples.items()]
    df = spark.createDataFrame([(None, t, "m", w) for t, w in data], "resolved_error string, error string, state_message string, want string")
    for row in rc.classify_reason(df).collect():
        assert row.code_failure_reason == row.want
    assert set(examples) == {n for n, _, _ in rc.REASONS} | {rc.OTHER_REASON}


def test_marker_in_first_text_drops_the_row(spark):
    df = spark.createDataFrame([("[gone]", "KeyError", None), (None, None, None)], "resolved_error string, error string, state_message string")
    assert rc.classify_reason(df).count() == 0
