from datetime import datetime

import pytest

from opsight import sql

PERIODS = "workspace_id string, job_id long, run_id long, period_end_time timestamp_ntz, run_type string, result_state string, termination_code string"
NOW = datetime(2024, 1, 30)


@pytest.fixture
def tables(spark):
    def row(workspace, run, day, state="FAILED", code="RUN_EXECUTION_ERROR"):
        return (workspace, run % 3, run, datetime(2024, 1, day), "JOB_RUN", state, code)

    periods = [row("1", 1, 20), row("1", 2, 20), row("o'x", 3, 21), row("o'x", 4, 2), row("1", 5, 20, "SUCCEEDED", "SUCCESS"), row(None, 6, 22)]
    return {
        "job_run_periods": spark.createDataFrame(periods, PERIODS),
        "workspaces": spark.createDataFrame([("1", "one"), ("o'x", "its")], "workspace_id string, workspace_name string"),
    }


def counts(df):
    return sorted((r[0] or "", r[1]) for r in df.collect())


TEXT = "select workspace_id, sum(runs) as n from {failure_matrix} group by workspace_id"


def test_values_are_bound(spark, tables):
    assert counts(sql.run(spark, tables, TEXT, as_of=NOW)) == [("", 1), ("1", 2), ("o'x", 2)]
    assert counts(sql.run(spark, tables, TEXT, as_of=NOW, lookback_days=12)) == [("", 1), ("1", 2), ("o'x", 1)]
    assert counts(sql.run(spark, tables, TEXT, as_of=NOW, workspace_id="o'x")) == [("o'x", 2)]
    assert counts(sql.run(spark, tables, TEXT, as_of=NOW, workspace_name="its")) == [("o'x", 2)]
    assert counts(sql.run(spark, tables, TEXT, as_of=NOW, workspace_id="' or '1' = '1")) == []


def test_markers_tables_and_lists(spark, tables):
    text = "select w.workspace_name, m.runs from {failure_matrix} m join {workspaces} w using (workspace_id) where w.workspace_name = :name and array_contains(:days, day(m.run_date))"
    assert counts(sql.run(spark, tables, text, as_of=NOW, name="its", days=(21, 22))) == [("its", 1)]
    assert counts(sql.run(spark, tables, text, as_of=NOW, name="it's", days=[21])) == []
    both = "select failure_category, failed_runs from {failure_reach} where failed_runs > :least"
    assert counts(sql.run(spark, tables, both, as_of=NOW, least=0, workspace_id="1"))[0][1] == 2


def test_unknown_names_and_missing_values(spark, tables):
    with pytest.raises(ValueError, match="no operator or table: nothing"):
        sql.run(spark, tables, "select * from {nothing}", as_of=NOW)
    with pytest.raises(ValueError, match="needs as_of"):
        sql.run(spark, tables, TEXT)


def test_empty_tables(spark, tables):
    empty = {n: t.limit(0) for n, t in tables.items()}
    assert sql.run(spark, empty, TEXT, as_of=NOW).count() == 0
