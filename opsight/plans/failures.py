"""Registered failure-taxonomy queries and the SQL they must agree with."""

from __future__ import annotations

from opsight.operators import failures as f
from opsight.plans import expected as e
from opsight.plans.common import AS_OF, Inputs, oracle, query

DAYS = 20
WORKSPACE = "1"


def _runs(t: Inputs):
    return f.terminal_runs(t.logical("fx_job_periods"), t.window(DAYS))


def _errors(t: Inputs):
    return f.execution_errors(t.logical("fx_job_periods"), t.window(DAYS))


def _candidates(t: Inputs, scope: str = "sporadic_triage"):
    kept = f.enrichment_candidates(t.logical("fx_job_periods"), t.window(DAYS), WORKSPACE, scope)
    return kept.select("run_id", "job_id", "termination_code", "result_state", "run_date")


def _offenders(t: Inputs):
    return f.repeat_offenders(_errors(t), t.logical("fx_jobs"), t.logical("fx_workspaces"))


QUERIES = {
    "terminal_runs": query(
        lambda t: _runs(t).select("workspace_id", "job_id", "run_id", "run_date", "result_state", "termination_code")
    ),
    "failure_category": query(
        lambda t: f.with_failure_category(_runs(t)).select("workspace_id", "run_id", "failure_category")
    ),
    "daily_failure_matrix": query(lambda t: f.daily_failure_matrix(_runs(t))),
    "daily_failure_matrix_named": query(
        lambda t: f.daily_failure_matrix(_runs(t), t.logical("fx_workspaces"), "pipelines")
    ),
    "exec_rollup": query(lambda t: f.exec_rollup(_runs(t))),
    "exec_rollup_ws": query(lambda t: f.exec_rollup(_runs(t), "workspace_id")),
    "failure_bands": query(lambda t: f.failure_bands(_errors(t))),
    "repeat_offenders": query(_offenders),
    "latest_by": query(
        lambda t: f.latest_by(t.logical("fx_jobs"), ["workspace_id", "job_id"], ["change_time", "name"]).select(
            "workspace_id", "job_id", "name"
        )
    ),
    "scope_workspace": query(
        lambda t: f.scope_workspace(
            t.logical("fx_job_periods"), t.logical("fx_workspaces"), workspace_name="NATION_2"
        ).select("workspace_id", "run_id", "run_type", "result_state")
    ),
    "enrichment_candidates": query(_candidates),
    "all_exec_error_candidates": query(lambda t: _candidates(t, "all_exec_errors")),
    "all_failure_candidates": query(lambda t: _candidates(t, "all_failures")),
}


def _in(codes: list[str]) -> str:
    return "termination_code in (" + ", ".join(f"'{c}'" for c in codes) + ")"


def _case(rules: list[tuple[list[str], str]]) -> str:
    return " ".join(f"when {_in(codes)} then '{text}'" for codes, text in rules)


SCOPE = f"""period_end_time >= {AS_OF} - interval {DAYS} day and run_type = 'JOB_RUN' and result_state is not null"""
RANKED = f"""ranked as (
  select *, row_number() over (partition by workspace_id, run_id order by period_end_time desc) as rn
  from fx_job_periods where {SCOPE}),
terminal as (select *, cast(period_end_time as date) as run_date from ranked where rn = 1)"""
ERRORS = f"""ranked_errors as (
  select *, row_number() over (partition by workspace_id, run_id order by period_end_time desc) as rn
  from fx_job_periods where {SCOPE} and termination_code = '{e.EXECUTION_ERROR}'),
per_job as (select workspace_id, job_id, count(*) as failed_runs from ranked_errors where rn = 1 group by all)"""
CATEGORY = f"""case when result_state = 'SUCCEEDED' then '0. Succeeded'
  when result_state = 'CANCELLED' or termination_code = 'USER_CANCELLED' then '0. Cancelled (expected)'
  {_case(e.CATEGORIES)} else '{e.OTHER_CATEGORY}' end as failure_category"""
FINE = "result_state = 'SUCCEEDED' or termination_code = 'USER_CANCELLED'"
FAILED = "result_state in ('FAILED', 'ERROR', 'SKIPPED', 'TIMEDOUT')"
DISPOSITION = f"""case when {FINE} then 'Not a failure' when termination_code = '{e.EXECUTION_ERROR}' then '{e.AGENT}'
  when {FAILED} then '{e.SOLVED}' else 'Review' end as disposition"""


def _lever(wording: str) -> str:
    return f"case when {FINE} then 'n/a' {_case(e.LEVERS[wording])} else 'Investigate' end as resolution_lever"


def _matrix(wording: str) -> str:
    return f"""matrix as (
  select workspace_id, run_date, failure_category, resolution_lever, disposition, count(*) as runs,
    count(distinct run_id) as distinct_runs
  from (select *, {CATEGORY}, {_lever(wording)}, {DISPOSITION} from terminal) c
  where failure_category not like '0.%' group by all)"""


def _rollup(by: str) -> str:
    over = f"partition by {by.rstrip(', ')}" if by else ""
    return f"""select *, round(100.0 * failed_runs / sum(failed_runs) over ({over}), 1) as pct_of_failures from (
  select {by} case {_case(e.CATEGORIES)} else '{e.OTHER_CATEGORY}' end as failure_category,
    case when termination_code = '{e.EXECUTION_ERROR}' then '{e.AGENT}' else '{e.SOLVED}' end as disposition,
    count(*) as failed_runs from terminal where {FAILED} group by all) g"""


BAND = f"""case when failed_runs >= 20 then '{e.BANDS[0][1]}' when failed_runs >= 5 then '{e.BANDS[1][1]}'
  else '{e.SPORADIC}' end"""
LATEST_JOB = """latest_job as (select workspace_id, job_id, name from (
  select *, row_number() over (partition by workspace_id, job_id order by change_time desc, name desc) as rn
  from fx_jobs) j where rn = 1)"""

def _candidates_sql(scope: str, jobs: str = "true") -> str:
    return oracle(
        "fx_job_periods",
        f"scoped as (select * from fx_job_periods where {scope} and workspace_id = '{WORKSPACE}')",
        f"""last_rows as (select *, row_number() over (partition by run_id order by period_end_time desc) as rn
  from scoped where {jobs})""",
        """select run_id, job_id, termination_code, result_state, cast(period_end_time as date) as run_date
from last_rows where rn = 1""",
    )


ORACLE = {
    "terminal_runs": oracle(
        "fx_job_periods",
        RANKED,
        "select workspace_id, job_id, run_id, run_date, result_state, termination_code from terminal",
    ),
    "failure_category": oracle(
        "fx_job_periods", RANKED, f"select workspace_id, run_id, {CATEGORY} from terminal"
    ),
    "daily_failure_matrix": oracle("fx_job_periods", RANKED, _matrix("generic"), "select * from matrix"),
    "daily_failure_matrix_named": oracle(
        "fx_job_periods fx_workspaces",
        RANKED,
        _matrix("pipelines"),
        "select m.*, w.workspace_name from matrix m left join fx_workspaces w on m.workspace_id = w.workspace_id",
    ),
    "exec_rollup": oracle("fx_job_periods", RANKED, _rollup("")),
    "exec_rollup_ws": oracle("fx_job_periods", RANKED, _rollup("workspace_id,")),
    "failure_bands": oracle(
        "fx_job_periods",
        ERRORS,
        f"""select job_failure_band, count(*) as num_jobs, cast(sum(failed_runs) as bigint) as failed_runs,
  round(100.0 * sum(failed_runs) / sum(sum(failed_runs)) over (), 1) as pct_of_exec_errors
from (select *, {BAND} as job_failure_band from per_job) b group by job_failure_band""",
    ),
    "repeat_offenders": oracle(
        "fx_job_periods fx_jobs fx_workspaces",
        ERRORS,
        LATEST_JOB,
        """select e.workspace_id, w.workspace_name, e.job_id, j.name as job_name, e.failed_runs,
  round(100.0 * e.failed_runs / sum(e.failed_runs) over (), 1) as pct_of_exec_errors,
  round(100.0 * sum(e.failed_runs) over (order by e.failed_runs desc, e.job_id, e.workspace_id
    rows between unbounded preceding and current row) / sum(e.failed_runs) over (), 1) as running_pct_cumulative
from per_job e left join latest_job j on e.workspace_id = j.workspace_id and e.job_id = j.job_id
left join fx_workspaces w on e.workspace_id = w.workspace_id
order by e.failed_runs desc, e.job_id, e.workspace_id limit 25""",
    ),
    "latest_by": oracle("fx_jobs", LATEST_JOB, "select * from latest_job"),
    "scope_workspace": oracle(
        "fx_job_periods fx_workspaces",
        """select workspace_id, run_id, run_type, result_state from fx_job_periods
where workspace_id in (select workspace_id from fx_workspaces where workspace_name = 'NATION_2')""",
    ),
    "enrichment_candidates": _candidates_sql(
        f"{SCOPE} and termination_code = '{e.EXECUTION_ERROR}'",
        "job_id in (select job_id from scoped group by job_id having count(*) between 1 and 4)",
    ),
    "all_exec_error_candidates": _candidates_sql(f"{SCOPE} and termination_code = '{e.EXECUTION_ERROR}'"),
    "all_failure_candidates": _candidates_sql(f"{SCOPE} and result_state in ('FAILED', 'ERROR', 'TIMEDOUT')"),
}
