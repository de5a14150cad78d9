"""Registered root-cause queries and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsight.operators import failures as f
from opsight.operators import root_cause as rc
from opsight.plans import failures as pf
from opsight.plans import expected as e
from opsight.plans.common import Inputs, oracle, query
from opsight.scratch import materialize, scratch_path
from opsight.sources.sinks import store_counted


def _tables(t: Inputs) -> rc.RunTables:
    return rc.RunTables(
        t.logical("fx_runs"),
        t.logical("fx_tasks"),
        t.logical("fx_outputs"),
        rc.event_log_errors(t.logical("fx_event_log")),
        materialize,
    )


def _candidates(t: Inputs):
    """Every failed run of the window, not only the newest few."""
    runs = f.terminal_runs(t.logical("fx_job_periods"), t.window(pf.DAYS))
    return runs.filter(F.col("result_state").isin(rc.FAILED))


def _enriched(t: Inputs):
    return rc.enriched_errors(_candidates(t), t.logical("fx_workspaces"), _tables(t))


def _summary(t: Inputs):
    runs, errors = pf._runs(t), pf._errors(t)
    stages = {
        "daily_matrix": f.daily_failure_matrix(runs),
        "exec_rollup": f.exec_rollup(runs),
        "exec_error_bands": f.failure_bands(errors),
        "selected_runs": _candidates(t),
        "enriched": _enriched(t),
    }
    stored = {name: store_counted(df, scratch_path(t.spark, name)) for name, df in stages.items()}
    enriched = stored.pop("enriched")[0]
    rows = {name: n for name, (_, n) in stored.items()}
    summary = rc.run_summary(rows, enriched, rc.reason_rollup(rc.classify_reason(enriched)))
    return summary.drop("sample_enriched_error", "code_failure_reason_breakdown")


def _wrappers(t: Inputs):
    errors = t.logical("fx_outputs")
    wraps = rc.is_wrapper(F.col("error"), F.col("state_message"))
    return errors.select("run_id", wraps.alias("is_wrapper"))


def _child_ids(t: Inputs):
    texts = [F.col(c) for c in ("error", "error_trace", "state_message")]
    return t.logical("fx_outputs").select("run_id", rc.child_run_id(*texts).alias("child_run_id"))


QUERIES = {
    "wrapper_errors": query(_wrappers),
    "child_run_ids": query(_child_ids),
    "event_log_errors": query(lambda t: rc.event_log_errors(t.logical("fx_event_log"))),
    "root_cause": query(lambda t: rc.resolve_root_cause(_tables(t))),
    "enriched_errors": query(_enriched),
    "code_failure_reason": query(
        lambda t: rc.classify_reason(t.logical("fx_task_errors")).select("run_id", "task_key", "code_failure_reason")
    ),
    "reason_rollup": query(lambda t: rc.reason_rollup(rc.classify_reason(t.logical("fx_task_errors")))),
    "run_summary": query(_summary),
}


def _wraps(error: str, message: str = "null") -> str:
    text = f"trim(coalesce(nullif({error}, ''), nullif({message}, ''), ''))"
    return f"({text} <> '' and {text} not like '[%' and regexp_matches({text}, '(?i){e.WRAPPER}'))"


def _ref(text: str) -> str:
    return f"nullif(regexp_extract_all(coalesce({text}, ''), '{e.RUN_REFERENCE}', 1), [])[-1]"


_NAMED = f"try_cast(coalesce({_ref('error')}, {_ref('error_trace')}, {_ref('state_message')}) as bigint)"
FLOWS = """flows as (select pipeline_id, message, details from (select *, row_number() over (partition by pipeline_id
  order by case when level = 'ERROR' then 1 else 0 end desc, event_ts desc, event_seq desc) as rn from fx_event_log
  where level = 'ERROR' or json_extract_string(details, '$.flow_progress.status') = 'FAILED'
    or json_extract_string(details, '$.update_progress.state') = 'FAILED') e where rn = 1)"""
UNITS = f"""units as (select run_id, task_key, task_order, result_state, pipeline_id, task_run_id as unit, state_message as msg, false as solo from fx_tasks
  union all select run_id, null, 0, null, null, run_id, null, true from fx_runs where run_id not in (select run_id from fx_tasks)),
own as (select u.* exclude (msg), case when o.run_id is null then '{e.NO_OUTPUT}' else o.error end as error, o.error_trace,
  coalesce(nullif(u.msg, ''), o.state_message) as state_message, o.child_run_id as child
  from units u left join fx_outputs o on u.unit = o.run_id),
edged as (select *, {_wraps('error', 'state_message')} as wraps, {_NAMED} as named from own),
edges as (select * exclude (wraps, named), case when wraps and not solo then pipeline_id end as flow, case when wraps and not solo then child end as job,
  case when wraps and named <> unit then named end as ref from edged),
u0 as (select *, error as re, error_trace as rt, case when solo then 'child_run_output' else 'task_output' end as rv, 0 as rd from edges)"""


# Every way from a unit along its edges, first the job's, then the reference's, then in task order: the first
# real error on the way counts. Edges between two runs of one circle are not taken.
WALK = f"""counting as (select *, row_number() over () as id from (
  select *, bool_or(coalesce(result_state in ('FAILED', 'ERROR', 'TIMEDOUT'), false)) over (partition by run_id) as any_failed from edges) x),
said as materialized (select c.*, w.message, w.details,
  not any_failed or coalesce(result_state in ('FAILED', 'ERROR', 'TIMEDOUT'), false) as counts,
  case when w.message is null then job end as alt1, case when w.message is null then ref end as alt2
  from counting c left join (select * from flows where nullif(message, '') is not null) w on c.flow = w.pipeline_id),
links as materialized (select distinct run_id as a, unnest([alt1, alt2]) as b from said where counts),
reach as (select a, b from links where b in (select run_id from fx_runs)
  union select r.a, l.b from reach r join links l on r.b = l.a where l.b in (select run_id from fx_runs)),
circle as materialized (select x.a, x.b from reach x join reach y on x.a = y.b and x.b = y.a),
steps as materialized (select s.id as from_id, s.n as alt, k.id as to_id, k.task_order, k.solo as to_solo
  from (select id, run_id, 1 as n, alt1 as child from said where alt1 is not null
        union all select id, run_id, 2, alt2 from said where alt2 is not null) s
  left join said k on s.child = k.run_id and k.counts and s.child in (select run_id from fx_runs)
  where not exists (select 1 from circle c where c.a = s.run_id and c.b = s.child)),
walk as (
  select id as start, id as at, []::bigint[] as path, '' as via, 0 as d from said
  union all
  select w.start, s.to_id, w.path || [s.alt::bigint, coalesce(s.task_order, 0)::bigint],
    w.via || case when s.alt = 2 then 'notebook_run_child/' else '' end || case when s.to_id is null then 'child_run' when s.to_solo then '' else 'child_run/' end,
    w.d + 1
  from walk w join steps s on w.at = s.from_id),
ends as (
  select w.start, w.path, case when w.at is null then '{e.NO_CHILD}' else coalesce(s.message, s.error) end as re,
    case when s.message is not null then s.details else s.error_trace end as rt,
    w.via || case when w.at is null then '' when s.message is not null then 'pipeline_event_log(' || s.flow || ')'
      when s.solo then 'child_run_output' else 'task_output' end as rv,
    w.d + case when s.message is not null then 1 else 0 end as rd
  from walk w left join said s on w.at = s.id where w.d > 0),
first as materialized (select start, min_by(struct_pack(re := re, rt := rt, rv := rv, rd := rd), path) as f
  from ends where nullif(re, '') is not null and not {_wraps('re')} group by start),
best as materialized (select s.* exclude (id, any_failed, message, details, counts, alt1, alt2),
  case when s.message is not null then s.message when f.start is not null then f.f.re else s.error end as re,
  case when s.message is not null then s.details when f.start is not null then f.f.rt else s.error_trace end as rt,
  case when s.message is not null then 'pipeline_event_log(' || s.flow || ')' when f.start is not null then f.f.rv
    when s.solo then 'child_run_output' else 'task_output' end as rv,
  case when s.message is not null then 1 when f.start is not null then f.f.rd else 0 end as rd
  from said s left join first f on s.id = f.start)"""
RESOLVED = (FLOWS, UNITS, WALK)
DEEPEST = "best"
ENRICHED = f"""{pf.RANKED},
mine as (select * from terminal where result_state in ('FAILED', 'ERROR', 'TIMEDOUT')),
found as (select * from {DEEPEST} where not solo union all select * from u0 where solo),
enriched as (select m.workspace_id, w.workspace_name, m.run_id, m.job_id, m.run_date, m.termination_code, x.task_key, x.unit as task_run_id,
  case when g.run_id is null then '{e.NO_RUN}' else x.state_message end as state_message, x.error, x.error_trace, x.re as resolved_error,
  x.rt as resolved_trace, case when x.solo then 'run_output' else x.rv end as resolved_via, coalesce(x.rd, 0) as depth, g.run_page_url
  from mine m left join fx_runs g on m.run_id = g.run_id left join found x on g.run_id = x.run_id
  left join fx_workspaces w on m.workspace_id = w.workspace_id)"""


def _reason(source: str) -> str:
    cases = " ".join(f"when regexp_matches(msg, '{p}') then '{n}'" for n, p, _ in e.REASONS)
    return f"""texts as (select *, coalesce(resolved_error, error, state_message) as text from {source}),
classified as (select *, case {cases} else '{e.OTHER_REASON}' end as code_failure_reason
  from (select *, lower(text) as msg from texts where text is not null and text not like '[%') q)"""


_ADVICE = " ".join(f"when '{n}' then '{a}'" for n, _, a in e.REASONS)
_RUNS = "fx_runs fx_tasks fx_outputs fx_event_log"
_ALL = f"{_RUNS} fx_job_periods fx_workspaces"
_REAL = "(nullif({0}, '') is not null and {0} not like '[%')"

ORACLE = {
    "wrapper_errors": oracle(
        "fx_outputs", f"select run_id, {_wraps('error', 'state_message')} as is_wrapper from fx_outputs"
    ),
    "child_run_ids": oracle("fx_outputs", f"select run_id, {_NAMED} as child_run_id from fx_outputs"),
    "event_log_errors": oracle("fx_event_log", FLOWS, "select * from flows"),
    "root_cause": oracle(
        _RUNS, *RESOLVED,
        f"""select run_id, task_key, task_order, unit as task_run_id, state_message, error, error_trace, re as resolved_error,
  rt as resolved_trace, rv as resolved_via, rd as resolved_depth from {DEEPEST} where not solo""",
        recursive=True,
    ),
    "enriched_errors": oracle(_ALL, *RESOLVED, ENRICHED, "select * from enriched", recursive=True),
    "code_failure_reason": oracle(
        "fx_task_errors", _reason("fx_task_errors"), "select run_id, task_key, code_failure_reason from classified"
    ),
    "reason_rollup": oracle(
        "fx_task_errors", _reason("fx_task_errors"),
        f"""select code_failure_reason, count(*) as failed_runs, count(distinct job_id) as distinct_jobs,
  min(msg) as sample_message, case code_failure_reason {_ADVICE} else '{e.OTHER_ADVICE}' end as recommendation
from classified group by code_failure_reason""",
    ),
    "run_summary": oracle(
        _ALL, *RESOLVED, ENRICHED, pf._matrix("generic"), pf.ERRORS,
        f"""select (select count(*) from matrix) as daily_matrix_rows,
  (select count(distinct case {pf._case(f.CATEGORIES)} else 'x' end) from terminal where {pf.FAILED}) as exec_rollup_rows,
  (select count(distinct {pf.BAND}) from per_job) as exec_error_bands_rows, (select count(*) from mine) as selected_runs_rows,
  count(*) as enriched_task_rows,
  cast(count_if({_REAL.format('resolved_error')} or {_REAL.format('error')}) as bigint) as rows_with_real_error_text,
  cast(count_if(depth > 0 and {_REAL.format('resolved_error')}) as bigint) as rows_resolved_via_child_drilldown from enriched""",
        recursive=True,
    ),
}
