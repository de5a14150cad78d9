"""Registered queries over facts, rollups and sketches that are stored by day, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsight import sql
from opsight.operators import rollups, sketches
from opsight.operators import utilization as u
from opsight.plans import utilization as pu
from opsight.plans.common import AS_OF, Inputs, oracle, query, round_raw
from opsight.plans import cost as pc
from opsight.plans import failures as pf
from opsight.plans.cost import history, usage
from opsight.scratch import scratch_path
from opsight.sources.day_tables import DayTable

ERROR = 0.02


def _rollups(t: Inputs) -> rollups.CostRollups:
    """Two loads: most facts, then late ones of every fifth day, which rewrite those days only."""
    tables = [DayTable(t.spark, scratch_path(t.spark, n), ts) for n, ts in
              (("history", "start_time"), ("usage", "usage_start_time"), ("by-warehouse", "hour_ts"), ("by-user", "hour_ts"))]
    stored = rollups.CostRollups(*tables)
    facts, bills = history(t), usage(t).select("warehouse_id", "usage_quantity", "usage_start_time")
    late = (F.col("statement_id") % 7 == 3) & (F.dayofmonth("start_time") % 5 == 0)
    stored.load(facts.filter(~late), bills)
    stored.load(facts.filter(late), bills.limit(0))
    return stored


def _nodes_by_day(t: Inputs) -> DayTable:
    table = DayTable(t.spark, scratch_path(t.spark, "node-timeline"), "start_time")
    table.append(t.logical("fx_node_timeline"))
    return table


def _by_day(t: Inputs):
    window = t.window(pu.DAYS)
    nodes = _nodes_by_day(t).within(window, t.logical("fx_node_timeline").schema)
    return u.utilization_summary(u.utilization_raw(nodes, pu._base(t), window))


def _sketched(t: Inputs):
    """Sketches of every day are stored; a window of whole days is merged from them and held against the facts."""
    cpu = F.coalesce("cpu_user_percent", F.lit(0)) + F.coalesce("cpu_system_percent", F.lit(0))
    values = {"cpu": cpu, "mem": F.col("mem_used_percent")}
    nodes = t.logical("fx_node_timeline")
    stored = DayTable(t.spark, scratch_path(t.spark, "sketches"), "day_start")
    stored.append(sketches.daily_sketches(nodes, ["cluster_id"], "start_time", values))
    window = t.window(pu.DAYS)
    in_window = window.since_midnight(F.col("day_start"))
    found = sketches.merged_quantiles(stored.within(window).filter(in_window), ["cluster_id"], {"cpu": [0.5, 0.95], "mem": [0.95]})
    checks = {"cpu_p50": (cpu, 0.5), "cpu_p95": (cpu, 0.95), "mem_p95": (values["mem"], 0.95)}
    facts = nodes.filter(window.since_midnight(F.col("start_time")))
    return found.select("cluster_id", "n").join(sketches.rank_within(facts, found, ["cluster_id"], checks, ERROR), "cluster_id")


def _tables(t: Inputs) -> dict:
    return {
        "job_run_periods": t.logical("fx_job_periods"),
        "workspaces": t.logical("fx_workspaces"),
        "query_history": history(t),
        "usage": usage(t),
        "prices": pc.prices(t),
        "warehouses": pc.warehouses(t),
    }


def _sql_matrix(t: Inputs):
    text = """select workspace_name, failure_category, sum(runs) as runs from {failure_matrix}
where runs >= :least group by workspace_name, failure_category"""
    return sql.run(t.spark, _tables(t), text, as_of=t.as_of(), lookback_days=pf.DAYS, workspace_id="2", least=2)


def _sql_cost(t: Inputs):
    text = """select warehouse_id, est_tagged_cost_usd, tagged_pct_of_wh_cost from {cost_summary}
where array_contains(:warehouses, warehouse_id)"""
    values = {"as_of": t.as_of(), "lookback_days": pc.DAYS, "space_ids": "space_0,space_2", "warehouses": ["wh_1", "wh_2", "it's"]}
    return sql.run(t.spark, _tables(t), text, **values)


QUERIES = {
    "sql_failure_matrix": query(_sql_matrix),
    "sql_cost_summary": query(_sql_cost),
    "rollup_refreshed": query(lambda t: _rollups(t).warehouse_hours().withColumn("dbus", F.col("dbus").cast("double"))),
    "rollup_refreshed_users": query(lambda t: _rollups(t).user_hours()),
    "utilization_by_day": query(_by_day),
    "utilization_sketched": query(_sketched),
}

ORACLE = {
    "sql_failure_matrix": f"""select workspace_name, failure_category, cast(sum(runs) as bigint) as runs
from ({pf.ORACLE['daily_failure_matrix_named']}) q where runs >= 2 and workspace_id = '2' group by all""",
    "sql_cost_summary": f"""select warehouse_id, est_tagged_cost_usd, tagged_pct_of_wh_cost
from ({pc.ORACLE['warehouse_summary']}) q where warehouse_id in ('wh_1', 'wh_2')""",
    "rollup_refreshed": oracle(
        "fx_query_history fx_usage",
        """seen as (select distinct warehouse_id from fx_query_history where space_id is not null and warehouse_id is not null),
active as (select warehouse_id, date_trunc('hour', start_time) as hour_ts, cast(sum(total_duration_ms) as bigint) as total_ms,
  count(*) as statements from fx_query_history where warehouse_id is not null group by all),
billed as (select warehouse_id, date_trunc('hour', usage_start_time) as hour_ts, cast(sum(cast(usage_quantity as decimal(38, 9))) as double) as dbus
  from fx_usage where warehouse_id is not null group by all)""",
        """select coalesce(a.warehouse_id, b.warehouse_id) as warehouse_id, coalesce(a.hour_ts, b.hour_ts) as hour_ts, total_ms, statements, dbus
from active a full join billed b on a.warehouse_id = b.warehouse_id and a.hour_ts = b.hour_ts
where coalesce(a.warehouse_id, b.warehouse_id) in (select warehouse_id from seen)""",
    ),
    "rollup_refreshed_users": oracle(
        "fx_query_history",
        """select space_id, warehouse_id, date_trunc('hour', start_time) as hour_ts, executed_by as user_email,
  cast(sum(total_duration_ms) as bigint) as tagged_ms, count(*) as tagged_queries
from fx_query_history where warehouse_id is not null and space_id is not null group by all""",
    ),
    "utilization_by_day": pu.ORACLE["utilization_summary"],
    "utilization_sketched": oracle(
        "fx_node_timeline",
        f"""select cluster_id, count(*) as n, true as cpu_p50_close, true as cpu_p95_close, true as mem_p95_close
from fx_node_timeline where start_time >= date_trunc('day', {AS_OF}) - interval {pu.DAYS} day group by cluster_id""",
    ),
}

round_raw(QUERIES, {}, {"utilization_by_day": "avg_active_workers"})
