"""Registered utilization and right-sizing queries and the SQL they must agree with."""

from __future__ import annotations

from opsight.operators import advisor as a
from opsight.operators import utilization as u
from opsight.plans.common import AS_OF, MIDNIGHT, Inputs, oracle, query, round_raw
from opsight.plans.cost import prices, usage

DAYS = 25


def _base(t: Inputs):
    return u.cluster_base(t.logical("fx_clusters"), t.window(DAYS))


def _raw(t: Inputs):
    return u.utilization_raw(t.logical("fx_node_timeline"), _base(t), t.window(DAYS))


def _assessed(t: Inputs):
    return u.cluster_assessment(
        t.logical("fx_clusters"), t.logical("fx_node_timeline"), usage(t), prices(t), t.window(DAYS)
    )


def _flags(t: Inputs):
    flags = u.with_flags(
        _base(t), u.utilization_summary(_raw(t)), u.cluster_cost(usage(t), prices(t), _base(t), t.window(DAYS))
    )
    return flags.select("cluster_id", *[c for c in flags.columns if c.startswith("flag_")])


def _advised(t: Inputs):
    return a.per_cluster_utilization(
        t.logical("fx_node_timeline"), t.logical("fx_clusters"), usage(t), prices(t), t.window(DAYS)
    )


def _assessment(t: Inputs):
    return _assessed(t).select("cluster_id", "utilization_category", "reason", "recommendation")


def _per_job(t: Inputs):
    return a.per_job_utilization(usage(t), prices(t), t.logical("fx_jobs"), _advised(t), t.window(DAYS))


BASE_COLUMNS = "cluster_id, cluster_name, owned_by, worker_count, max_autoscale_workers, change_time"

QUERIES = {
    "cluster_base": query(lambda t: _base(t).select(*BASE_COLUMNS.split(", "))),
    "utilization_raw": query(
        lambda t: _raw(t).select("cluster_id", "instance_id", "start_time", "driver", "cpu_active_percent")
    ),
    "utilization_summary": query(lambda t: u.utilization_summary(_raw(t))),
    "cluster_cost": query(lambda t: u.cluster_cost(usage(t), prices(t), _base(t), t.window(DAYS))),
    "cluster_flags": query(_flags),
    "cluster_assessment": query(_assessment),
    "d1_kpis": query(lambda t: u.kpis(_assessed(t))),
    "d2_categories": query(lambda t: u.category_distribution(_assessed(t))),
    "d3_top_cost": query(lambda t: u.top_cost(_assessed(t))),
    "d4_scatter": query(lambda t: u.scatter(_assessed(t))),
    "d5_owners": query(lambda t: u.owners(_assessed(t))),
    "d6_detail": query(lambda t: u.detail(_assessed(t))),
    "d7_autoscale": query(lambda t: u.autoscale_status(_assessed(t))),
    "d8_termination": query(lambda t: u.termination_bands(_assessed(t))),
    "d9_trend": query(lambda t: u.daily_trend(_raw(t))),
    "advisor_stats": query(lambda t: a.advisor_stats(t.logical("fx_node_timeline"), t.window(DAYS))),
    "cluster_spend": query(lambda t: a.cluster_spend(usage(t), prices(t), t.window(DAYS))),
    "per_cluster_utilization": query(_advised),
    "rightsizing": query(lambda t: a.rightsizing(_advised(t), t.logical("fx_node_types"))),
    "hourly_utilization": query(lambda t: a.hourly_utilization(t.logical("fx_node_timeline"), t.window(DAYS))),
    "per_job_utilization": query(_per_job),
    "top_waste": query(lambda t: a.top_waste(_advised(t))),
    "top_pressure": query(lambda t: a.top_pressure(_advised(t))),
    "verdict_summary": query(lambda t: a.verdict_summary(_advised(t))),
}

_START = f"{AS_OF} - interval {DAYS} day"
BASE = f"""base as (select * from (select *, row_number() over (partition by cluster_id order by change_time desc, o_key desc) as rn
  from fx_clusters where cluster_source in ('UI', 'API') and (delete_time is null or delete_time >= {_START})) c where rn = 1)"""
RAW = f"""raw as (select *, coalesce(cpu_user_percent, 0) + coalesce(cpu_system_percent, 0) as cpu_active_percent
  from fx_node_timeline where start_time >= {_START} and cluster_id in (select cluster_id from base))"""
SUMMARY = """per_cluster as (select cluster_id, count(distinct date_trunc('minute', start_time)) as active_minutes,
  count(distinct date_trunc('day', start_time)) as active_days, count(distinct instance_id) as distinct_nodes_seen,
  round(avg(cpu_active_percent), 2) as avg_cpu_percent, round(quantile_disc(cpu_active_percent, 0.5), 2) as p50_cpu_percent,
  round(quantile_disc(cpu_active_percent, 0.95), 2) as p95_cpu_percent, round(max(cpu_active_percent), 2) as max_cpu_percent,
  round(stddev_samp(cpu_active_percent), 2) as stddev_cpu_percent, round(avg(mem_used_percent), 2) as avg_mem_percent,
  round(quantile_disc(mem_used_percent, 0.95), 2) as p95_mem_percent, round(max(mem_used_percent), 2) as max_mem_percent,
  round(avg(mem_swap_percent), 2) as avg_swap_percent,
  cast(sum(case when cpu_active_percent < 10 then 1 else 0 end) as bigint) as idle_minute_samples,
  count(*) as total_minute_samples from raw group by cluster_id),
minutes as (select cluster_id, date_trunc('minute', start_time) as minute,
  cast(sum(case when driver = false then 1 else 0 end) as bigint) as workers_active from raw group by all),
scaling as (select cluster_id, avg(workers_active) as avg_active_workers, min(workers_active) as min_active_workers,
  max(workers_active) as max_active_workers, quantile_disc(workers_active, 0.5) as p50_active_workers,
  quantile_disc(workers_active, 0.95) as p95_active_workers, count(distinct workers_active) as distinct_worker_counts
  from minutes group by cluster_id),
summary as (select p.*, round(100.0 * p.idle_minute_samples / nullif(p.total_minute_samples, 0), 2) as idle_percent,
  s.* exclude (cluster_id) from per_cluster p left join scaling s on p.cluster_id = s.cluster_id)"""
COST = f"""cost as (select u.cluster_id, sum(u.usage_quantity) as total_dbus,
  sum(u.usage_quantity * coalesce(p.price_default, 0)) as estimated_cost_usd, count(distinct u.usage_date) as billed_days
  from fx_usage u left join fx_prices p on u.sku_name = p.sku_name and u.usage_unit = p.usage_unit
    and u.usage_end_time between p.price_start_time and coalesce(p.price_end_time, {AS_OF})
  where u.cluster_id in (select cluster_id from base)
    and u.usage_date >= cast({MIDNIGHT} - interval {DAYS} day as date) group by u.cluster_id)"""
FLAGS = """joined as (select b.*, b.max_autoscale_workers is not null as autoscale_enabled, s.* exclude (cluster_id),
  c.total_dbus, c.estimated_cost_usd from base b left join summary s on b.cluster_id = s.cluster_id
  left join cost c on b.cluster_id = c.cluster_id),
flagged as (select *, p95_cpu_percent >= 85 as flag_cpu_pressure, p95_mem_percent >= 90 as flag_mem_pressure,
  avg_swap_percent > 5 as flag_swap_pressure,
  autoscale_enabled and p95_active_workers >= max_autoscale_workers and max_autoscale_workers > min_autoscale_workers as flag_autoscale_pinned,
  avg_cpu_percent < 20 and p95_cpu_percent < 40 and p95_mem_percent < 50 as flag_low_util,
  idle_percent > 60 as flag_high_idle,
  auto_termination_minutes is null or auto_termination_minutes >= 120 as flag_loose_termination,
  autoscale_enabled and p95_active_workers <= min_autoscale_workers and min_autoscale_workers < max_autoscale_workers
    and avg_cpu_percent < 30 as flag_autoscale_floor_only,
  active_minutes is null or active_minutes < 60 as flag_essentially_unused,
  not autoscale_enabled and worker_count is not null and worker_count >= 4 and avg_cpu_percent < 25 as flag_fixed_oversized
  from joined)"""
ASSESSED = """categorized as (select *, case when flag_essentially_unused then 'IDLE_OR_UNUSED'
    when flag_cpu_pressure or flag_mem_pressure or flag_swap_pressure or flag_autoscale_pinned then 'OVER_UTILIZED'
    when flag_low_util or flag_fixed_oversized or (flag_high_idle and flag_loose_termination) or flag_autoscale_floor_only
      then 'UNDER_UTILIZED' else 'RIGHT_SIZED' end as utilization_category,
  coalesce(cast(auto_termination_minutes as varchar), 'DISABLED') as term_text from flagged),
assessed as (select *, concat_ws(' | ',
  case when flag_cpu_pressure then 'CPU p95 ' || p95_cpu_percent || '% >= 85% (sustained CPU pressure)' end,
  case when flag_mem_pressure then 'Memory p95 ' || p95_mem_percent || '% >= 90% (memory pressure)' end,
  case when flag_swap_pressure then 'Avg swap ' || avg_swap_percent || '% > 5% (memory thrashing)' end,
  case when flag_autoscale_pinned then 'Autoscale pinned at max (' || max_autoscale_workers || ' workers) at p95' end,
  case when flag_low_util then 'Low utilization: avg CPU ' || avg_cpu_percent || '%, p95 CPU ' || p95_cpu_percent
    || '%, p95 mem ' || p95_mem_percent || '%' end,
  case when flag_high_idle and flag_loose_termination then 'Idle ' || idle_percent
    || '% of runtime with auto-termination = ' || term_text || ' min' end,
  case when flag_autoscale_floor_only then 'Autoscale never exceeded floor (' || min_autoscale_workers
    || ' workers); ceiling of ' || max_autoscale_workers || ' unused' end,
  case when flag_fixed_oversized then 'Fixed-size cluster with ' || worker_count || ' workers but avg CPU only '
    || avg_cpu_percent || '%' end,
  case when flag_essentially_unused then 'Cluster ran <60 minutes total in window ('
    || coalesce(cast(active_minutes as varchar), '0') || ' min) — likely abandoned' end) as reason,
  case when flag_essentially_unused then 'DELETE: cluster has been essentially unused. If retained for ad-hoc use, ensure auto-termination is set to 30 minutes or less.'
    when flag_autoscale_pinned and flag_cpu_pressure then 'SCALE UP: raise max_autoscale_workers above ' || max_autoscale_workers
      || ' (workload routinely hits the ceiling). Also consider a larger worker node type since CPU p95 = ' || p95_cpu_percent || '%.'
    when flag_autoscale_pinned then 'RAISE CEILING: increase max_autoscale_workers from ' || max_autoscale_workers
      || ' (workload is pinned at the ceiling at p95). Suggested new max: ' || cast(ceil(max_autoscale_workers * 1.5) as bigint) || '.'
    when flag_mem_pressure or flag_swap_pressure then 'UPGRADE NODE TYPE: move to a memory-optimized worker (e.g., r-series) — sustained memory pressure / swap detected. Also enable elastic disk if not already on.'
    when flag_cpu_pressure then 'UPGRADE NODE TYPE: move to a compute-optimized worker (e.g., c-series) or one with more vCPUs — sustained CPU pressure detected.'
    when flag_fixed_oversized then 'CONVERT TO AUTOSCALING: replace fixed worker_count=' || worker_count || ' with autoscaling min='
      || greatest(1, worker_count // 4) || ', max=' || worker_count || '. Average CPU is only ' || avg_cpu_percent || '%.'
    when flag_autoscale_floor_only then 'LOWER FLOOR: reduce min_autoscale_workers from ' || min_autoscale_workers
      || ' to 1 — workload never scaled above the floor. Keep max at ' || max_autoscale_workers || '.'
    when flag_high_idle and flag_loose_termination then 'TIGHTEN AUTO-TERMINATION: set auto_termination_minutes to 30 (currently '
      || term_text || '). Cluster sits idle ' || idle_percent || '% of runtime.'
    when flag_low_util then 'DOWNSIZE: shift to a smaller worker node type and/or reduce max workers. Avg CPU = ' || avg_cpu_percent
      || '%, p95 mem = ' || p95_mem_percent || '%. If usage is bursty and intermittent, consider migrating workloads to a serverless or job cluster.'
    else 'NO CHANGE: cluster is appropriately sized for its current workload. Continue to monitor.' end as recommendation
  from categorized)"""

STATS = f"""stats as (select workspace_id, cluster_id, count(*) as sample_count, count(distinct instance_id) as distinct_instances,
  avg(busy) as avg_cpu_busy_pct, max(busy) as max_cpu_busy_pct, avg(mem_used_percent) as avg_mem_used_pct,
  max(mem_used_percent) as max_mem_used_pct, avg(mem_swap_percent) as avg_mem_swap_pct, max(mem_swap_percent) as max_mem_swap_pct,
  min(start_time) as first_sample, max(start_time) as last_sample, quantile_cont(busy, 0.5) as p50_cpu_busy_pct,
  quantile_cont(busy, 0.95) as p95_cpu_busy_pct, quantile_cont(mem_used_percent, 0.95) as p95_mem_used_pct
  from (select *, cpu_user_percent + cpu_system_percent as busy from fx_node_timeline where start_time >= {_START}) n
  group by all having count(*) >= 10)"""
_USD = """left join fx_prices p on u.cloud = p.cloud and u.sku_name = p.sku_name and p.currency_code = 'USD'
    and u.usage_start_time >= p.price_start_time and (p.price_end_time is null or u.usage_start_time < p.price_end_time)"""
SPEND = f"""spend as (select u.workspace_id, u.cluster_id, sum(u.usage_quantity) as dbus,
  sum(u.usage_quantity * coalesce(p.price_default, 0)) as list_cost_usd,
  sum(case when u.sku_name ilike '%JOBS%' then u.usage_quantity else 0 end) as jobs_dbus,
  sum(case when u.sku_name ilike '%ALL_PURPOSE%' then u.usage_quantity else 0 end) as allpurpose_dbus
  from fx_usage u {_USD} where u.cluster_id is not null and u.usage_start_time >= {_START} group by all)"""
_QUIET = "s.avg_cpu_busy_pct < 20 and s.p95_cpu_busy_pct < 40 and s.avg_mem_used_pct < 50"
_TENTHS = ["avg_cpu_busy_pct", "p50_cpu_busy_pct", "p95_cpu_busy_pct", "max_cpu_busy_pct"]
_TENTHS += ["avg_mem_used_pct", "p95_mem_used_pct", "max_mem_used_pct"]
ADVISED = f"""config as (select * from (select *, row_number() over (partition by workspace_id, cluster_id
  order by change_time desc, o_key desc) as rn from fx_clusters) c where rn = 1),
advised as (select s.workspace_id, s.cluster_id, c.cluster_name, c.owned_by, c.cluster_source, c.driver_node_type,
  c.worker_node_type, c.worker_count, c.min_autoscale_workers, c.max_autoscale_workers, c.auto_termination_minutes,
  s.sample_count, s.distinct_instances, {', '.join(f'round(s.{n}, 1) as {n}' for n in _TENTHS)},
  round(s.max_mem_swap_pct, 2) as max_mem_swap_pct, coalesce(d.dbus, 0) as dbus_consumed,
  round(coalesce(d.list_cost_usd, 0), 2) as list_cost_usd, coalesce(d.jobs_dbus, 0) as jobs_dbus,
  coalesce(d.allpurpose_dbus, 0) as allpurpose_dbus,
  case when s.max_mem_swap_pct > 1 or s.p95_mem_used_pct > 90 or s.p95_cpu_busy_pct > 90 then 'OVER_UTILIZED'
    when {_QUIET} then 'UNDER_UTILIZED'
    when s.avg_cpu_busy_pct between 20 and 80 and s.p95_cpu_busy_pct < 95 then 'RIGHT_SIZED' else 'REVIEW' end as utilization_verdict,
  case when {_QUIET} then round(coalesce(d.list_cost_usd, 0) * (1 - s.avg_cpu_busy_pct / 100.0) * 0.6, 2) else 0 end as estimated_waste_usd,
  case when s.max_mem_swap_pct > 1 then 'Memory pressure (swap > 1%). Move to memory-optimized worker type or add workers.'
    when s.p95_mem_used_pct > 90 then 'p95 memory > 90%. Move to a larger memory-optimized instance type.'
    when s.p95_cpu_busy_pct > 90 then 'p95 CPU > 90%. Raise max workers or move to a larger compute-optimized instance type.'
    when s.avg_cpu_busy_pct < 20 and s.p95_cpu_busy_pct < 40 then 'Low CPU. Consider Serverless, smaller node type, lower max_autoscale_workers, or shorter auto_termination.'
    when c.auto_termination_minutes is null or c.auto_termination_minutes > 60 then 'auto_termination_minutes high or unset. Reduce to <= 60 for interactive clusters.'
    else 'Healthy. Continue monitoring.' end as recommendation, s.first_sample, s.last_sample
  from stats s left join config c on s.workspace_id = c.workspace_id and s.cluster_id = c.cluster_id
  left join spend d on s.workspace_id = d.workspace_id and s.cluster_id = d.cluster_id)"""
_TERM = "coalesce(cast(auto_termination_minutes as varchar), 'unset')"
_TOPW = "coalesce(cast(top as varchar), '?')"
_NODE = "coalesce(worker_node_type, 'unknown')"
_CORES = "coalesce(cast(core_count as varchar), '?')"
_LOOSE = "auto_termination_minutes is null or auto_termination_minutes > 60"
RIGHTSIZED = f"""scored as (select a.*, n.core_count, round(n.memory_mb / 1024.0, 1) as gb,
  coalesce(a.max_autoscale_workers, a.worker_count) as top,
  greatest(1, cast(ceil(coalesce(a.max_autoscale_workers, a.worker_count, 1) * (a.avg_cpu_busy_pct / 60.0)) as bigint)) as target
  from advised a left join fx_node_types n on a.worker_node_type = n.node_type)
select workspace_id, cluster_id, cluster_name, owned_by, cluster_source, utilization_verdict, concat_ws(' | ',
  case when avg_cpu_busy_pct < 20 then 'avg CPU < 20% (idle)' end, case when p95_cpu_busy_pct < 40 then 'p95 CPU < 40% (no bursts)' end,
  case when avg_mem_used_pct < 50 then 'avg memory < 50% (RAM headroom)' end, case when p95_cpu_busy_pct > 90 then 'p95 CPU > 90% (CPU-bound)' end,
  case when p95_mem_used_pct > 90 then 'p95 memory > 90% (memory-bound)' end, case when max_mem_swap_pct > 1 then 'swap > 1% (memory pressure)' end,
  case when {_LOOSE} then 'auto_termination = ' || {_TERM} || ' min (high)' end) as reasons,
  worker_node_type as current_worker_type, core_count as current_worker_cores, gb as current_worker_memory_gb,
  worker_count as current_worker_count, min_autoscale_workers as current_min_workers, max_autoscale_workers as current_max_workers,
  auto_termination_minutes as current_auto_term_minutes, avg_cpu_busy_pct, p95_cpu_busy_pct, avg_mem_used_pct, p95_mem_used_pct,
  max_mem_swap_pct, list_cost_usd, estimated_waste_usd,
  case when utilization_verdict = 'UNDER_UTILIZED' then target end as recommended_workers,
  case when max_mem_swap_pct > 1 or p95_mem_used_pct > 90 then 'Memory-bound. Move to a memory-optimized worker type (e.g., r-family) or increase worker count from '
      || {_TOPW} || ' to ' || coalesce(cast(top + greatest(1, cast(ceil(top * 0.5) as bigint)) as varchar), '?') || '. Current: ' || {_NODE}
      || ' (' || {_CORES} || ' vCPU / ' || coalesce(cast(gb as varchar), '?') || ' GB).'
    when p95_cpu_busy_pct > 90 then 'CPU-bound. Raise max_autoscale_workers from ' || {_TOPW} || ' to ' || coalesce(cast(top * 2 as varchar), '?')
      || ', or move to a compute-optimized worker (e.g., c-family). Current: ' || {_NODE} || ' (' || {_CORES} || ' vCPU).'
    when avg_cpu_busy_pct < 10 and p95_cpu_busy_pct < 30 then 'Mostly idle (avg ' || avg_cpu_busy_pct || '%, p95 ' || p95_cpu_busy_pct
      || '%). Strongly consider Serverless or shutting down. If kept, reduce max workers from ' || {_TOPW} || ' to ' || target || '.'
    when utilization_verdict = 'UNDER_UTILIZED' then 'Reduce max_autoscale_workers from ' || {_TOPW} || ' to ' || target || ' (targets ~60% avg CPU). '
      || case when avg_mem_used_pct < 30 and core_count >= 8 then 'Both CPU and memory are low; consider downsizing node type from '
        || coalesce(worker_node_type, 'current') || ' to a smaller tier.' else 'Keep worker node type the same.' end
      || case when {_LOOSE} then ' Also reduce auto_termination from ' || {_TERM} || ' min to 60.' else '' end
    when {_LOOSE} then 'Healthy CPU/memory. Reduce auto_termination from ' || {_TERM} || ' min to 60 to free idle time.'
    else 'Within healthy utilization band. No action needed.' end as recommended_action,
  '#setting/clusters/' || cluster_id || '/configuration' as cluster_config_path from scored"""

_N = "fx_clusters fx_node_timeline"
_A = "fx_clusters fx_node_timeline fx_usage fx_prices"
_CHAIN = (BASE, RAW, SUMMARY, COST, FLAGS, ASSESSED)
_ADVISOR = (STATS, SPEND, ADVISED)
_COUNTS = {
    "over_utilized": "OVER_UTILIZED",
    "under_utilized": "UNDER_UTILIZED",
    "right_sized": "RIGHT_SIZED",
    "idle_or_unused": "IDLE_OR_UNUSED",
}


def _counts(*names: str) -> str:
    return ", ".join(
        f"cast(count_if(utilization_category = '{_COUNTS[n]}') as bigint) as {n}" for n in names
    )


_AUTOSCALE = """case when not autoscale_enabled then 'No autoscale (fixed)' when p95_active_workers >= max_autoscale_workers then 'Pinned at ceiling'
  when p95_active_workers <= min_autoscale_workers and min_autoscale_workers < max_autoscale_workers then 'Stuck at floor'
  else 'Scaling normally' end"""
_BAND = """case when auto_termination_minutes is null then 'DISABLED (risky)' when auto_termination_minutes <= 30 then '<= 30 min (good)'
  when auto_termination_minutes <= 60 then '31 – 60 min (ok)' when auto_termination_minutes <= 120 then '61 – 120 min (loose)'
  else '> 120 min (too loose)' end"""
_TOP = "cluster_id, cluster_name, cluster_source, worker_node_type, worker_count"

ORACLE = {
    "cluster_base": oracle("fx_clusters", BASE, f"select {BASE_COLUMNS} from base"),
    "utilization_raw": oracle(
        _N, BASE, RAW, "select cluster_id, instance_id, start_time, driver, cpu_active_percent from raw"
    ),
    "utilization_summary": oracle(_N, BASE, RAW, SUMMARY, "select * from summary"),
    "cluster_cost": oracle("fx_clusters fx_usage fx_prices", BASE, COST, "select * from cost"),
    "cluster_flags": oracle(
        _A, BASE, RAW, SUMMARY, COST, FLAGS, "select cluster_id, columns('flag_.*') from flagged"
    ),
    "cluster_assessment": oracle(
        _A, *_CHAIN, "select cluster_id, utilization_category, reason, recommendation from assessed"
    ),
    "d1_kpis": oracle(
        _A, *_CHAIN,
        f"""select count(*) as total_clusters, {_counts(*_COUNTS)}, round(sum(estimated_cost_usd), 2) as total_cost_usd,
  round(sum(case when utilization_category in ('UNDER_UTILIZED', 'IDLE_OR_UNUSED') then estimated_cost_usd * 0.4 else 0 end), 2) as estimated_savings_usd,
  round(sum(total_dbus), 2) as total_dbus from assessed""",
    ),
    "d2_categories": oracle(
        _A, *_CHAIN,
        """select utilization_category, count(*) as cluster_count, round(sum(estimated_cost_usd), 2) as cost_usd
from assessed group by utilization_category""",
    ),
    "d3_top_cost": oracle(
        _A, *_CHAIN,
        """select cluster_name, utilization_category, round(estimated_cost_usd, 2) as cost_usd, avg_cpu_percent, p95_cpu_percent
from assessed where estimated_cost_usd is not null order by estimated_cost_usd desc, cluster_id limit 20""",
    ),
    "d4_scatter": oracle(
        _A, *_CHAIN,
        """select cluster_id, cluster_name, utilization_category, coalesce(avg_cpu_percent, 0) as avg_cpu_percent,
  coalesce(p95_cpu_percent, 0) as p95_cpu_percent, coalesce(estimated_cost_usd, 0) as estimated_cost_usd,
  coalesce(total_dbus, 0) as total_dbus from assessed""",
    ),
    "d5_owners": oracle(
        _A, *_CHAIN,
        f"""select owned_by, count(*) as cluster_count, {_counts('under_utilized', 'over_utilized', 'idle_or_unused')},
  round(sum(estimated_cost_usd), 2) as total_cost_usd from assessed where owned_by is not null group by owned_by
order by total_cost_usd desc nulls last, owned_by limit 25""",
    ),
    "d6_detail": oracle(
        _A, *_CHAIN,
        """select cluster_name, utilization_category as category, owned_by, driver_node_type, worker_node_type,
  case when autoscale_enabled then min_autoscale_workers || ' – ' || max_autoscale_workers || ' (autoscale)'
    else worker_count || ' (fixed)' end as worker_config, auto_termination_minutes as auto_term_min, active_days,
  avg_cpu_percent, p95_cpu_percent, p95_mem_percent, idle_percent, p95_active_workers,
  round(estimated_cost_usd, 2) as cost_usd, reason, recommendation from assessed""",
    ),
    "d7_autoscale": oracle(
        _A, *_CHAIN,
        f"""select {_AUTOSCALE} as autoscale_status, count(*) as cluster_count, round(avg(avg_cpu_percent), 2) as avg_cpu,
  round(sum(estimated_cost_usd), 2) as total_cost_usd from assessed group by 1""",
    ),
    "d8_termination": oracle(
        _A, *_CHAIN,
        f"""select {_BAND} as termination_band, count(*) as cluster_count, round(avg(idle_percent), 2) as avg_idle_percent,
  round(sum(estimated_cost_usd), 2) as total_cost_usd from assessed group by 1""",
    ),
    "d9_trend": oracle(
        _N, BASE, RAW,
        """select date_trunc('day', start_time) as day, round(avg(cpu_active_percent), 2) as avg_cpu_percent,
  round(avg(mem_used_percent), 2) as avg_mem_percent, count(distinct cluster_id) as active_clusters from raw group by 1""",
    ),
    "advisor_stats": oracle("fx_node_timeline", STATS, "select * from stats"),
    "cluster_spend": oracle("fx_usage fx_prices", SPEND, "select * from spend"),
    "per_cluster_utilization": oracle(_A, *_ADVISOR, "select * from advised"),
    "rightsizing": oracle(_A + " fx_node_types", *_ADVISOR[:2], ADVISED + ",\n" + RIGHTSIZED.split("\nselect", 1)[0], "select" + RIGHTSIZED.split("\nselect", 1)[1]),
    "hourly_utilization": oracle(
        "fx_node_timeline",
        f"""select workspace_id, cluster_id, date_trunc('hour', start_time) as hour_bucket,
  avg(cpu_user_percent + cpu_system_percent) as avg_cpu_busy_pct,
  quantile_cont(cpu_user_percent + cpu_system_percent, 0.95) as p95_cpu_busy_pct, avg(mem_used_percent) as avg_mem_used_pct,
  quantile_cont(mem_used_percent, 0.95) as p95_mem_used_pct, max(mem_swap_percent) as max_mem_swap_pct,
  count(distinct instance_id) as active_instances from fx_node_timeline where start_time >= {_START} group by all""",
    ),
    "per_job_utilization": oracle(
        _A + " fx_jobs", *_ADVISOR,
        f"""spent as (select u.workspace_id, u.job_id, u.cluster_id, round(sum(u.usage_quantity), 2) as dbus,
  round(sum(u.usage_quantity * coalesce(p.price_default, 0)), 2) as list_cost_usd
  from fx_usage u {_USD} where u.job_id is not null and u.usage_start_time >= {_START} and u.sku_name ilike '%JOBS%' group by all),
names as (select * from (select *, row_number() over (partition by workspace_id, job_id order by change_time desc, name desc) as rn
  from fx_jobs) j where rn = 1)""",
        """select s.*, n.name as job_name, a.utilization_verdict, a.recommendation, a.avg_cpu_busy_pct, a.p95_cpu_busy_pct,
  a.avg_mem_used_pct, a.p95_mem_used_pct, a.estimated_waste_usd
from spent s left join names n on s.workspace_id = n.workspace_id and s.job_id = n.job_id
left join advised a on s.workspace_id = a.workspace_id and s.cluster_id = a.cluster_id""",
    ),
    "top_waste": oracle(
        _A, *_ADVISOR,
        f"""select {_TOP}, avg_cpu_busy_pct, p95_cpu_busy_pct, avg_mem_used_pct, list_cost_usd, estimated_waste_usd, recommendation
from advised where utilization_verdict = 'UNDER_UTILIZED' order by estimated_waste_usd desc, workspace_id, cluster_id limit 25""",
    ),
    "top_pressure": oracle(
        _A, *_ADVISOR,
        f"""select {_TOP}, p95_cpu_busy_pct, p95_mem_used_pct, max_mem_swap_pct, list_cost_usd, recommendation
from advised where utilization_verdict = 'OVER_UTILIZED' order by list_cost_usd desc, workspace_id, cluster_id limit 25""",
    ),
    "verdict_summary": oracle(
        _A, *_ADVISOR,
        """select utilization_verdict, count(*) as cluster_count, round(sum(list_cost_usd), 2) as list_cost_usd,
  round(sum(estimated_waste_usd), 2) as estimated_waste_usd from advised group by utilization_verdict""",
    ),
}

round_raw(
    QUERIES,
    ORACLE,
    {
        "utilization_summary": "avg_active_workers",
        "cluster_cost": "total_dbus estimated_cost_usd",
        "d4_scatter": "estimated_cost_usd total_dbus",
        "advisor_stats": "avg_cpu_busy_pct avg_mem_used_pct avg_mem_swap_pct p50_cpu_busy_pct p95_cpu_busy_pct p95_mem_used_pct",
        "cluster_spend": "dbus list_cost_usd jobs_dbus allpurpose_dbus",
        "per_cluster_utilization": "dbus_consumed jobs_dbus allpurpose_dbus",
        "hourly_utilization": "avg_cpu_busy_pct p95_cpu_busy_pct avg_mem_used_pct p95_mem_used_pct",
    },
)
