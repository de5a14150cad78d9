"""Registered cost-attribution queries and the SQL they must agree with."""

from __future__ import annotations

from opsight.operators import cost as c
from opsight.plans.common import AS_OF, MIDNIGHT, Inputs, oracle, query, round_raw
from opsight.sources import platform as p

DAYS = 20
SPACES = c.split_ids("space_0,space_2")
SPACE = "space_1"
UNIT_PRICE = 0.7


def history(t: Inputs):
    return p.query_history(p.nested_history(t.logical("fx_query_history")))


def usage(t: Inputs):
    return p.usage(p.nested_usage(t.logical("fx_usage")))


def prices(t: Inputs):
    return p.prices(p.nested_prices(t.logical("fx_prices")))


def warehouses(t: Inputs):
    return t.logical("fx_warehouses")


def _billing(t: Inputs):
    return c.warehouse_billing(usage(t), prices(t), t.window(DAYS))


def _allocated(t: Inputs):
    w = t.window(DAYS)
    return c.allocate(
        c.tagged_activity(history(t), w, SPACES), c.all_activity(history(t), w), _billing(t), ["warehouse_id"]
    )


def _pit(t: Inputs):
    w = t.window(DAYS)
    hours = c.all_activity(history(t), w).select("warehouse_id", "hour_ts")
    return c.config_at_hour(hours, warehouses(t), w).select(
        "warehouse_id", "hour_ts", "warehouse_size", "max_clusters", "auto_stop_minutes"
    )


QUERIES = {
    "wh_hour_activity": query(lambda t: c.all_activity(history(t), t.window(DAYS))),
    "tagged_activity": query(
        lambda t: c.tagged_activity(history(t), t.window(DAYS), SPACES, ["usage_date", "space_id", "user_email"])
    ),
    "tagged_activity_users": query(lambda t: c.tagged_activity_with_users(history(t), t.window(DAYS), SPACES)),
    "warehouse_billing": query(_billing),
    "warehouse_totals": query(lambda t: c.warehouse_totals(_billing(t))),
    "allocated_cost": query(_allocated),
    "warehouse_summary": query(
        lambda t: c.warehouse_summary(history(t), usage(t), prices(t), warehouses(t), t.window(DAYS), SPACES)
    ),
    "user_daily_cost": query(lambda t: c.user_daily(history(t), usage(t), prices(t), t.window(DAYS), SPACES)),
    "user_combined_cost": query(
        lambda t: c.user_combined(history(t), usage(t), prices(t), warehouses(t), t.window(DAYS), SPACES)
    ),
    "pit_config": query(_pit),
    "hourly_breakdown": query(
        lambda t: c.hourly_breakdown(history(t), usage(t), prices(t), warehouses(t), t.window(DAYS), SPACES)
    ),
    "rollup_wh_hourly": query(lambda t: c.rollup_wh_hourly(history(t), usage(t), t.window(DAYS))),
    "rollup_space_user": query(lambda t: c.rollup_space_user_hourly(history(t), t.window(DAYS))),
    "rollup_wh_config": query(lambda t: c.rollup_wh_config(warehouses(t))),
    "rollup_priced": query(
        lambda t: c.apply_unit_price(c.rollup_wh_hourly(history(t), usage(t), t.window(DAYS)), UNIT_PRICE)
    ),
    "recent_tagged": query(lambda t: c.recent_tagged(history(t), t.window(DAYS))),
    "user_query_stats": query(lambda t: c.user_query_stats(history(t), t.window(DAYS))),
    "task_share": query(lambda t: c.task_share(history(t), t.window(DAYS))),
    "attributed_cost": query(
        lambda t: c.attributed_cost(history(t), usage(t), prices(t), t.window(DAYS), SPACE)
    ),
}

_START = f"{AS_OF} - interval {DAYS} day"
_FROM_MIDNIGHT = f"{MIDNIGHT} - interval {DAYS} day"
_IN = f"warehouse_id is not null and start_time >= {_START} and start_time < {AS_OF}"
_TAG = f"{_IN} and space_id in ('space_0', 'space_2')"
ACTIVITY = f"""activity as (select warehouse_id, date_trunc('hour', start_time) as hour_ts,
  cast(sum(total_duration_ms) as bigint) as total_ms from fx_query_history where {_IN} group by all)"""


def _tagged(grain: str) -> str:
    return f"""tagged as (select warehouse_id, date_trunc('hour', start_time) as hour_ts, {grain}
  cast(sum(total_duration_ms) as bigint) as tagged_ms, count(*) as tagged_queries
  from fx_query_history where {_TAG} group by all)"""


_DAY, _SPACE, _USER = "cast(start_time as date) as usage_date,", "space_id,", "executed_by as user_email,"
USERS = f"""tagged as (select warehouse_id, date_trunc('hour', start_time) as hour_ts, space_id,
  cast(sum(total_duration_ms) as bigint) as tagged_ms, count(*) as tagged_queries,
  count(distinct executed_by) as active_users, string_agg(distinct executed_by, ', ' order by executed_by) as user_list
  from fx_query_history where {_TAG} group by all)"""
BILLING = f"""billing as (select u.warehouse_id, date_trunc('hour', u.usage_start_time) as hour_ts,
  sum(u.usage_quantity) as dbus, sum(u.usage_quantity * p.price_effective) as cost_usd
  from fx_usage u join fx_prices p on u.cloud = p.cloud and u.sku_name = p.sku_name
    and u.usage_start_time >= p.price_start_time and (p.price_end_time is null or u.usage_start_time < p.price_end_time)
  where u.warehouse_id is not null and u.usage_start_time >= {_START} and u.usage_start_time < {AS_OF} group by all)"""
TOTALS = """totals as (select warehouse_id, count(distinct hour_ts) as running_hours, round(sum(dbus), 2) as wh_total_dbus,
  round(sum(cost_usd), 2) as wh_total_cost_usd, round(avg(cost_usd), 2) as avg_cost_per_hour,
  round(min(cost_usd), 2) as min_cost_per_hour, round(quantile_cont(cost_usd, 0.5), 2) as median_cost_per_hour,
  round(quantile_cont(cost_usd, 0.9), 2) as p90_cost_per_hour, round(max(cost_usd), 2) as max_cost_per_hour
  from billing group by warehouse_id)"""
SHARED = """shared as (select t.*, a.total_ms, b.dbus, b.cost_usd from tagged t
  join activity a on t.warehouse_id = a.warehouse_id and t.hour_ts = a.hour_ts
  join billing b on t.warehouse_id = b.warehouse_id and t.hour_ts = b.hour_ts where a.total_ms > 0)"""
CONFIG = """config as (select * from (select *, row_number() over (partition by warehouse_id order by change_time desc) as rn
  from fx_warehouses) w where rn = 1)"""
SPANS = """spans as (select *, lead(change_time) over (partition by warehouse_id order by change_time) as next_change
  from fx_warehouses)"""
ROLLUP = f"""seen as (select distinct warehouse_id from fx_query_history where {_IN} and space_id is not null),
act as (select * from activity where warehouse_id in (select warehouse_id from seen)),
bil as (select warehouse_id, date_trunc('hour', usage_start_time) as hour_ts, sum(usage_quantity) as dbus from fx_usage
  where warehouse_id in (select warehouse_id from seen) and usage_start_time >= {_START} and usage_start_time < {AS_OF} group by all),
rolled as (select coalesce(a.warehouse_id, b.warehouse_id) as warehouse_id, coalesce(a.hour_ts, b.hour_ts) as hour_ts,
  a.total_ms, b.dbus from act a full outer join bil b on a.warehouse_id = b.warehouse_id and a.hour_ts = b.hour_ts)"""


def _cost(prefix: str) -> str:
    return f"""cast(sum(tagged_queries) as bigint) as tagged_queries, round(sum(tagged_ms) / 1000.0, 1) as tagged_active_sec,
  round(sum(dbus * tagged_ms / total_ms), 4) as est_{prefix}_dbus,
  round(sum(cost_usd * tagged_ms / total_ms), 4) as est_{prefix}_cost_usd"""


_H = "fx_query_history"
_HUP = "fx_query_history fx_usage fx_prices"
_ALL = "fx_query_history fx_usage fx_prices fx_warehouses"
_CFG = "c.warehouse_name, c.warehouse_size, c.warehouse_type, c.min_clusters, c.max_clusters, c.auto_stop_minutes"

ORACLE = {
    "wh_hour_activity": oracle(_H, ACTIVITY, "select * from activity"),
    "tagged_activity": oracle(_H, _tagged(_DAY + _SPACE + _USER), "select * from tagged"),
    "tagged_activity_users": oracle(_H, USERS, "select * from tagged"),
    "warehouse_billing": oracle("fx_usage fx_prices", BILLING, "select * from billing"),
    "warehouse_totals": oracle("fx_usage fx_prices", BILLING, TOTALS, "select * from totals"),
    "allocated_cost": oracle(
        _HUP, _tagged(""), ACTIVITY, BILLING, SHARED,
        f"select warehouse_id, {_cost('tagged')} from shared group by warehouse_id",
    ),
    "warehouse_summary": oracle(
        _ALL, _tagged(""), ACTIVITY, BILLING, SHARED, TOTALS, CONFIG,
        f"cost as (select warehouse_id, {_cost('tagged')} from shared group by warehouse_id)",
        f"""select g.* exclude (tagged_active_sec), {_CFG}, t.running_hours, t.wh_total_dbus, t.wh_total_cost_usd,
  t.avg_cost_per_hour as avg_cost_per_running_hour, t.min_cost_per_hour, t.median_cost_per_hour, t.p90_cost_per_hour,
  t.max_cost_per_hour, round(100.0 * g.est_tagged_cost_usd / nullif(t.wh_total_cost_usd, 0), 4) as tagged_pct_of_wh_cost
from cost g join totals t on g.warehouse_id = t.warehouse_id left join config c on g.warehouse_id = c.warehouse_id""",
    ),
    "user_daily_cost": oracle(
        _HUP, _tagged(_DAY + _SPACE + _USER), ACTIVITY, BILLING, SHARED,
        f"""cost as (select usage_date, space_id, user_email, warehouse_id, {_cost('user')} from shared group by all)""",
        """daily as (select warehouse_id, cast(hour_ts as date) as usage_date, sum(cost_usd) as day_cost
  from billing group by all)""",
        """select g.*, round(d.day_cost, 2) as warehouse_day_cost_usd,
  round(100.0 * g.est_user_cost_usd / nullif(d.day_cost, 0), 4) as user_pct_of_wh_day_cost
from cost g left join daily d on g.warehouse_id = d.warehouse_id and g.usage_date = d.usage_date""",
    ),
    "user_combined_cost": oracle(
        _ALL, _tagged(_SPACE + _USER), ACTIVITY, BILLING, SHARED, TOTALS, CONFIG,
        f"cost as (select space_id, user_email, warehouse_id, {_cost('user')} from shared group by all)",
        f"""select g.* exclude (warehouse_id), {_CFG}, t.* exclude (warehouse_id, wh_total_dbus),
  round(100.0 * g.est_user_cost_usd / nullif(t.wh_total_cost_usd, 0), 4) as user_pct_of_wh_cost
from cost g join totals t on g.warehouse_id = t.warehouse_id left join config c on g.warehouse_id = c.warehouse_id""",
    ),
    "pit_config": oracle(
        "fx_query_history fx_warehouses", ACTIVITY, SPANS,
        """select a.warehouse_id, a.hour_ts, s.warehouse_size, s.max_clusters, s.auto_stop_minutes
from activity a left join spans s on a.warehouse_id = s.warehouse_id and s.change_time <= a.hour_ts
  and (s.next_change is null or a.hour_ts < s.next_change)""",
    ),
    "hourly_breakdown": oracle(
        _ALL, USERS, ACTIVITY, BILLING, SHARED, SPANS,
        """select g.hour_ts, g.space_id, g.warehouse_id, s.warehouse_name, s.warehouse_size, s.min_clusters, s.max_clusters,
  s.auto_stop_minutes, round(g.dbus, 2) as wh_hour_dbus, round(g.cost_usd, 2) as wh_hour_cost_usd,
  round(g.total_ms / 1000.0, 1) as all_active_sec, g.active_users, g.user_list, g.tagged_queries,
  round(g.tagged_ms / 1000.0, 1) as tagged_active_sec, round(g.dbus * g.tagged_ms / g.total_ms, 4) as est_tagged_dbus,
  round(g.cost_usd * g.tagged_ms / g.total_ms, 4) as est_tagged_cost_usd,
  round(100.0 * g.tagged_ms / g.total_ms, 2) as tagged_pct_of_hour
from shared g left join spans s on g.warehouse_id = s.warehouse_id and s.change_time <= g.hour_ts
  and (s.next_change is null or g.hour_ts < s.next_change)""",
    ),
    "rollup_wh_hourly": oracle("fx_query_history fx_usage", ACTIVITY, ROLLUP, "select * from rolled"),
    "rollup_space_user": oracle(
        _H,
        f"""select space_id, warehouse_id, date_trunc('hour', start_time) as hour_ts, executed_by as user_email,
  cast(sum(total_duration_ms) as bigint) as tagged_ms, count(*) as tagged_queries
from fx_query_history where {_IN} and space_id is not null group by all""",
    ),
    "rollup_wh_config": oracle(
        "fx_warehouses", CONFIG,
        "select warehouse_id, warehouse_name, warehouse_size, min_clusters, max_clusters, auto_stop_minutes from config",
    ),
    "rollup_priced": oracle(
        "fx_query_history fx_usage", ACTIVITY, ROLLUP,
        f"select *, round(dbus * cast({UNIT_PRICE} as double), 4) as cost_usd from rolled",
    ),
    "recent_tagged": oracle(
        _H,
        f"""select statement_id, executed_by, space_id, client_application, execution_status, total_duration_ms, start_time
from fx_query_history where start_time >= {_FROM_MIDNIGHT} and space_id is not null
order by start_time desc, statement_id desc limit 1000""",
    ),
    "user_query_stats": oracle(
        _H,
        f"""select space_id, executed_by, count(*) as total_queries,
  cast(count_if(execution_status = 'FINISHED') as bigint) as successful_queries,
  cast(count_if(execution_status = 'FAILED') as bigint) as failed_queries,
  round(100.0 * count_if(execution_status = 'FINISHED') / count(*), 1) as success_rate_pct,
  round(avg(total_duration_ms), 0) as avg_duration_ms, round(quantile_cont(total_duration_ms, 0.5), 0) as p50_duration_ms,
  round(quantile_cont(total_duration_ms, 0.95), 0) as p95_duration_ms, min(start_time) as first_query_time,
  max(start_time) as last_query_time
from fx_query_history where start_time >= {_FROM_MIDNIGHT} and space_id is not null group by all""",
    ),
    "task_share": oracle(
        _H,
        f"""used as (select warehouse_id, executed_by, space_id, client_application, count(*) as query_count,
  sum(total_duration_ms) as wall_ms, coalesce(cast(sum(total_task_duration_ms) as bigint), 0) as total_task_ms,
  sum(read_bytes) as rb from fx_query_history
  where start_time >= {_FROM_MIDNIGHT} and warehouse_id is not null group by all)""",
        "sums as (select warehouse_id, sum(total_task_ms) as wh_ms from used group by warehouse_id)",
        """select u.* exclude (wall_ms, rb), round(100.0 * u.total_task_ms / s.wh_ms, 2) as pct_of_warehouse_cost,
  round(u.total_task_ms / 1000.0 / 3600.0, 2) as task_hours, round(u.rb / 1073741824, 2) as read_gb,
  round(u.wall_ms / u.query_count, 0) as avg_query_duration_ms
from used u join sums s on u.warehouse_id = s.warehouse_id where s.wh_ms > 0""",
    ),
    "attributed_cost": oracle(
        _HUP,
        f"""recent as (select * from fx_query_history where start_time >= {_FROM_MIDNIGHT} and warehouse_id is not null),
total as (select warehouse_id, sum(total_task_duration_ms) as wh_ms from recent group by all),
mine as (select warehouse_id, executed_by, space_id, sum(total_task_duration_ms) as ms from recent
  where space_id = '{SPACE}' group by all),
units as (select warehouse_id, sku_name, cloud, sum(usage_quantity) as n from fx_usage
  where usage_start_time >= {_FROM_MIDNIGHT} and warehouse_id is not null and billing_origin_product = 'SQL' group by all),
price as (select * from (select *, row_number() over (partition by sku_name, cloud order by price_start_time desc) as rn
  from fx_prices where price_end_time is null or price_end_time > {_FROM_MIDNIGHT}) p where rn = 1),
bill as (select u.warehouse_id, sum(u.n) as wh_units, sum(u.n * coalesce(p.price_effective, 0)) as wh_cost
  from units u left join price p on u.sku_name = p.sku_name and u.cloud = p.cloud group by all)""",
        """select m.warehouse_id, m.executed_by, m.space_id, round(100.0 * m.ms / t.wh_ms, 2) as pct_share_of_warehouse,
  round(b.wh_units * (m.ms / t.wh_ms), 2) as attributed_dbus, round(b.wh_cost, 2) as warehouse_total_cost_usd,
  round(b.wh_cost * (m.ms / t.wh_ms), 2) as attributed_cost_usd
from mine m join total t on m.warehouse_id = t.warehouse_id left join bill b on m.warehouse_id = b.warehouse_id
where t.wh_ms > 0""",
    ),
}

round_raw(
    QUERIES,
    ORACLE,
    {
        "warehouse_billing": "dbus cost_usd",
        "rollup_wh_hourly": "dbus",
        "rollup_priced": "dbus",
    },
)
