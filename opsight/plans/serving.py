"""Registered model-serving queries and the SQL they must agree with."""

from __future__ import annotations

from opsight.operators import serving as s
from opsight.plans.common import MIDNIGHT, Inputs, oracle, query, round_raw
from opsight.plans.cost import prices, usage

DAYS, RECENT = 25, 7


def _req(t: Inputs):
    return t.logical("fx_endpoint_usage")


def _ent(t: Inputs):
    return t.logical("fx_served_entities")


QUERIES = {
    "endpoint_usage": query(lambda t: s.endpoint_usage(_req(t), _ent(t), t.window(DAYS))),
    "endpoint_daily": query(lambda t: s.endpoint_daily(_req(t), _ent(t), t.window(DAYS))),
    "requester_usage": query(lambda t: s.requester_usage(_req(t), t.window(RECENT))),
    "endpoint_errors": query(lambda t: s.endpoint_errors(_req(t), _ent(t), t.window(RECENT))),
    "hour_pattern": query(lambda t: s.hour_pattern(_req(t), t.window(RECENT))),
    "streaming_split": query(lambda t: s.streaming_split(_req(t), _ent(t), t.window(DAYS))),
    "serving_cost": query(lambda t: s.serving_cost(usage(t), prices(t), t.window(DAYS))),
    "endpoint_cost": query(lambda t: s.endpoint_cost(usage(t), prices(t), _req(t), _ent(t), t.window(DAYS))),
    "endpoint_cost_daily": query(lambda t: s.endpoint_cost_daily(usage(t), prices(t), _ent(t), t.window(DAYS))),
}


def _since(days: int) -> str:
    return f"{MIDNIGHT} - interval {days} day"


_BOTH = "cast(sum(u.input_token_count + u.output_token_count) as bigint) as total_tokens"
_IN_OUT = """cast(sum(u.input_token_count) as bigint) as total_input_tokens,
  cast(sum(u.output_token_count) as bigint) as total_output_tokens"""
_JOIN = "from fx_endpoint_usage u join fx_served_entities e on u.served_entity_id = e.served_entity_id"
_PRICED = f"""from fx_usage u left join fx_prices p on u.sku_name = p.sku_name and u.cloud = p.cloud
  and u.usage_start_time >= p.price_start_time and (p.price_end_time is null or u.usage_start_time < p.price_end_time)"""
_SERVING = f"""where (u.sku_name like '%SERVING%' or u.sku_name like '%MODEL_INFERENCE%')
  and u.usage_date >= cast({_since(DAYS)} as date)"""
_COST = "round(sum(u.usage_quantity * coalesce(p.price_effective, p.price_default)), 2) as estimated_cost_usd"
_E = "fx_endpoint_usage fx_served_entities"

ORACLE = {
    "endpoint_usage": oracle(
        _E,
        f"""select e.endpoint_name, e.entity_type, e.entity_name, count(*) as total_requests, {_IN_OUT}, {_BOTH},
  round(avg(u.input_token_count), 0) as avg_input_tokens_per_req, round(avg(u.output_token_count), 0) as avg_output_tokens_per_req
{_JOIN} where u.request_time >= {_since(DAYS)} group by all""",
    ),
    "endpoint_daily": oracle(
        _E,
        f"""select cast(u.request_time as date) as request_date, e.endpoint_name, count(*) as requests, {_BOTH}
{_JOIN} where u.request_time >= {_since(DAYS)} group by all""",
    ),
    "requester_usage": oracle(
        "fx_endpoint_usage",
        f"""select u.requester, count(*) as total_requests, {_IN_OUT}, {_BOTH}
from fx_endpoint_usage u where u.request_time >= {_since(RECENT)} group by all""",
    ),
    "endpoint_errors": oracle(
        _E,
        f"""select e.endpoint_name, count(*) as total_requests, cast(count_if(u.status_code >= 400) as bigint) as error_count,
  round(100.0 * count_if(u.status_code >= 400) / count(*), 2) as error_pct,
  cast(count_if(u.status_code = 429) as bigint) as rate_limit_errors, cast(count_if(u.status_code >= 500) as bigint) as server_errors
{_JOIN} where u.request_time >= {_since(RECENT)} group by all""",
    ),
    "hour_pattern": oracle(
        "fx_endpoint_usage",
        f"""select cast(hour(u.request_time) as int) as hour_of_day, count(*) as total_requests, {_BOTH}
from fx_endpoint_usage u where u.request_time >= {_since(RECENT)} group by all""",
    ),
    "streaming_split": oracle(
        _E,
        f"""select e.endpoint_name, u.request_streaming, count(*) as total_requests, {_BOTH}
{_JOIN} where u.request_time >= {_since(DAYS)} group by all""",
    ),
    "serving_cost": oracle(
        "fx_usage fx_prices",
        f"""select u.usage_date, u.sku_name, p.currency_code, sum(u.usage_quantity) as total_dbus, {_COST}
{_PRICED} {_SERVING} group by all""",
    ),
    "endpoint_cost": oracle(
        f"{_E} fx_usage fx_prices",
        f"""cost as (select e.endpoint_name, e.entity_type, u.sku_name, sum(u.usage_quantity) as total_dbus, {_COST},
  max(p.currency_code) as currency_code {_PRICED}
  join fx_served_entities e on u.endpoint_id = e.endpoint_id {_SERVING} group by all),
traffic as (select e.endpoint_name, count(*) as total_requests, {_IN_OUT}
  {_JOIN} where u.request_time >= {_since(DAYS)} group by all)""",
        """select c.*, t.total_requests, t.total_input_tokens, t.total_output_tokens
from cost c left join traffic t on c.endpoint_name = t.endpoint_name""",
    ),
    "endpoint_cost_daily": oracle(
        "fx_served_entities fx_usage fx_prices",
        f"""select u.usage_date, e.endpoint_name, sum(u.usage_quantity) as total_dbus, {_COST}
{_PRICED} join fx_served_entities e on u.endpoint_id = e.endpoint_id {_SERVING} group by all""",
    ),
}

round_raw(
    QUERIES,
    ORACLE,
    {"serving_cost": "total_dbus", "endpoint_cost": "total_dbus", "endpoint_cost_daily": "total_dbus"},
)
