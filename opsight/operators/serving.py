"""Model-serving endpoints: traffic, tokens, errors and cost.

Requests are summed per served entity before the entity names are joined, so the
join sees entities and not requests, and a busy endpoint does not skew it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.functions.columns import pct, settled
from opsight.functions.relational import interval_join
from opsight.windows import Lookback

ENTITY = "served_entity_id"


def _recent(requests: DataFrame, window: Lookback) -> DataFrame:
    return requests.filter(window.since_midnight(F.col("request_time")))


def _tokens() -> Column:
    """Both counts of a request; a request that lacks one adds nothing."""
    return F.col("input_token_count") + F.col("output_token_count")


def _by_entity(requests: DataFrame, window: Lookback, keys: list[Column | str], aggs: list[Column]) -> DataFrame:
    return _recent(requests, window).groupBy(ENTITY, *keys).agg(*aggs)


def endpoint_usage(requests: DataFrame, entities: DataFrame, window: Lookback) -> DataFrame:
    per_entity = _by_entity(
        requests,
        window,
        [],
        [
            F.count(F.lit(1)).alias("n"),
            F.sum("input_token_count").alias("tin"),
            F.count("input_token_count").alias("nin"),
            F.sum("output_token_count").alias("tout"),
            F.count("output_token_count").alias("nout"),
            F.sum(_tokens()).alias("both"),
        ],
    )
    average = lambda total, n: settled(F.try_divide(F.sum(total), F.sum(n)), 0)
    return (
        per_entity.join(entities, ENTITY)
        .groupBy("endpoint_name", "entity_type", "entity_name")
        .agg(
            F.sum("n").alias("total_requests"),
            F.sum("tin").alias("total_input_tokens"),
            F.sum("tout").alias("total_output_tokens"),
            F.sum("both").alias("total_tokens"),
            average("tin", "nin").alias("avg_input_tokens_per_req"),
            average("tout", "nout").alias("avg_output_tokens_per_req"),
        )
        .orderBy(F.col("total_requests").desc())
    )


def _requests_and_tokens(per_entity: DataFrame, entities: DataFrame, keys: list[str], count: str) -> DataFrame:
    return (
        per_entity.join(entities, ENTITY)
        .groupBy(*keys)
        .agg(F.sum("n").alias(count), F.sum("both").alias("total_tokens"))
    )


def _count_and_tokens() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(_tokens()).alias("both")]


def endpoint_daily(requests: DataFrame, entities: DataFrame, window: Lookback) -> DataFrame:
    day = F.to_date("request_time").alias("request_date")
    daily = _by_entity(requests, window, [day], _count_and_tokens())
    return _requests_and_tokens(daily, entities, ["request_date", "endpoint_name"], "requests").orderBy(
        F.col("request_date").desc(), F.col("requests").desc()
    )


def requester_usage(requests: DataFrame, window: Lookback) -> DataFrame:
    return (
        _recent(requests, window)
        .groupBy("requester")
        .agg(
            F.count(F.lit(1)).alias("total_requests"),
            F.sum("input_token_count").alias("total_input_tokens"),
            F.sum("output_token_count").alias("total_output_tokens"),
            F.sum(_tokens()).alias("total_tokens"),
        )
        .orderBy(F.col("total_tokens").desc_nulls_last())
    )


def endpoint_errors(requests: DataFrame, entities: DataFrame, window: Lookback) -> DataFrame:
    status = F.col("status_code")
    per_entity = _by_entity(
        requests,
        window,
        [],
        [
            F.count(F.lit(1)).alias("n"),
            F.count_if(status >= 400).alias("bad"),
            F.count_if(status == 429).alias("limited"),
            F.count_if(status >= 500).alias("server"),
        ],
    )
    return (
        per_entity.join(entities, ENTITY)
        .groupBy("endpoint_name")
        .agg(
            F.sum("n").alias("total_requests"),
            F.sum("bad").alias("error_count"),
            F.sum("limited").alias("rate_limit_errors"),
            F.sum("server").alias("server_errors"),
        )
        .withColumn("error_pct", pct(F.col("error_count"), F.col("total_requests"), 2))
        .orderBy(F.col("error_pct").desc())
    )


def hour_pattern(requests: DataFrame, window: Lookback) -> DataFrame:
    return (
        _recent(requests, window)
        .groupBy(F.hour("request_time").alias("hour_of_day"))
        .agg(F.count(F.lit(1)).alias("total_requests"), F.sum(_tokens()).alias("total_tokens"))
        .orderBy("hour_of_day")
    )


def streaming_split(requests: DataFrame, entities: DataFrame, window: Lookback) -> DataFrame:
    split = _by_entity(requests, window, ["request_streaming"], _count_and_tokens())
    keys = ["endpoint_name", "request_streaming"]
    return _requests_and_tokens(split, entities, keys, "total_requests").orderBy(F.col("total_requests").desc())


def _priced(usage: DataFrame, prices: DataFrame, window: Lookback, keys: list[str]) -> DataFrame:
    """Serving usage summed per key, product and time, then priced: effective price, else list price."""
    sku = F.col("sku_name")
    grain = [*keys, "usage_date", "cloud", "sku_name", "usage_start_time"]
    billed = (
        usage.filter(
            (sku.like("%SERVING%") | sku.like("%MODEL_INFERENCE%")) & window.since_date(F.col("usage_date"))
        )
        .groupBy(*grain)
        .agg(F.sum("usage_quantity").alias("usage_quantity"))
    )
    offered = prices.select(
        "cloud",
        "sku_name",
        "currency_code",
        F.coalesce("price_effective", "price_default").alias("price"),
        "price_start_time",
        "price_end_time",
    )
    priced = interval_join(
        billed,
        offered,
        ["cloud", "sku_name"],
        "usage_start_time",
        "price_start_time",
        "price_end_time",
        (window.start.date(), window.as_of.date()),
    )
    return priced.withColumn("cost", F.col("usage_quantity") * F.col("price"))


def serving_cost(usage: DataFrame, prices: DataFrame, window: Lookback) -> DataFrame:
    return (
        _priced(usage, prices, window, [])
        .groupBy("usage_date", "sku_name", "currency_code")
        .agg(
            F.sum("usage_quantity").alias("total_dbus"),
            settled(F.sum("cost"), 2).alias("estimated_cost_usd"),
        )
        .orderBy(F.col("usage_date").desc(), F.col("estimated_cost_usd").desc_nulls_last())
    )


def _per_endpoint(
    usage: DataFrame, prices: DataFrame, entities: DataFrame, window: Lookback, keys: list[str], dedupe: bool
) -> DataFrame:
    """Cost summed per endpoint id first; several entities of one endpoint each carry it whole
    unless ``dedupe`` keeps one row per endpoint name and type."""
    spent = (
        _priced(usage, prices, window, ["endpoint_id"])
        .groupBy("endpoint_id", *keys)
        .agg(
            F.sum("usage_quantity").alias("units"),
            F.sum("cost").alias("cost"),
            F.max("currency_code").alias("currency"),
        )
    )
    served = entities.select("endpoint_id", "endpoint_name", "entity_type")
    return spent.join(served.distinct() if dedupe else served, "endpoint_id")


def endpoint_cost(
    usage: DataFrame,
    prices: DataFrame,
    requests: DataFrame,
    entities: DataFrame,
    window: Lookback,
    dedupe_entities: bool = False,
) -> DataFrame:
    """Cost and requests per endpoint, each aggregated on its own before they meet."""
    cost = (
        _per_endpoint(usage, prices, entities, window, ["sku_name"], dedupe_entities)
        .groupBy("endpoint_name", "entity_type", "sku_name")
        .agg(
            F.sum("units").alias("total_dbus"),
            settled(F.sum("cost"), 2).alias("estimated_cost_usd"),
            F.max("currency").alias("currency_code"),
        )
    )
    per_entity = _by_entity(
        requests,
        window,
        [],
        [
            F.count(F.lit(1)).alias("n"),
            F.sum("input_token_count").alias("tin"),
            F.sum("output_token_count").alias("tout"),
        ],
    )
    traffic = (
        per_entity.join(entities, ENTITY)
        .groupBy("endpoint_name")
        .agg(
            F.sum("n").alias("total_requests"),
            F.sum("tin").alias("total_input_tokens"),
            F.sum("tout").alias("total_output_tokens"),
        )
    )
    return cost.join(traffic, "endpoint_name", "left").orderBy(F.col("estimated_cost_usd").desc_nulls_last())


def endpoint_cost_daily(
    usage: DataFrame, prices: DataFrame, entities: DataFrame, window: Lookback, dedupe_entities: bool = False
) -> DataFrame:
    return (
        _per_endpoint(usage, prices, entities, window, ["usage_date"], dedupe_entities)
        .groupBy("usage_date", "endpoint_name")
        .agg(F.sum("units").alias("total_dbus"), settled(F.sum("cost"), 2).alias("estimated_cost_usd"))
        .orderBy(F.col("usage_date").desc(), F.col("estimated_cost_usd").desc_nulls_last())
    )
