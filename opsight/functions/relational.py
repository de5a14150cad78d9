"""Relational helpers: newest row per key, shares, validity intervals, exact percentiles."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsight.functions.columns import settled


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest ``order`` columns, nulls last.

    Rank 1 is planned as a group limit below the exchange, so each map task sends
    at most one row per key and a hot key costs no more than a cold one.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def spread_join(left: DataFrame, right: DataFrame, key: str, deals: int = 16) -> DataFrame:
    """Inner equi-join for few keys that have many rows on both sides, so that far more comes out than goes in.

    Rows of ``left`` are dealt by their hash, each of ``right`` is repeated for every deal, so a key's rows are
    made by ``deals`` tasks. The number of partitions is given, as adaptive execution would choose it by the size
    of the input and leave the output to a few tasks. Columns come as from ``left.join(right, key)``.
    """
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.withColumn("_deal", F.pmod(F.xxhash64(*left.columns), F.lit(deals)).cast("int"))
    repeated = right.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    sides = [side.repartition(partitions, key, "_deal") for side in (dealt, repeated)]
    return sides[0].join(sides[1].hint("merge"), [key, "_deal"]).drop("_deal")


def hot_key_join(facts: DataFrame, dims: DataFrame, key: str, deals: int = 64) -> DataFrame:
    """Inner equi-join in which a key that holds more than one ``deals``-th of the facts is dealt to ``deals`` tasks.

    Less than ``deals`` keys can be that frequent, so their list is broadcast; only their rows of ``dims`` are repeated.
    """
    counts = facts.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") * deals > counts.agg(F.sum("_n")).scalar()).select(key, F.lit(True).alias("_hot"))
    deal = F.when(F.col("_hot"), F.pmod(F.xxhash64(*facts.columns), F.lit(deals)).cast("int")).otherwise(0)
    all_deals = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(deals - 1))).otherwise(F.array(F.lit(0)))
    dealt = facts.join(F.broadcast(hot), key, "left").withColumn("_deal", deal).drop("_hot")
    repeated = dims.join(F.broadcast(hot), key, "left").withColumn("_deal", F.explode(all_deals)).drop("_hot")
    return dealt.join(repeated, [key, "_deal"]).drop("_deal")


def share_of_total(df: DataFrame, value: str, out: str, by: Sequence[str] = (), digits: int = 1) -> DataFrame:
    """Percentage of the group total. Only for inputs already aggregated to few rows."""
    total = F.sum(value).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    share = settled(100.0 * F.col(value).cast("double") / total.cast("double"), digits)
    return df.withColumn(out, share)


def clipped_day(ts: Column, first: date, last: date) -> Column:
    return F.greatest(F.least(F.to_date(ts), F.lit(last)), F.lit(first))


def fits_broadcast(df: DataFrame, copies: int) -> bool:
    """Whether ``df``, each row repeated ``copies`` times, stays below the broadcast limit.

    The planner's own estimate does not see that an explode repeats rows.
    """
    state = df.sparkSession._jsparkSession.sessionState()
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return estimate * copies <= state.conf().autoBroadcastJoinThreshold()


def interval_join(
    facts: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str,
    end: str,
    days: tuple[date, date],
    how: str = "left",
    closed: bool = False,
) -> DataFrame:
    """Join each fact to the span of its key that is valid at time ``at``.

    ``end`` may be null (still open). Both sides also carry a calendar day, clipped
    to ``days``, as an equality key: a hot key is spread over the days of the window
    and each fact meets only the spans of its own day. Clipping is monotone, so a
    fact outside ``days`` still meets every span that covers it. The daily spans may be
    broadcast only if their repeated size is below the limit; else both sides are
    shuffled, and hot partitions are split at run time.
    """
    first, last = days
    until = F.coalesce(clipped_day(F.col(end), first, last), F.lit(last))
    since = clipped_day(F.col(start), first, last)
    left = facts.withColumn("_day", clipped_day(F.col(at), first, last)).alias("f")
    daily = spans.filter(F.col(end).isNull() | (F.col(start) <= F.col(end))).withColumn(
        "_day", F.explode(F.sequence(since, until))
    )
    if not fits_broadcast(spans, (last - first).days + 1):
        daily = daily.hint("merge")
    right = daily.alias("s")
    cond = F.col("f._day") == F.col("s._day")
    for key in keys:
        cond = cond & (F.col(f"f.{key}") == F.col(f"s.{key}"))
    when = F.col(f"f.{at}")
    upper = when <= F.col(f"s.{end}") if closed else when < F.col(f"s.{end}")
    cond = cond & (when >= F.col(f"s.{start}")) & (F.col(f"s.{end}").isNull() | upper)
    extra = [F.col(f"s.{c}") for c in spans.columns if c not in facts.columns]
    return left.join(right, cond, how).select(*[F.col(f"f.{c}") for c in facts.columns], *extra)


def validity_intervals(changes: DataFrame, keys: Sequence[str], ts: str, until: str) -> DataFrame:
    """Add ``until``, the next change time of the same key (null for the newest row).

    The next change is found inside the (key, day) group; only the last change of a
    day looks at the next day that has one, through a table of one row per (key, day).
    No group therefore holds more than one day of one key, or one row per day.
    """
    day = [*keys, "_day"]
    dated = changes.withColumn("_day", F.to_date(ts))
    in_day = Window.partitionBy(*day).orderBy(ts)
    across = Window.partitionBy(*keys).orderBy("_day")
    next_day = (
        dated.groupBy(*day)
        .agg(F.min(ts).alias("_first"))
        .withColumn("_next_first", F.lead("_first").over(across))
        .drop("_first")
    )
    return (
        dated.withColumn("_in_day", F.lead(ts).over(in_day))
        .join(next_day, day)
        .withColumn(until, F.coalesce("_in_day", "_next_first"))
        .drop("_day", "_in_day", "_next_first")
    )


def as_of_join(
    facts: DataFrame, changes: DataFrame, keys: Sequence[str], at: str, ts: str, days: tuple[date, date]
) -> DataFrame:
    """Left join each fact to the newest change at or before ``at``."""
    spans = validity_intervals(changes, keys, ts, "_until")
    return interval_join(facts, spans, keys, at, ts, "_until", days).drop(ts, "_until")


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]], buckets: int = 64
) -> DataFrame:
    """Exact interpolated percentiles per key; ``wanted`` maps output -> (column, p).

    Works on distinct values with counts. Each key's values are cut into ``buckets``
    ranges of about equal size (a sketch proposes the cuts; they affect balance, never
    the result), bucket totals locate the ranks, and only the buckets that hold a
    wanted rank are ordered. A hot key is so split over many groups.
    """
    columns = list(dict.fromkeys(col for col, _ in wanted.values()))
    long = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in columns])
        ).alias("_x"),
    ).select(*keys, F.col("_x.m").alias("_m"), F.col("_x.v").alias("_v"))
    group = [*keys, "_m"]
    counts = long.filter("_v is not null").groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c"))
    cuts = [i / buckets for i in range(1, buckets)]
    heads = counts.groupBy(*group).agg(
        F.sum("_c").alias("_n"), F.percentile_approx("_v", cuts, 1000).alias("_cuts")
    )
    placed = (
        null_safe_join(counts, heads, group)
        .withColumn("_b", F.size(F.filter("_cuts", lambda cut: cut < F.col("_v"))))
        .drop("_cuts")
    )
    ranks = F.array(
        *[
            F.struct(
                F.lit(out).alias("out"),
                F.lit(col).alias("m"),
                F.floor(F.lit(p) * (F.col("_n") - 1)).alias("lo"),
                F.ceil(F.lit(p) * (F.col("_n") - 1)).alias("hi"),
                F.lit(p).alias("p"),
            )
            for out, (col, p) in wanted.items()
        ]
    )
    running = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*group, "_b", "_n").agg(F.sum("_c").alias("_bc"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_bc").over(running), F.lit(0)))
    targets = (
        before.withColumn("_r", F.explode(ranks))
        .filter("_r.m = _m and _r.hi >= _before and _r.lo < _before + _bc")
        .groupBy(*group, "_b", "_before")
        .agg(F.collect_list("_r").alias("_rs"))
    )
    inside = Window.partitionBy(*group, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        null_safe_join(placed, targets, [*group, "_b"])
        .withColumn("_to", F.col("_before") + F.sum("_c").over(inside))
        .withColumn("_from", F.col("_to") - F.col("_c"))
        .withColumn("_r", F.explode("_rs"))
        .filter("_r.hi >= _from and _r.lo < _to")
    )
    picks = []
    for out, (_, p) in wanted.items():
        mine = F.col("_r.out") == out
        lo = F.max(F.when(mine & F.expr("_r.lo >= _from and _r.lo < _to"), F.col("_v")))
        hi = F.max(F.when(mine & F.expr("_r.hi >= _from and _r.hi < _to"), F.col("_v")))
        rank = F.max(F.when(mine, F.lit(p) * (F.col("_n") - 1)))
        picks.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(out))
    return found.groupBy(*keys).agg(*picks)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet each other; keys are taken from the left."""
    cond = None
    for key in keys:
        part = F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
        cond = part if cond is None else cond & part
    extra = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), cond, how).select("l.*", *extra)
