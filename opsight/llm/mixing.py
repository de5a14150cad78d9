"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order that depends only on id and
text; the queue runs through twice, as a document may be used twice. An entry's virtual
finish time is the source's tokens up to and with it, divided by the source's target.
All entries are put in the order of finish time, and the order is cut where the budget is
used up: every source has then advanced to the same virtual time, that is, to the same
share of its target.

Neither running sum is one window: the shuffled order and the time axis are cut into
ranges, range totals are summed in order (a table of a bounded number of rows per source,
and one of at most ``8 * ranges`` rows), and only rows of one range are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsight.llm.common import key_of, n_words_of, text_of
from opsight.scratch import materialize

_HEX = 3
_TIMES = 1024


def order_key(id_col: str, text_col: str) -> Column:
    """The place in the shuffled order: a hash of id and text, so reruns agree."""
    parts = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_of(text_col)))
    return F.md5(parts)


def source_targets(sizes: DataFrame, weights: Sequence[int], half_shares: int, most: int) -> DataFrame:
    """Targets of the sources in ``sizes`` (``source``, ``source_size``).

    Weights repeat over the sources in code point order, null last. The sources share
    ``half_shares / 2`` of all tokens by weight, and none gets more than ``most`` times its
    size: in the order of size per weight, ``level`` is the share of a unit of weight if
    all sources before are full, and the highest level is the right one.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * most)
    everything = Window.partitionBy(F.lit(0))
    by_room = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("_cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(everything) * half_shares / F.lit(2.0)
    return (
        weighed.withColumn("_budget", budget)
        .withColumn("_level", (F.col("_budget") - full) / open_weight)
        .withColumn("_level", F.max("_level").over(everything))
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("weight")))
        .select("source", "source_size", "weight", "target", "_budget")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    half_shares: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: id, ``source``, ``size`` (words), ``source_size``, ``target``,
    ``copies`` (0, 1 or 2), ``taken`` (``copies * size``), ``finish`` (of the first use) and
    ``order_key``.

    Null text has size 0. A null source is a source of its own, the last. Documents of size
    0 are never taken (their ``finish`` is null if the whole source is empty). Rows that
    repeat id, text and source tie and are taken alike; so are entries that end at the same
    time. A null id only enters the shuffled order. Other columns are not read. An empty
    table gives an empty result.
    """
    narrow = docs.select(
        F.col(id_col),
        F.col(source_col).cast("string").alias("source"),
        n_words_of(text_of(text_col)).alias("size"),
        order_key(id_col, text_col).alias("order_key"),
    )
    rows = (
        materialize(narrow, "mixing-sizes")
        .withColumn("_source", key_of("source"))
        .withColumn("_range", F.substring("order_key", 1, _HEX))
    )
    ranges = rows.groupBy("_source", "_range").agg(F.sum("size").alias("_in_range"), F.first("source").alias("source"))
    in_order = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select(
        "_source", "_range", F.coalesce(F.sum("_in_range").over(in_order), F.lit(0)).alias("_before")
    )
    sizes = ranges.groupBy("_source").agg(F.first("source").alias("source"), F.sum("_in_range").alias("source_size"))
    targets = source_targets(sizes.drop("_source"), weights, half_shares, 2).withColumn("_source", key_of("source"))
    inside = Window.partitionBy("_source", "_range").orderBy("order_key")
    inside = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.col("_before") + F.sum("size").over(inside)
    queued = (
        rows.join(before, ["_source", "_range"])
        .withColumn("_until", until)
        .join(targets.drop("source"), "_source")
        .withColumn("finish", F.try_divide(F.col("_until").cast("double"), F.col("target")))
        .withColumn("_again", F.try_divide((F.col("_until") + F.col("source_size")).cast("double"), F.col("target")))
        .select(id_col, "source", "size", "source_size", "target", "finish", "_again", "order_key", "_budget")
    )
    queued = materialize(queued, "mixing-queues")
    moment = F.least(F.floor(F.col("_at") * _TIMES), F.lit(8 * _TIMES))
    entries = (
        queued.filter("size > 0")
        .select("size", "_budget", F.explode(F.array("finish", "_again")).alias("_at"))
        .withColumn("_moment", moment)
    )
    by_moment = Window.orderBy("_moment").rowsBetween(Window.unboundedPreceding, 0)
    moments = entries.groupBy("_moment").agg(F.sum("size").alias("_size"), F.max("_budget").alias("_budget"))
    running = moments.withColumn("_until", F.sum("_size").over(by_moment))
    cut_moment = running.filter("_until > _budget").agg(
        F.min(F.struct("_moment", (F.col("_until") - F.col("_size")).alias("_before"))).alias("_cut")
    )
    last = entries.join(cut_moment.select("_cut._moment", "_cut._before"), "_moment")
    in_time = Window.partitionBy("_moment").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut_time = (
        last.withColumn("_until", F.col("_before") + F.sum("size").over(in_time))
        .filter("_until <= _budget")
        .agg(F.max("_at").alias("_at"))
    )
    cut = materialize(
        cut_moment.select(
            F.coalesce(F.col("_cut._moment"), F.lit(8 * _TIMES + 1)).alias("moment"),
            F.coalesce(cut_time.scalar(), F.lit(-1.0)).alias("at"),
        ),
        "mixing-cut",
    )

    def used(at: str) -> Column:
        moment = F.least(F.floor(F.col(at) * _TIMES), F.lit(8 * _TIMES))
        inside = (moment == F.col("_moment")) & (F.col(at) <= F.col("_at"))
        return F.when((F.col("size") > 0) & ((moment < F.col("_moment")) | inside), 1).otherwise(0)

    cutting = queued.withColumn("_moment", cut.select("moment").scalar()).withColumn("_at", cut.select("at").scalar())
    copies = (used("finish") + used("_again")).cast("int")
    return cutting.withColumn("copies", copies).select(
        id_col,
        "source",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        "finish",
        "order_key",
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns; a row used twice is there twice."""
    names = {k: settings.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    chosen = mix(docs, **settings).filter("copies > 0")
    chosen = chosen.select(key_of("source").alias("_source"), F.col("order_key").alias("_key"), "copies")
    chosen = chosen.groupBy("_source", "_key").agg(F.max("copies").alias("_copies"))
    keyed = docs.withColumn("_source", key_of(names["source_col"]))
    keyed = keyed.withColumn("_key", order_key(names["id_col"], names["text_col"]))
    repeated = F.explode(F.array_repeat(F.lit(1), F.col("_copies")))
    return keyed.join(chosen, ["_source", "_key"]).withColumn("_use", repeated).select(docs.columns)
