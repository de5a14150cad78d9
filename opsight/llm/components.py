"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.scratch import materialize


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the least of node and neighbours."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of these."""
    least = _least(edges)
    down = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (least node reachable) for every node of ``edges`` (columns ``u``, ``v``).

    A round takes a few shuffles of the edges, and the number of rounds grows with the
    logarithm of their number. Only two numbers per round reach the driver. The least
    neighbour of a node is an aggregate that map tasks combine, and the join that hands
    it out is one whose hot partitions Spark splits, so a node may have any number of
    neighbours. Each round is a written table.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = materialize(edges.distinct(), "components")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
        edges = materialize(_small_star(_large_star(edges)), "components")
    ends = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        ends.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
