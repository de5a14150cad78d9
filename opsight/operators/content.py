"""Whether two tables hold the same rows, and where not, without comparing row by row what is equal.

Rows of each table are summed into digests that do not depend on order, one per range of the key; ranges
are the leaves of a tree whose inner digests are sums of those below. One pass over each table gives
all leaves. The tree is then compared from the top, and only leaves that differ are opened: their
key bounds are pushed down to the scans, and their rows meet in a join by key.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FANOUT = 16


def key_bounds(table: DataFrame, key: str, ranges: int) -> list[Any]:
    """About ``ranges - 1`` keys that cut the table into ranges of about the same size.

    They come from the rows with the smallest hashes of the key, 16 for each range, so the same keys give the
    same bounds in any order of rows. A key that holds much of the table makes a range of its own.
    """
    sample = (
        table.select(F.col(key).alias("k")).filter("k is not null").distinct().orderBy(F.xxhash64("k"), "k").limit(16 * ranges)
    )
    keys = [r["k"] for r in sample.orderBy("k").collect()]
    step = max(1, len(keys) // ranges)
    return keys[step::step][: ranges - 1]


def _range_of(key: Column, bounds: list[Any]) -> Column:
    """The number of bounds at or below the key, by a balanced tree of comparisons; 0 for a null key."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(bounds[middle]), between(low, middle)).otherwise(between(middle + 1, high))

    return F.when(key.isNull(), F.lit(0)).otherwise(between(0, len(bounds)))


def leaf_digests(table: DataFrame, key: str, bounds: list[Any]) -> DataFrame:
    """(leaf, n, a, b): the rows of each key range, and two sums of their hashes, which order does not change."""
    row = F.struct(*[F.col(c) for c in sorted(table.columns)])
    return (
        table.select(
            _range_of(F.col(key), bounds).alias("leaf"),
            F.xxhash64(row).cast("decimal(38,0)").alias("x"),
            F.xxhash64(row, F.lit("second")).alias("y"),
        )
        .groupBy("leaf")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("a"), F.bit_xor("y").alias("b"))
    )


@dataclass
class Difference:
    """Leaves that differ, with the number of digests that were compared on the way down, and the bounds."""

    leaves: list[int]
    compared: int
    bounds: list[Any]

    def within(self, key: Column) -> Column:
        """Keys of the differing leaves, as bounds that a scan can use; leaves side by side are one span."""
        spans = F.lit(False)
        firsts = [leaf for leaf in self.leaves if leaf - 1 not in self.leaves]
        lasts = [leaf for leaf in self.leaves if leaf + 1 not in self.leaves]
        for first, last in zip(firsts, lasts):
            span = F.lit(True)
            if first > 0:
                span = span & (key >= F.lit(self.bounds[first - 1]))
            if last < len(self.bounds):
                span = span & (key < F.lit(self.bounds[last]))
            spans = spans | (span | key.isNull() if first == 0 else span)
        return spans


def differing_ranges(left: DataFrame, right: DataFrame, key: str, ranges: int = 256) -> Difference:
    """Compare two tables' digest trees, ``FANOUT`` children to a node, from the root down."""
    bounds = key_bounds(left, key, ranges)
    sides = []
    for table in (left, right):  # at most one row per range
        sides.append({r["leaf"]: (r["n"], r["a"], r["b"]) for r in leaf_digests(table, key, bounds).collect()})
    levels = [sides]
    while len(bounds) + 1 > FANOUT ** (len(levels) - 1):
        above = []
        for side in levels[-1]:
            nodes: dict[int, tuple] = {}
            for at, (n, a, b) in side.items():
                m, c, d = nodes.get(at // FANOUT, (0, 0, 0))
                nodes[at // FANOUT] = (m + n, c + a, d ^ b)
            above.append(nodes)
        levels.append(above)
    open_, compared = [0], 0
    for left_nodes, right_nodes in reversed(levels):
        compared += len(open_)
        differ = [at for at in open_ if left_nodes.get(at) != right_nodes.get(at)]
        if (left_nodes, right_nodes) == tuple(sides):
            return Difference(differ, compared, bounds)
        open_ = [at * FANOUT + i for at in differ for i in range(FANOUT)]
    return Difference(open_, compared, bounds)


def differences(left: DataFrame, right: DataFrame, key: str, ranges: int = 256) -> DataFrame:
    """(key, ``status``, ``rows_left``, ``rows_right``): keys whose rows are not the same on both sides.

    ``only_left``, ``only_right`` or ``changed``. Keys may repeat: the rows of a key are compared as a
    bag. A null key is a key. Columns must have the same names on both sides.
    """
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"columns differ: {sorted(set(left.columns) ^ set(right.columns))}")
    found = differing_ranges(left, right, key, ranges)

    def opened(table: DataFrame, side: str) -> DataFrame:
        row = F.struct(*[F.col(c) for c in sorted(table.columns)])
        rows = table.filter(found.within(F.col(key))).select(F.col(key).alias("_key"), F.xxhash64(row).alias("x"), F.xxhash64(row, F.lit("second")).alias("y"))
        digest = F.struct(F.sum(F.col("x").cast("decimal(38,0)")), F.bit_xor("y"))
        return rows.groupBy("_key").agg(F.count(F.lit(1)).alias(f"rows_{side}"), digest.alias(side))

    a, b = opened(left, "left"), opened(right, "right").withColumnRenamed("_key", "_other")
    both = a.join(b, F.col("_key").eqNullSafe(F.col("_other")), "full_outer")
    status = (
        F.when(F.col("rows_right").isNull(), "only_left").when(F.col("rows_left").isNull(), "only_right").otherwise("changed")
    )
    same = F.col("rows_left").eqNullSafe(F.col("rows_right")) & F.col("left").eqNullSafe(F.col("right"))
    return both.filter(~same).select(
        F.when(F.col("rows_left").isNull(), F.col("_other")).otherwise(F.col("_key")).alias(key),
        status.alias("status"),
        F.coalesce("rows_left", F.lit(0)).alias("rows_left"),
        F.coalesce("rows_right", F.lit(0)).alias("rows_right"),
    )
