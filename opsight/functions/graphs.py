"""Circles of a directed graph given as edge rows, by rounds of joins.

``cut`` writes a DataFrame and reads it back; it ends the lineage of every round. Only edges that can
lie on a circle stay from round to round, and nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Cut = Callable[[DataFrame, str], DataFrame]


def _trimmed(edges: DataFrame, cut: Cut) -> tuple[DataFrame, int]:
    """Edges that neither begin where nothing arrives nor end where nothing leaves."""
    before = edges.count()
    while before:
        arrives = edges.select(F.col("dst").alias("src")).distinct()
        leaves = edges.select(F.col("src").alias("dst")).distinct()
        edges = cut(edges.join(arrives, "src", "left_semi").join(leaves, "dst", "left_semi").select("src", "dst"), "trimmed")
        after = edges.count()
        if after == before:
            break
        before = after
    return edges, before


def _colours(edges: DataFrame, cut: Cut) -> DataFrame:
    """(node, colour): the least node from which a path leads to the node, itself included."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    colours = cut(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("new")), "colours")
    while not colours.filter("new").isEmpty():
        carried = (
            edges.join(colours.filter("new").select(F.col("node").alias("src"), F.col("colour").alias("offer")), "src")
            .groupBy(F.col("dst").alias("node"))
            .agg(F.min("offer").alias("offer"))
        )
        better = F.coalesce(F.col("offer") < F.col("colour"), F.lit(False))
        colours = cut(
            colours.drop("new")
            .join(carried, "node", "left")
            .select("node", F.when(better, F.col("offer")).otherwise(F.col("colour")).alias("colour"), better.alias("new")),
            "colours",
        )
    return colours.drop("new")


def circles(edges: DataFrame, cut: Cut) -> DataFrame:
    """(node, circle) of every node on a circle; ``circle`` is the least node of its strongly connected component.

    ``edges(src, dst)`` may repeat; an edge with a null end is none; an edge to itself is a circle of one.
    Forward and backward colouring: a colour's own node is on a circle with all nodes of that colour
    that lead back to it. Those are taken out, and what is left is trimmed and coloured again.
    """
    edges = cut(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "edges")
    found = edges.select(F.col("src").alias("node"), F.col("src").alias("circle")).limit(0)
    while True:
        edges, n = _trimmed(edges, cut)
        if not n:
            return found
        colours = _colours(edges, cut)
        inside = cut(
            edges.join(colours.select(F.col("node").alias("src"), "colour"), "src")
            .join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("_other")), "dst")
            .filter("colour = _other")
            .select("src", "dst", "colour"),
            "inside",
        )
        # back from each colour's own node, inside the colour
        back = cut(colours.filter("node = colour").select("node", "colour", F.lit(True).alias("new")), "back")
        while not back.filter("new").isEmpty():
            more = inside.join(back.filter("new").select(F.col("node").alias("dst")), "dst", "left_semi")
            more = more.select(F.col("src").alias("node"), "colour").distinct().join(back, "node", "left_anti")
            back = cut(back.withColumn("new", F.lit(False)).unionByName(more.withColumn("new", F.lit(True))), "back")
        # a colour's own node that nothing of its colour leads back to is on no circle of its own
        closed = inside.join(back.select(F.col("node").alias("src")), "src", "left_semi")
        closed = closed.join(back.select(F.col("node").alias("dst")), "dst", "left_semi")
        on = closed.select(F.explode(F.array("src", "dst")).alias("node"), F.col("colour").alias("circle")).distinct()
        found = cut(found.unionByName(on), "circles")
        gone = back.select("node")
        edges = cut(
            edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti")
            .join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
            .select("src", "dst"),
            "edges",
        )
