"""Connected components as joins: alternating large-star and small-star steps.

Each step replaces edges by edges to the smallest neighbour, until all are stars: every
node has one edge, to the smallest node of its component. The minimum of a node is a
combinable aggregate and is written before it is joined back, so a node with very many
edges is split by the join instead of landing in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def _settled(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has one only, and is no one's smaller neighbour."""
    up = edges.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = edges.select(F.col("b").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    nodes = up.unionByName(down).groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.max((F.col("up") + F.col("down") > 1) & (F.col("up") > 0))).first()[0]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges has a > b. large: larger neighbours get the minimum; else the smaller ones."""
    sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        sides = sides.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = materialise(sides.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = sides.join(least, "u")
    low = F.least("u", "m")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), low.alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return materialise(out.filter(F.col("a") != F.col("b")).distinct(), "star")


def connected_components(edges: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(node, component): the smallest reachable node, for every node of ``edges``.

    Edges are undirected; null ends, loops and repeated edges count for nothing (a node
    with only loops is not returned). Any ordered type of node is allowed.
    """
    a, b = F.col(first), F.col(second)
    edges = edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges = materialise(edges, "edges")
    while not _settled(edges):
        edges = _star(_star(edges, True), False)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
