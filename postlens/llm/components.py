"""Connected components by alternating large-star and small-star.

Large-star hangs every larger neighbour of a node on the least node of its
neighbourhood; small-star hangs a node's smaller neighbours there. Alternating
them turns each component into a star around its least node, in a number of
rounds that grows with the logarithm of the component's size. Edges stay in
DataFrames; a round's minima are written, so the join with a node of very many
edges is one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v, distinct."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(written(least, "star"), "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return written(moved.where("u > v").distinct(), "edges")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars around their least nodes: every larger end
    has one edge, and is no edge's smaller end."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    both = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return both.where((F.col("up") > 1) | (F.col("up") * F.col("down") > 0)).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the
    least node reachable. Loops, repeated and reversed edges are allowed;
    nodes may be of any ordered type. Edges with a null end are ignored."""
    edges = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    while not _settled(edges):
        edges = _star(_star(edges, large=True), large=False)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
