"""Connected components of a graph by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage


#: Edges of a node from which it is a hub, and the share of all edges' ends that makes one where that is more.
HUB_EDGES, HUB_SHARE = 1000, 10_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, hubs: DataFrame | None, large: bool) -> DataFrame:
    """One star step over edges (a, b) with b < a: nodes point to the smallest of their neighbours.

    The smallest neighbour is an aggregate joined back, never a collected list. hubs: nodes whose edges would fill a task of
    their own; their few smallest neighbours are broadcast, and their edges stay where they are.
    """
    both = _both(edges) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    if hubs is None:
        met = both.join(least, "a")
    else:
        of_hubs = F.broadcast(least.join(F.broadcast(hubs), "a", "left_semi"))
        met = both.join(of_hubs, "a").unionByName(both.join(F.broadcast(hubs), "a", "left_anti").join(least, "a"))
    out = met.where(F.col("b") > F.col("a") if large else F.lit(True)).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; edges: two columns of longs in any order, loops and repeats allowed.

    The component is the smallest node. Rounds go on until every node but the smallest of each component has one edge, to
    that; about the logarithm of the longest path. Each round counts the edges of all nodes: a node with more than
    HUB_EDGES and a HUB_SHARE-th of all is a hub, of which there are HUB_SHARE at most. An empty graph gives an empty table.
    """
    x, y = edges.columns
    edges = stage(edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a <> b").distinct())
    while True:
        degrees = _both(edges).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("least"))
        ends, most, open_ = degrees.agg(F.sum("n"), F.max("n"), F.count_if((F.col("n") > 1) & (F.col("least") < F.col("a")))).first()
        if not open_:
            break
        limit = max(HUB_EDGES, ends // HUB_SHARE)
        hubs = stage(degrees.where(F.col("n") > limit).select("a")) if most > limit else None
        edges = stage(_star(_star(edges, hubs, large=True), hubs, large=False))
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
