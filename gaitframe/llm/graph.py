"""Connected components by large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitframe.llm.shared import MOST_BROADCAST, settle

#: Parts that a node's neighbours are dealt over.
SALTS = 8


def _to_nodes(edges: DataFrame, nodes: DataFrame, few: bool) -> DataFrame:
    """Edges (u, v) with what ``nodes`` has of u.

    A node may have very many neighbours: a component ends as a star, and what it starts
    with is whatever links were found. So unless there are few nodes, its neighbours are dealt
    over SALTS parts.
    """
    if few:
        return edges.join(F.broadcast(nodes), "u")
    salted = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS))).join(salted, ["u", "salt"])


def _stars(e: DataFrame, few: bool) -> DataFrame:
    """Edges (u, v) with u > v: every larger neighbour, then every smaller one, moves to the smallest."""
    # the smallest neighbour of a node, or the node: an edge's smaller end is a neighbour of its larger one
    least = e.select("u", F.col("v").alias("m")).union(e.select(F.col("v").alias("u"), F.col("v").alias("m"))).groupBy("u").agg(F.min("m").alias("m"))
    large = _to_nodes(e.select(F.col("v").alias("u"), F.col("u").alias("v")), least, few).select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    small = _to_nodes(large, down, few).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(down.select("u", F.col("m").alias("v"))).distinct()


def _shape(e: DataFrame) -> tuple[int, bool]:
    """Number of edges, and whether they are stars: no node is both ends, and each larger end has one edge."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, odd = per.agg(F.coalesce(F.sum("up"), F.lit(0)), F.coalesce(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))), F.lit(False))).first()
    return n, not odd


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that it reaches.

    Each round ends in a written table. The rounds end when all edges are stars; their
    number follows the logarithm of the longest chain. What is known of nodes is broadcast
    when the round's edges are few, and dealt otherwise.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        e = settle(e, "stars")
        n, stars = _shape(e)
        if stars:
            break
        e = _stars(e, n <= MOST_BROADCAST // 2)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v")).distinct()
