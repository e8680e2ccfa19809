"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.session import materialize


def _linked_to_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    # A left join, so that Spark can split a node with very many edges.
    return edges.join(least, "u", "left")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v); the root is the least node.

    Alternates large-star and small-star steps: each node's larger, then smaller,
    neighbours are linked to its least neighbour, until only stars are left. The number
    of edges never grows, and the number of rounds is logarithmic in practice.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = materialize(pairs)
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = _linked_to_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _linked_to_least(large, least)
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        pairs = materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        # Order-free sums that change with any edge.
        mark = F.xxhash64("u", "v").cast("decimal(38,0)")
        new = tuple(pairs.agg(F.count("*"), F.sum(mark)).first())
        if new == state:
            break
        state = new
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
