"""Connected components of an edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import Scratch


def _larger_star(edges: DataFrame) -> DataFrame:
    """Each neighbour larger than a node is tied to the smallest neighbour of that node."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()


def _smaller_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, are tied to the smallest of them. Edges have u < v."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    joined = edges.join(least, "v")
    return joined.select(F.col("m").alias("u"), F.col("u").alias("v")).where("u < v").union(least.select(F.col("m").alias("u"), "v")).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for each node of `edges` (u, v: long, u <> v); component is the smallest node reachable.

    Nodes without edges don't appear. Each round is two aggregations that combine before their shuffle and two
    joins that Spark can split where a node has very many edges; rounds grow with the logarithm of the longest path.
    """
    now = scratch.save(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), f"{name}-0")
    mark, k = None, 0
    while True:
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sums["n"] == 0 or (sums["n"], sums["s"]) == mark:
            break
        mark, k = (sums["n"], sums["s"]), k + 1
        new = scratch.save(_smaller_star(_larger_star(now)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now = new
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select("u", "u").distinct()).distinct()
