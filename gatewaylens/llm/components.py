"""Distributed union-find: connected components by alternating large-star and small-star rounds.

Each round is joins and aggregations over the edges. Minima are combined before their shuffle, and joins
on a node with very many neighbours are plain equi-joins, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewaylens.session import written


def _state(edges: DataFrame) -> tuple:
    """Count and hash sum of the edges: equal from round to round when nothing changes."""
    mark = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))
    return tuple(edges.agg(F.count("*"), F.sum(mark.cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    moved = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Nodes may be of any type that can be compared. Edges with a null end, loops and repeated edges count for
    nothing; without edges the result is empty. The number of rounds grows with the logarithm of the longest path.
    Every round is written to the shared folder, so a lost executor costs one round at most.
    """
    a, b = F.col(left), F.col(right)
    start = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    current = written(start.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = _state(current)
    while state[0]:
        current = written(_small_star(_large_star(current)), "edges")
        before, state = state, _state(current)
        if before == state:
            break
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
