"""Connected components by alternating large-star and small-star.

Edges stay in tables of the shared folder; a round deals them by vertex, takes the smallest neighbour of
each and links the others to it.  A large star's smallest neighbours are written before they are joined, so
that both sides of the join are plain tables and adaptive execution can split a vertex of high degree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a vertex to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links the smaller neighbours of a vertex, and itself, to the smallest of them (u > v in all edges)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))  # after a large star a vertex has few smaller neighbours
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every vertex of the edges (u, v), two long columns; root: the smallest vertex reachable.

    Loops and repeated edges do no harm; without edges the result is empty.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = saved(edges, "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
        edges = saved(_small_star(saved(_large_star(edges), "edges")), "edges")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
