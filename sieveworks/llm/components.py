"""Connected components of an edge table by repeated contraction; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm._common import cut, drop_cut


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b, of one kind that sorts); root is one node of the component.

    Each round every node hooks to its smallest neighbour (or stays) and the edges are contracted to those
    parents, so that the number of nodes falls by a constant factor a round. The frame is one of cut().
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = cut(both.distinct(), "edges")
    roots = None
    while roots is None or not both.isEmpty():
        parent = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "parents")
        if roots is None:
            moved = cut(parent.select(F.col("a").alias("node"), F.col("p").alias("root")), "roots")
        else:
            moved = roots.join(parent.withColumnRenamed("a", "root"), "root", "left")
            moved = cut(moved.select("node", F.coalesce("p", "root").alias("root")), "roots")
            drop_cut(roots)
        roots = moved
        left = both.join(parent, "a").select(F.col("p").alias("pa"), "b")
        right = left.join(parent.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        next_edges = cut(right.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
        drop_cut(both, parent)
        both = next_edges
    drop_cut(both)
    return roots
