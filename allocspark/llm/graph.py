"""Connected components of a graph that only Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component's id is its least node.

    Contraction: each node points to its least smaller neighbour, pointers are doubled until
    they end in roots, and edges are moved to the roots; this goes on until no edge is left.
    Each round at least halves the nodes that still have edges. Rows of one hot node are
    aggregated before they are shuffled, and joins have one row a node on one side.
    """
    left = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left = written(left, "edges")
    found = None
    while left.head(1):
        to = left.groupBy("a").agg(F.min("b").alias("root"))
        nodes = left.select(F.col("b").alias("a")).distinct().join(to, "a", "left_anti").select("a", F.col("a").alias("root"))
        pointer = written(to.unionByName(nodes).select(F.col("a").alias("node"), "root"), "pointers")
        while True:
            up = pointer.select(F.col("node").alias("root"), F.col("root").alias("above"))
            doubled = written(pointer.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "pointers")
            pointer = doubled.select("node", "root")
            if not doubled.where("moved").head(1):
                break
        if found is None:
            found = pointer
        else:
            found = found.join(pointer.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
        a = pointer.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = pointer.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = left.join(a, "a").join(b, "b").where("ra <> rb")
        left = written(moved.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    return found.select("node", F.col("root").alias("component"))
