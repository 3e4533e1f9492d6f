"""Connected components of an edge table by repeated contraction, with every round written to shared storage.

A round points every node at the smallest of its neighbours and itself, follows the pointers, and renames the
edges to the nodes they lead to; edges inside one node disappear. At least every second node is absorbed in a
round, so the number of rounds grows with the logarithm of the nodes. All steps are aggregates that combine
map-side and plain joins of two written tables, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commsim.session import materialize

JUMPS = 2


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of every node that has an edge to another; ``component`` is the smallest node reachable.

    Repeated edges and both directions are fine; edges with a null end and loops count for nothing; no edges
    give an empty table.
    """
    pairs = edges.where(F.col(a) < F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b"))
    pairs = pairs.unionByName(edges.where(F.col(a) > F.col(b)).select(F.col(b).alias("a"), F.col(a).alias("b")))
    pairs = materialize(pairs.distinct(), "edges")
    labels = None
    while not pairs.isEmpty():
        ends = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        pointers = ends.groupBy(F.col("e.a").alias("node")).agg(F.least(F.col("node"), F.min("e.b")).alias("root"))
        pointers = materialize(pointers, "pointers")
        for _ in range(JUMPS):
            onward = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
            pointers = materialize(pointers.join(onward, "root").select("node", F.col("next").alias("root")), "pointers")
        if labels is None:
            labels = pointers.withColumnRenamed("root", "component")
        else:
            step = pointers.withColumnRenamed("node", "component")
            moved = labels.join(step, "component", "left")
            labels = materialize(moved.select("node", F.coalesce("root", "component").alias("component")), "labels")
        left = pointers.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = pointers.select(F.col("node").alias("b"), F.col("root").alias("y"))
        renamed = pairs.join(left, "a").join(right, "b").where("x <> y")
        pairs = materialize(renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if labels is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
