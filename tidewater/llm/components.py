"""Connected components of a table of links, by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b); component is the smallest node that links reach.

    Each round hooks every node to its smallest neighbour, shortens the chains and contracts the links, so their number
    falls at least by half. Loops and repeated links are ignored.
    """
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("parent")), "parents")
        for _ in range(2):
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            parents = written(parents.join(up, "parent").select("node", F.col("above").alias("parent")), "parents")
        if labels is None:
            labels = parents.withColumnRenamed("parent", "component")
        else:
            up = parents.select(F.col("node").alias("component"), "parent")
            labels = written(labels.join(up, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
        a, b = (parents.select(F.col("node").alias(x), F.col("parent").alias(f"p{x}")) for x in "ab")
        moved = left.join(a, "a").join(b, "b").where("pa <> pb")
        left = written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("component"))
