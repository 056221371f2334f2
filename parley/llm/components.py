"""Connected components by contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), a component being named by one of its nodes.

    Each round maps every node to the least of its neighbours and itself and contracts the edges along that map, until no
    edge is left; a star takes one round, a path a logarithmic number. Minima are aggregated before the shuffle, the maps
    have a row per node, and what a round leaves is staged in the shared folder. Loops and repeated edges are allowed,
    edges with a null end are dropped; an empty table gives an empty result.
    """
    edges = stage(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        ends = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("p"))
        least = stage(least, "least")
        labels = least.select(F.col("u").alias("node"), F.col("p").alias("component")) if labels is None else (
            labels.join(least, labels["component"] == least["u"], "left").select("node", F.coalesce("p", "component").alias("component"))
        )
        labels = stage(labels, "labels")
        left = least.select(F.col("u").alias("ua"), F.col("p").alias("pa"))
        right = least.select(F.col("u").alias("ub"), F.col("p").alias("pb"))
        moved = edges.join(left, edges["a"] == left["ua"]).join(right, edges["b"] == right["ub"])
        edges = stage(moved.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if labels is None:
        kind = edges.schema["a"].dataType
        return edges.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("component"))
    return labels
