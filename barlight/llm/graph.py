"""Connected components by repeated contraction, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(a, b); label is the smallest node reachable.

    Each round maps every node to the smallest of itself and its neighbours
    and contracts the edges; at least half of the nodes of a component go in
    each round, so the rounds grow with the logarithm of its size. Loops and
    repeated edges are allowed; rows with a null end are ignored.
    """
    edges = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    maps = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label"))
        step = materialise(step, "contract")
        maps.append(step)
        to_a = step.select(F.col("node").alias("a"), F.col("label").alias("la"))
        to_b = step.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = materialise(edges.join(to_a, "a").join(to_b, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = maps[-1]
    for step in reversed(maps[:-1]):
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = step.join(later, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    return materialise(labels, "labels")
