"""Connected components by contraction, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every node of (a, b) edges; the label is a node of the component.

    Each round points every node at its smallest neighbour or itself and
    contracts the edges, so the nodes that are left at least halve: rounds grow
    with the logarithm of the largest component.  Each round is materialised in
    the shared checkpoint folder.
    """
    edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = cut(edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("label", F.col("v")))
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("p"), F.col("b").alias("q")).union(edges.select("b", "a"))
        parent = cut(both.groupBy("p").agg(F.least(F.col("p"), F.min("q")).alias("to")))
        labels = cut(labels.join(parent, labels.label == parent.p, "left")
                     .select("v", F.coalesce("to", "label").alias("label")))
        left = parent.select(F.col("p").alias("a"), F.col("to").alias("x"))
        right = parent.select(F.col("p").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").filter("x <> y")
        edges = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels
