"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abspark.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for the nodes of edges (a, b).
    Each round takes the smallest label around a node and then the label of that label, and
    is written to the shared folder; it ends when no label changes. Sums over neighbours
    are combined before the shuffle, so a node with very many edges is no hot task."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(around.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        of_label = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = near.join(of_label, "label").select("node", "old", F.least("label", "further").alias("label"))
        moved = staged(moved)
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels
