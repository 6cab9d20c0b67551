"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b: bigint): the label is the component's least node.

    Each round takes the least label among neighbours, then the label's label, so
    the rounds grow with the logarithm of a component's width. Each ends in a table in
    the shared folder; nothing but a count comes to the driver.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
    labels = materialize(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("label"), F.lit(True).alias("moved")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("to"), "label"), "to").groupBy("node").agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        onward = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = met.join(onward, "label").select("node", "old", F.least("label", "next").alias("label"))
        new = materialize(moved.select("node", "label", (F.col("label") != F.col("old")).alias("moved")), "labels")
        discard(labels)
        labels = new
        if not labels.where("moved").limit(1).count():
            return labels.select("node", "label")
