"""Connected components of a link table, by least labels with shortcuts, all in joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame) -> DataFrame:
    """node, label for every end of the links (a bigint, b bigint); label is the least node of its component.

    Each round takes the least label among neighbours and then the label of that label, so paths halve; a round
    ends in a written table, and rounds go on until nothing changes.  No links give no rows.
    """
    both = links.select("a", "b").where("a <> b").distinct()
    edges = materialise(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialise(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnsRenamed({"node": "b", "label": "of_b"}), "b").groupBy("a").agg(F.min("of_b").alias("m"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        lower = materialise(lower, "labels")
        of_label = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialise(lower.join(of_label, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        if new.where("old <> label").limit(1).count() == 0:
            return new.select("node", "label")
        labels = new.select("node", "label")
