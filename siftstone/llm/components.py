"""Connected components of a link table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (a long, b long); label is the smallest node of its component.

    Each round takes the smallest label of the neighbours, then the label of the label, so long chains
    shorten fast. Labels are a written table between rounds; the driver sees only the number of changes.
    """
    edges = written(links.unionAll(links.select("b", "a")).toDF("a", "b").distinct(), "links")
    labels = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        jumped = low.join(jump, low["label"] == jump["at"], "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        new = written(jumped, "labels")
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
