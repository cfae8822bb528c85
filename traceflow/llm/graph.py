"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that edges(a, b) reach), for each node of an edge.

    Each round a node takes the smallest label around it, then its label's label; rounds grow with the logarithm of a
    component's diameter. Labels are written to the shared folder every round, which cuts the lineage. An empty edge table gives no row.
    """
    both = written(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = written(labels, "labels")
    while True:
        around = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        better = labels.join(around, labels.node == around.a).select("node", F.least("label", "m").alias("next"), F.col("label").alias("old"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        new = written(better.join(up, better.next == up.at, "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("label"), "old"), "labels")
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
