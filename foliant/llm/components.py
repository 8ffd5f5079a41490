"""Connected components by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, label), label being the smallest node that it reaches; nodes without edges are absent.

    Every round takes the smallest label among the neighbours and then the label's own label. Labels are written
    to the shared folder after each round; the driver learns only whether one has changed.
    """
    both = edges.where("a != b").select("a", "b").unionByName(edges.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(seen, "node").select("node", F.least("label", "near").alias("low"), "label")
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        new = materialize(least.join(up, "low").select("node", F.least("low", "up").alias("label"), (F.least("low", "up") != F.col("label")).alias("changed")))
        if new.where("changed").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
