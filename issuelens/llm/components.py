"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.operators.small import side_of
from issuelens.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node``, ``label`` (the smallest node reachable) for every node of links (a, b).

    Each round takes the smallest label among the neighbours and then the label of the
    label, so long chains halve. Rounds are written to the shared folder, which cuts the
    lineage; minima are combined before their shuffle, so a hub costs one row a task. The
    labels have a row for each node in every round: what is counted once holds for all.
    """
    pairs = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    pairs = materialize(pairs.toDF("node", "other"), "pairs")
    labels = pairs.groupBy("node").agg(F.min("other").alias("low"))
    labels = materialize(labels.select("node", F.least("node", "low").alias("label")), "labels")
    side = side_of(labels)
    while True:
        near = pairs.join(side(labels.withColumnRenamed("node", "other")), "other").groupBy("node").agg(F.min("label").alias("low"))
        step = side(labels).join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        step = materialize(step, "step")
        up = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = step.join(side(up), "label").select("node", "old", F.least("label", "next").alias("label"))
        jumped = materialize(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where("old <> label").isEmpty():
            return labels
