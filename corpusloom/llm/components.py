"""Connected components by minimum labels and pointer jumping, every round staged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.staging import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``edges``; label is the smallest node that can be reached.

    Loops, repeated edges and either direction are fine. A round sends labels
    along all edges, then replaces each label by its label's label, so the
    number of rounds grows with the logarithm of a component's diameter.
    Nothing but the number of changed labels reaches the driver.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    pairs = stage(pairs.union(pairs.select("b", "a")).groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one"), "edges")
    labels = stage(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    changed = 1
    while changed:
        near = pairs.join(labels, pairs.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        sent = stage(labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels-sent")
        target = sent.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        moved = stage(sent.join(target, sent.label == target["at"]).select("node", "old", F.col("jump").alias("label")), "labels")
        changed = moved.filter("old <> label").limit(1).count()
        labels = moved.select("node", "label")
    return labels
