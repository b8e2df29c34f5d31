"""Connected components of an edge table, as joins that are written in the shared folder round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """``node, label`` of every node that has an edge; the label is the component's smallest node.

    Each round takes the smallest label of all neighbours and then the label's own
    label, so the number of rounds grows with the logarithm of the longest path.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("to")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("to")))
    both = materialise(both.where("node <> to").distinct(), "edges")
    labels = materialise(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("label")), "labels")
    known = labels
    for k in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("label").alias("near"))
        lower = materialise(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("before")), f"labels-{k}")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = materialise(lower.join(jump, "label", "left").select("node", F.coalesce("next", "label").alias("label"), "before"), f"labels-{k}-jump")
        discard(lower, known)
        known, labels = after, after.select("node", "label")
        if after.where("label <> before").limit(1).count() == 0:
            discard(both)
            return labels
    raise RuntimeError("components did not settle")
