"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def components(edges: DataFrame) -> DataFrame:
    """Label every node of edges (`u`, `v`, both long) with the smallest node it can reach: (`node`, `label`).

    Each round takes the smallest label among the neighbours and then jumps to the label's own label, so labels
    travel twice as far every time. Rounds are written to the shared folder; nothing but their counts of changes
    comes to the driver. Before the first, every node hands its smallest neighbour to its other smaller ones: what
    many nodes of a group have in common is then said once.
    """
    down = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    handed = down.join(least, "u").where(F.col("v") > F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    few = least.select("u", F.col("least").alias("v")).unionByName(handed).distinct()
    both = staged(few.unionByName(few.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["u"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        lower = staged(lower, "labels")
        jump = lower.select(F.col("node").alias("at"), F.col("label").alias("to"))
        after = lower.join(jump, F.col("label") == F.col("at"), "left").select("node", F.least("label", "to").alias("label"), "old")
        after = staged(after, "labels")
        moved = after.where(F.col("label") != F.col("old")).limit(1).count()
        for done in (labels, lower):
            unstage(done)
        labels = after
        if not moved:
            unstage(down)
            unstage(both)
            return labels.select("node", "label")
