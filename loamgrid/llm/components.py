"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loamgrid.llm.base import cut, drop_settled


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the least node each node of ``edges(a, b)`` can reach.

    Each round a node takes the least label around it and then that label's label, so rounds grow with the logarithm
    of a path.  Rounds are written to the shared folder; a hub's edges are combined before they are shuffled.
    """
    both = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    labels = cut(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        known = labels.select(F.col("node").alias("k"), F.col("label").alias("kl"))
        around = both.join(known, F.col("other") == F.col("k")).select("node", F.col("kl").alias("x"))
        # a label's node hears of what its holders hear
        held = around.join(known, F.col("node") == F.col("k")).select(F.col("kl").alias("node"), "x")
        least = around.unionByName(held).groupBy(F.col("node").alias("n")).agg(F.min("x").alias("x"))
        one = labels.join(least, F.col("node") == F.col("n"), "left").select(
            "node", F.least("label", F.coalesce("x", "label")).alias("next"), F.col("label").alias("was")
        )
        new = cut(one.join(known, F.col("next") == F.col("k")).select("node", F.least("next", "kl").alias("label"), "was"))
        moved = new.where("label <> was").limit(1).count()
        drop_settled(labels)
        labels = new.select("node", "label")
        if not moved:
            drop_settled(both)
            return labels
