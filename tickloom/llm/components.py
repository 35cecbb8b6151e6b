"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import checkpointed

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its least node.

    Each round gives a node the least label around it and then that label's own label, so the
    number of rounds grows with the logarithm of a component's width. A node of many links
    costs no more than its links: labels are minima, which are taken before the shuffle too.
    Rounds are written to the shared folder.
    """
    spark = links.sparkSession
    both = checkpointed(spark, links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").distinct(), "links")
    labels = checkpointed(spark, both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    for _ in range(ROUNDS):
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        nearer = labels.join(around, labels["node"] == around["a"]).select("node", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        of_label = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = checkpointed(spark, nearer.join(of_label, "label", "left").select("node", F.least("label", "next").alias("label"), "was"), "labels")
        changed = after.where(F.col("label") != F.col("was")).limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components have not settled in {ROUNDS} rounds")
