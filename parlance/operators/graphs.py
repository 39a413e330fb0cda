"""Connected components of an edge table, by passing the smallest label on and jumping along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.kept import kept


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node). Each round is checkpointed, where a checkpoint folder is set; rounds go on until no label changes."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    spark = edges.sparkSession
    held = kept(both)
    labels = held.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), F.least("u", "label").alias("component"))
    while True:
        ahead = labels.select(F.col("node").alias("v"), F.col("component").alias("other"))
        low = held.join(ahead, "v").groupBy("u").agg(F.min("other").alias("other"))
        near = labels.join(low, F.col("node") == F.col("u")).select("node", F.least("component", "other").alias("component"))
        jump = near.select(F.col("node").alias("at"), F.col("component").alias("to"))
        after = near.join(jump, F.col("component") == F.col("at")).select("node", F.least("component", "to").alias("component"))
        after = kept(after)
        same = after.join(labels.select("node", F.col("component").alias("was")), "node").where("component <> was").isEmpty()
        labels = after
        if same:
            return labels
