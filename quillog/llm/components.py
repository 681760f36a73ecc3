"""Connected components of an undirected graph by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillog.session import durable


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (columns a, b); component is the smallest node.

    Each step takes the smallest label among a node and its neighbours, then follows that label one
    hop. Stars settle in two or three steps and long chains in a logarithmic number. Only a count of
    changed labels returns to the driver. An empty table of edges gives an empty result.
    """
    both = durable(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("_c")), "b").groupBy("a").agg(F.min("_c").alias("_c"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("_old"), F.least("component", "_c").alias("_new"))
        hop = labels.select(F.col("node").alias("_new"), F.col("component").alias("_next"))
        moved = durable(new.join(hop, "_new", "left").select("node", "_old", F.least("_new", F.coalesce("_next", "_new")).alias("component")))
        changed = moved.where(F.col("_old") != F.col("component")).limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels
