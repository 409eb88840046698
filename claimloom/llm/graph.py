"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators.joins import shuffled
from claimloom.session import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b); the component is its smallest node.

    Every round takes the smallest label among the neighbours and then the label of that label, so labels travel twice as far
    each time; rounds end when nothing changes.  Labels are stored in the shared checkpoint folder between rounds.
    """
    both = durable(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        around = both.join(shuffled(labels), F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        nearer = labels.join(shuffled(around), F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        nearer = durable(nearer)
        up = nearer.select(F.col("node").alias("up"), F.col("component").alias("jump"))
        moved = durable(nearer.join(shuffled(up), F.col("component") == F.col("up"), "left").select("node", "old", F.coalesce("jump", "component").alias("component")))
        labels = moved.drop("old")
        if moved.filter("old <> component").isEmpty():
            return labels
