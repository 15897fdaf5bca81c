"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours and then the label of that label,
    so labels travel twice as far each time. Every round is written to the shared folder; the loop ends
    when no label changes. Loops and repeated edges do no harm; no edges give no rows.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct().toDF("a", "b"))
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        roots = hooked.select(F.col("node").alias("component"), F.col("component").alias("root"))
        step = hooked.join(roots, "component").select("node", "old", F.col("root").alias("component"))
        seen = Observation()
        step = stored(step.observe(seen, F.count_if(F.col("old") != F.col("component")).alias("changed")))
        labels = step.select("node", "component")
        if not seen.get["changed"]:
            return labels
