"""Connected components of a graph given as edges, by label passing with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import written


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for each of ``nodes``.

    Each round every node takes the smallest label among its neighbours, then the label of its label,
    so chains shorten by half. Nothing but one count a round comes to the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = written(both, "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component"))
    labels = written(labels, "labels")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("component").alias("seen"))
        low = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("low"))
        step = labels.join(low, "node").select("node", F.col("component").alias("old"), F.least("component", "low").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        step = written(step.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("component")), "labels")
        changed = step.filter("component <> old").limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            break
    return nodes.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
