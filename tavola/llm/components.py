"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b); the component is its smallest node.

    Each round takes the smallest label among a node's neighbours and then the
    label of its label, so chains shrink by half or more a round.  Every round
    is written, and a lost executor repeats no earlier one."""
    both = links.where("a <> b").select("a", "b")
    both = written(both.union(both.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node"))
                     .agg(F.min("b").alias("near"))
                     .select("node", F.least("node", "near").alias("component")), "labels")
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node"))
                .agg(F.min("component").alias("near")))
        lower = labels.join(near, "node").select("node", F.least("component", "near").alias("low"),
                                                 F.col("component").alias("was"))
        lower = written(lower, "lower")
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("lowest"))
        new = written(lower.join(jump, "low").select("node", F.col("lowest").alias("component"), "was"), "labels")
        if new.where("component <> was").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
