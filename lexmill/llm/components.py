"""Connected components of a table of links, with nothing gathered on the driver but a count a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .text import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach. Links may repeat or point to themselves.

    Each round takes the smallest label next door and then the label's own label, so chains shorten by half a round.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    both = cut(both.select("a", F.col("b").alias("node")))
    while True:
        near = both.join(labels, "node").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("up"))
        jump = labels.select(F.col("node").alias("up"), F.col("component").alias("top"))
        step = cut(step.join(jump, "up", "left").select("node", "old", F.least("up", F.coalesce("top", "up")).alias("component")))
        labels = step.select("node", "component")
        if step.filter("old != component").isEmpty():
            return labels
