"""Connected components by least labels, with lineage cut in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node of links; label is the least node of its component.

    Each round takes the least label among a node's neighbours (one partial
    aggregation) and then the label's own label, so that rounds grow with the
    logarithm of a component's longest path. Null nodes have no links.
    """
    own = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = settle(own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("m"))
        low = labels.join(seen, "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        jump = low.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = settle(low.join(jump, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "old"))
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
