"""Connected components of a link table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.session import durable


def components(links: DataFrame) -> DataFrame:
    """c, label (smallest node of its component) for every node of ``links`` (a, b).

    Every node points to a smaller one or to itself. In a round each link offers the grandparent of
    one end to the other end and to the other end's parent; each takes the smallest offer, and every node moves up
    to its grandparent. A node may so leave its tree for a smaller one, and the links bring the rest of that tree after
    it. Rounds grow with the logarithm of the longest path, whatever the order of its names. Each
    round is three written tables; the loop ends when the ends of every link agree and every parent is a root.
    """
    both = durable(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.min("a")).alias("f")))
    while True:
        up = labels.select(F.col("c").alias("f"), F.col("f").alias("g"))
        labels = durable(labels.join(up, "f").select("c", "f", "g"))
        # the smallest grandparent beside each node
        near = both.join(labels.select(F.col("c").alias("b"), F.col("g").alias("gb")), "b").groupBy(F.col("a").alias("c")).agg(F.min("gb").alias("low"))
        near = durable(labels.join(near, "c"))
        if near.where("f <> g OR low <> f").isEmpty():
            return near.select("c", F.col("f").alias("label"))
        taken = near.groupBy(F.col("f").alias("c")).agg(F.min("low").alias("offer"))
        labels = durable(near.join(taken, "c", "left").select("c", F.least("g", "low", F.coalesce("offer", "g")).alias("f")))
