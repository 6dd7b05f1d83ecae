"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of links (a, b); comp is the smallest node that it is connected to.

    Each round takes the smallest label among the neighbours and follows it to that node's own label, so paths shrink
    by doubling. Labels are summed up by key before the shuffle and staged after each round.
    """
    both = common.stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = common.stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("_near"))
        best = labels.join(near, labels["node"] == near["a"]).select("node", F.least("comp", "_near").alias("_best"), F.col("comp").alias("_old"))
        up = labels.select(F.col("node").alias("_at"), F.col("comp").alias("_up"))
        new = best.join(up, F.col("_best") == F.col("_at")).select("node", F.least("_best", "_up").alias("comp"), (F.least("_best", "_up") != F.col("_old")).alias("moved"))
        new = common.stage(new, "labels")
        labels = new.select("node", "comp")
        if new.where("moved").isEmpty():
            return labels
