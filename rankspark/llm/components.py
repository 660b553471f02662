"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node that can be reached.

    Each round takes the smallest label among neighbours, then the label of the label, and is written
    to the shared folder.  Nodes with very many links are met only by joins whose two sides are
    both shuffled for the join (so that adaptive execution may split them) and by minima that are
    combined before the shuffle.
    """
    ways = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    ways = staged(ways.unionByName(ways.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct())
    labels = staged(ways.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select(
        "node", F.least("node", "m").alias("root")))
    while True:
        near = ways.join(labels, ways["v"] == labels["node"]).groupBy("u").agg(F.min("root").alias("near"))
        lower = staged(labels.join(near, labels["node"] == near["u"]).select(
            "node", F.col("root").alias("before"), F.least("root", "near").alias("root")))
        target = lower.select(F.col("node").alias("t"), F.col("root").alias("next"))
        jumped = staged(lower.join(target, lower["root"] == target["t"]).select("node", "before", F.col("next").alias("root")))
        if jumped.filter("root <> before").isEmpty():
            return jumped.select("node", "root")
        labels = jumped.select("node", "root")
