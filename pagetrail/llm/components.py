"""Connected components of a link table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.shared import cut


def connected_components(links: DataFrame) -> DataFrame:
    """links: columns a, b of one type that can be ordered. Returns node, component (the least node of its component),
    for linked nodes.

    Each round gives a node the least of its own label, the labels of its neighbours, and the label of its label, so
    that the rounds grow with the logarithm of the longest path.  No list of neighbours is gathered; the labels of a
    round are written to the checkpoint folder.  Self links are ignored, repeated links do no harm, no links give no
    rows.
    """
    some = links.where("a <> b")
    both = cut(some.select("a", "b").unionByName(some.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), small=True)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    while True:
        labels = labels.select("node", "label")
        of_neighbour = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        of_label = labels.select(F.col("node").alias("l_node"), F.col("label").alias("far"))
        joined = labels.join(of_label, F.col("label") == F.col("l_node")).select("node", "label", "far").join(of_neighbour, "node")
        least = F.least("label", "far", "near")
        labels = cut(joined.select("node", least.alias("label"), (least != F.col("label")).alias("changed")), small=True)
        if labels.where("changed").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
