"""Connected components of links between nodes, by the smallest label that reaches a node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import cut


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links(a, b)``; ``label`` is the smallest node of its component.

    Each round takes the smallest label of a node and its neighbours, then the label of that label, so labels travel twice as far
    every time. Both sides of each join are written tables, which lets Spark split the rows of a node with many links; the smallest
    label is taken per task before the shuffle. Rounds end when no label changes. Links to oneself and repeated links do no harm.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both, "links")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    total = _total(labels)
    while total is not None:
        told = both.join(labels.select(F.col("node").alias("a"), "label"), "a").select(F.col("b").alias("node"), "label")
        nearer = cut(labels.unionByName(told).groupBy("node").agg(F.min("label").alias("label")), "labels")
        if _total(nearer) == total:
            break
        of = nearer.select(F.col("node").alias("label"), F.col("label").alias("farther"))
        labels = cut(nearer.join(of, "label").select("node", F.col("farther").alias("label")), "labels")
        total = _total(labels)
    return labels


def _total(labels: DataFrame):
    """Sum of all labels, which can only fall; null for no labels."""
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
