"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that has an edge and isn't the least of its component, of edges (a, b).

    root is the least node of the component. Each round rewires every node to the least neighbour, first its larger
    neighbours, then its smaller ones, until nothing changes; the rounds grow with the logarithm of the component's size.
    Each round's edges are written to the shared folder. Least neighbours are added up before the shuffle and then joined
    to the edges, two plain shuffles, so that a node with a large part of all edges is split as a skewed join is.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = lambda x: F.struct(F.col(x).alias("a"), F.col("m").alias("b"))
        small = large.join(low, "a").select(F.explode(F.array(pair("a"), pair("b"))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = cut(small)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark


def merge(labels, a, b):
    """labels, changed in place so that a[k] and b[k] have one label, the least place of their component."""
    import numpy as np

    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return labels
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up
