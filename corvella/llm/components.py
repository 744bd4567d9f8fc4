"""Connected components of a table of links, by repeated contraction on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """From links (a long, b long) to (node, label): label is the same for all nodes of a component.

    Each round replaces every node by the smallest of it and its neighbours and drops links within a node;
    as labels are hashes, the number of rounds grows with the logarithm of the nodes. Each round is written.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    found = nodes.select("node", F.col("node").alias("label"))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = stored(both.groupBy(F.col("a").alias("label")).agg(F.least(F.col("label"), F.min("b")).alias("m")), "smallest")
        labels = stored(found.join(smallest, "label", "left").select("node", F.coalesce("m", "label").alias("label")), "labels")
        left, right = (smallest.select(F.col("label").alias(c), F.col("m").alias(f"m{c}")) for c in "ab")
        fewer = stored(edges.join(left, "a").join(right, "b").select(F.col("ma").alias("a"), F.col("mb").alias("b")).where("a <> b").distinct(), "links")
        for old in (edges, smallest, *([found] if hasattr(found, "stored_at") else [])):
            discard(old)
        found, edges = labels, fewer
    return found
