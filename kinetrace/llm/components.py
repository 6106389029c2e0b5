"""Connected components of an edge table, by contraction.

Every node points to its least neighbour (or itself), edges are carried over to what
their ends point to, and loops are dropped; when no edge is left, the chains of
pointers have become labels. Each round at least halves the nodes of every component,
so a chain of n nodes takes log2(n) rounds. All tables stay in the shared folder, and
the driver only sees whether an edge is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.storage import keep


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the least node of its component."""
    edges = keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while edges.head(1):
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        point = keep(both.groupBy("node").agg(F.least("node", F.min("other")).alias("to")), "pointers")
        if labels is None:
            labels = point.select("node", F.col("to").alias("label"))
        else:
            l, p = labels.alias("l"), point.alias("p")
            labels = keep(l.join(p, F.col("l.label") == F.col("p.node"), "left").select("l.node", F.coalesce("p.to", "l.label").alias("label")), "labels")
        a, b = point.select(F.col("node").alias("a"), F.col("to").alias("a2")), point.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        moved = edges.join(a, "a").join(b, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        edges = keep(moved.where("a <> b").distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
