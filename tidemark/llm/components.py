"""Connected components by contraction; only aggregates that combine map-side, no group is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.staging import staged


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a long, b long)``; component is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows two hooks, and contracts the edges. Nodes that
    aren't smaller than all their neighbours vanish, so rounds grow with the logarithm of the graph. Self loops and
    repeated edges do no harm; edges with a null end are left out; an empty input gives an empty result.
    """
    edges = staged(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    known = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent")), "hooks")
        up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        hooks = staged(hooks.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent")), "hooks")
        if known is None:
            known = hooks
        else:
            up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            known = staged(known.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent")), "known")
        for end in ("a", "b"):
            edges = edges.join(hooks.select(F.col("node").alias(end), F.col("parent").alias(f"{end}_up")), end).drop(end).withColumnRenamed(f"{end}_up", end)
        edges = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if known is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return known.select("node", F.col("parent").alias("component"))
