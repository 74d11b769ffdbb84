"""Connected components of large graphs by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialised

#: More rounds than any graph takes (their number grows with the logarithm of the longest path); beyond them something is wrong.
ROUNDS = 200


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round on edges (u, v), u > v: neighbours are linked to the smallest of them.

    The least neighbour of a node is an aggregate and joins back to the edges, so a node's
    neighbours are never gathered, however many they are.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        linked = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node without a larger neighbour keeps its link to the least one
        own = least.filter(F.col("m") < F.col("u")).select("u", F.col("m").alias("v"))
        return linked.unionByName(own).distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u")
    return (
        linked.filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b: longs); a component is its least node."""
    now = materialised(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    for _ in range(ROUNDS):
        after = materialised(_stars(_stars(now, True), False))
        discard(now)
        now = after
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components are not settled after {ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
