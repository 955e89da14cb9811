"""Connected components by alternating large-star and small-star steps, which cope with very large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.shared import cut, packed

ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component: the smallest node that each linked node reaches. Nodes without a link have no row.

    links has two bigint columns. Each step sends every edge to the least neighbour of one of its ends: only minima are
    aggregated, and joined back, so no neighbourhood is gathered anywhere. The number of steps is logarithmic.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edges = cut(links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = _state(edges)
    if not before[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    rows = 2 * before[0]  # of every table below, at most
    edges = packed(edges, rows)
    for _ in range(ROUNDS):
        # Large star: every larger neighbour of a node is linked with the least in its neighbourhood.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = packed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), rows)
        large = packed(both.where(F.col("b") > F.col("a")).join(least, "a"), rows).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = packed(cut(packed(large.where(F.col("a") != F.col("b")).distinct(), rows)), rows)
        # Small star: a node and its smaller neighbours are linked with the least of these.
        least = packed(large.groupBy("a").agg(F.min("b").alias("m")), rows)
        small = packed(large.join(least, "a"), rows).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = packed(cut(packed(small.where(F.col("a") != F.col("b")).distinct(), rows)), rows)
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
