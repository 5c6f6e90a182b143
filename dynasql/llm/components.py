"""Connected components of a distributed edge list, in DataFrame operations only.

Alternating large-star and small-star steps (Kiveris et al., 2014): every step
is one aggregation with map-side combine and one equi-join, so a hub with a
third of all edges is combined before the shuffle and split by skew-join
handling. Edges are never collected; each round is a table in the shared
folder, so losing an executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, drop


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).union(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
    low = both.groupBy("x").agg(F.min("y").alias("m"))
    met = both.filter("y > x").join(low, "x").select(F.col("y").alias("v"), F.least("m", "x").alias("u"))
    return met.distinct()


def _small(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("v").agg(F.min("u").alias("m"))
    met = edges.join(low, "v").filter("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return met.union(low.select("v", F.col("m").alias("u"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root): each node that has an edge, and its component's smallest node.

    Nodes are non-null values of one orderable type. Self-loops, repeated edges
    and edges with a null end are ignored; no edges give an empty table.
    """
    e = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now, seen = cut(e), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        after = cut(_small(_large(now)))
        drop(now)
        now = after
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()
