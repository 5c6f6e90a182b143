"""Groups of 64-bit fingerprints linked by small Hamming distance, exactly.

A fingerprint is cut into blocks; two that differ in at most k bits agree on
all but k of them, so a row for each choice of the other blocks meets its
partner under an equal key. How many blocks to cut is chosen from the number
of fingerprints only: every choice finds the same links, more blocks make
buckets smaller and rows more.

All pairs of a bucket are never written. First each member is compared with
its bucket's smallest member, and what is linked is contracted. Only buckets
that then still hold more than one component are joined with themselves, and
only pairs from different components with a small distance come out of the
join, so a bucket of thousands of near copies yields links in proportion to
its size, and no link is lost.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut
from .components import components

#: Cost of one shuffled row against one comparison inside a bucket.
ROW_COST = 200.0


def block_count(n: int, k: int) -> int:
    """Blocks that cost least for n fingerprints and distance k."""

    def cost(b: int) -> float:
        return comb(b, k) * (ROW_COST * n + n * n / 2.0 ** (64 * (b - k) / b + 1))

    return min(range(k + 1, k + 6), key=cost)


def block_keys(fp: Column, blocks: int, k: int) -> Column:
    """Array of one 64-bit key for each choice of blocks - k blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for i, chosen in enumerate(combinations(range(blocks), blocks - k)):
        mask = sum(((1 << (edges[c + 1] - edges[c])) - 1) << edges[c] for c in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(signed).cast("long"))))
    return F.array(*keys)


def distance(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def hamming_components(prints: DataFrame, k: int) -> DataFrame:
    """(fp, root) for each distinct non-null fp of prints that is linked to another.

    Keys are 64-bit hashes of (choice, blocks); an accidental equality only adds
    a comparison, since the distance is checked on whole fingerprints.
    """
    fps = prints.select("fp").filter("fp is not null").distinct()
    n = fps.count()
    b = block_count(n, k)
    buckets = fps.select("fp", F.explode(block_keys(F.col("fp"), b, k)).alias("key"))
    lead = buckets.withColumn("lead", F.min("fp").over(Window.partitionBy("key")))
    star = lead.filter((F.col("lead") != F.col("fp")) & (distance("fp", "lead") <= k))
    first = cut(components(star, "fp", "lead"))
    named = fps.join(first.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    keyed = named.select("fp", "root", F.explode(block_keys(F.col("fp"), b, k)).alias("key"))
    span = Window.partitionBy("key")
    mixed = keyed.withColumns({"lo": F.min("root").over(span), "hi": F.max("root").over(span)}).filter("lo != hi").select("key", "fp", "root")
    x, y = mixed.alias("x"), mixed.alias("y")
    cross = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & (distance("x.fp", "y.fp") <= k))
    more = cut(components(cross.select(F.col("x.root").alias("a"), F.col("y.root").alias("b"))))
    second = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
    alone = more.join(first, "node", "left_anti").select(F.col("node").alias("fp"), "root")
    return first.join(second, "root", "left").select(F.col("node").alias("fp"), F.coalesce("top", "root").alias("root")).union(alone)
