"""Nearest neighbours by collision-counting hashing (operator 8).

Method (query-aware hashing, Huang et al., 2015): every vector is projected on
PROJECTIONS random lines, and each line's projections are kept as one sorted
array. A query opens a window around its own projection on every line, at first
narrower than a usual k-th distance asks, and widens all windows together, step by step (virtual rehashing: a wider window is
a coarser hash of the same array). A vector that falls into the windows of
enough lines is verified by its true distance. Widening stops at REACH times the
distance of the k-th found. There a vector as near as that one collides on a
known share of the lines; the threshold lies SURE standard deviations below, so
farther vectors, which collide less often, mostly stay unverified. There is no
cap on the vectors verified.

Rows are dealt into candidate blocks and query blocks bounded in rows and in
bytes, each of vectors of one length, and each pair of blocks is one task's work;
every query block meets every candidate block, and no pairs of vectors leave a
task but the k nearest found.

Defined results: vectors that are null, empty, all zero or hold a null or
non-finite component take no part, nor do rows without a vec_id; a query meets
vectors of its own length only; ties go to the smaller vec_id. With `repeats`,
as in the query, each row that repeats a vec_id takes part by itself, as a
candidate of the others and as a query; without, such rows count once, with the
smallest vector. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import cut

K, EVERY = 10, 100
PROJECTIONS, SEED = 128, 11
#: Window over the k-th distance at which widening stops, standard deviations of certainty, and widening until k are found.
REACH, SURE, WIDEN = 2.0, 1.6, 1.25
#: Vectors of a block whose k-th distances tell how wide its windows are at first.
SAMPLE = 32
#: Share of the lines that must collide.
THRESHOLD = math.erf(REACH / math.sqrt(2)) - SURE * math.sqrt(math.erf(REACH / math.sqrt(2)) * math.erfc(REACH / math.sqrt(2)) / PROJECTIONS)
#: Rows of a block of candidates and of a block of queries, and bytes of vectors in either.
CANDIDATES, QUERIES, BLOCK_BYTES = 20_000, 5_000, 64_000_000


def usable(df: DataFrame, column: str = "embedding", repeats: bool = False) -> DataFrame:
    """(vec_id, v) of the rows that take part; with repeats also row, which tells rows apart once the result is stored."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))
    if repeats:
        return rows.withColumn("row", F.monotonically_increasing_id())
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


class Block:
    """Sorted projections of one block of vectors; `verified` counts true distances taken."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None):
        self.ids, self.vectors, self.rows, self.verified = ids, vectors, ids if rows is None else rows, 0
        self.lines = np.random.default_rng(SEED).standard_normal((PROJECTIONS, vectors.shape[1]))
        shadow = self.lines @ vectors.T
        self.order = np.argsort(shadow, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(shadow, self.order, axis=1)
        self.spread = float(np.median(self.sorted[:, -1] - self.sorted[:, 0]))

    def start(self, k: int) -> float:
        """The first half-width: below the usual k-th distance of the block's vectors, the smallest rows standing for all."""
        some = np.argsort(self.rows, kind="stable")[:SAMPLE]
        far = [np.sqrt(np.partition(((self.vectors - self.vectors[i]) ** 2).sum(axis=1), min(k, len(self.ids) - 1))[min(k, len(self.ids) - 1)]) for i in some]
        return REACH / WIDEN**2 * float(np.median(far)) or self.spread / 64 or 1e-9

    def collisions(self, at: np.ndarray, width: float) -> np.ndarray:
        """On how many lines each vector is in the window; windows that hold most vectors are counted by what lies outside."""
        n, hits = len(self.ids), np.zeros(len(self.ids), np.int32)
        for line, order, x in zip(self.sorted, self.order, at, strict=True):
            a, b = line.searchsorted((x - width, x + width))
            if 2 * (b - a) <= n:
                hits[order[a:b]] += 1
            else:
                hits += 1
                hits[order[:a]] -= 1
                hits[order[b:]] -= 1
        return hits

    def search(self, own: int, query: np.ndarray, k: int, width: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest found, nearest first; not the query's own row."""
        at, known = self.lines @ query, self.rows == own
        need, width = max(1, math.ceil(THRESHOLD * PROJECTIONS)), width or self.start(k)
        found, far = np.zeros(0, np.int64), np.zeros(0)
        while True:
            hits = self.collisions(at, width)
            new = np.flatnonzero((hits >= need) & ~known)
            if len(new):
                known[new] = True
                self.verified += len(new)
                gap = self.vectors[new] - query
                found, far = np.concatenate([found, new]), np.concatenate([far, np.sqrt((gap * gap).sum(axis=1))])
                if len(far) > k:
                    keep = np.lexsort((self.ids[found], far))[:k]
                    found, far = found[keep], far[keep]
            if known.all() or len(far) >= k and width >= REACH * far.max():
                break
            width = width * WIDEN if len(far) < k else min(width * WIDEN, REACH * far.max())
        order = np.lexsort((self.ids[found], far))[:k]
        return self.ids[found[order]], far[order]


def _search(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            block = Block(rows.vec_id.to_numpy(np.int64), np.stack(rows.v.to_numpy()).astype(np.float64), rows.row.to_numpy(np.int64))
            width = block.start(k)
            for q, row, v in zip(queries.vec_id, queries.row, queries.v, strict=True):
                ids, far = block.search(row, np.asarray(v, np.float64), k, width)
                out.append(pd.DataFrame({"query_id": q, "row": row, "vec_id": ids, "score": far}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "row": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "row": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _blocks(count: str, most: int) -> Column:
    """Blocks for rows of one length: at most `most` rows in each, and BLOCK_BYTES of vectors."""
    return F.ceil(F.col(count) / F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim")))))).cast("int")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (vec_id, v) its k nearest found in vectors.

    A column `row` in both tells rows of one vec_id apart; without it vec_ids are unique.
    """
    own = "row" if "row" in vectors.columns else "vec_id"
    sized = lambda df: df.select("vec_id", F.col(own).alias("row"), "v", F.size("v").alias("dim"))
    rows, asks = sized(vectors), sized(queries)
    counts = rows.groupBy("dim").agg(F.count("*").alias("n")).join(asks.groupBy("dim").agg(F.count("*").alias("m")), "dim")
    # Stored, so that its size is known and Spark broadcasts it only if it is small: lengths are few, but one may have all rows.
    plan = cut(counts.select("dim", _blocks("n", CANDIDATES).alias("bs"), _blocks("m", QUERIES).alias("qs")))
    place = lambda count, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    rows = rows.join(plan, "dim").select("vec_id", "row", "v", "dim", place("bs", 1).alias("b"), every("qs").alias("q"))
    asks = asks.join(plan, "dim").select("vec_id", "row", "v", "dim", every("bs").alias("b"), place("qs", 2).alias("q"))
    rows, asks = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (rows, asks))
    pairs = rows.groupBy("dim", "b", "q").cogroup(asks.groupBy("dim", "b", "q"))
    near = pairs.applyInPandas(_search(k), "query_id long, row long, vec_id long, score double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "row").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), repeats=True))
    return nearest(rows, rows.filter(F.col("vec_id") % EVERY == 0))
