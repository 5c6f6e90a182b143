"""Exact and approximate nearest neighbours over a vector column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from .search import search

#: Queries of a block, which is sent to every task; about so many at most.
MOST_QUERIES = 10_000


def knn(df: DataFrame, query: list[float], k: int, *, metric: str = "l2", id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows to one query, nearest first, ties by id, with `distance`.

    Each task keeps its k best (TakeOrderedAndProject); nothing else moves.
    """
    near = df.select(F.col(id), V.distance(metric, F.col(vector), V.vector(query)).alias("distance"))
    return near.orderBy("distance", id).limit(k)


def distance_to(df: DataFrame, query: list[float], key, *, metric: str = "l2", id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return df.filter(F.col(id) == F.lit(key)).select(F.col(id), V.distance(metric, F.col(vector), V.vector(query)).alias("distance"))


def _by_block(queries: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """answer(block) for all blocks of queries; all rows of a query_id are in one block."""
    n = -(-queries.count() // MOST_QUERIES)
    place = F.pmod(F.xxhash64("query_id"), F.lit(max(n, 1)))
    blocks = [queries.filter(place == i) for i in range(n)] if n > 1 else [queries]
    return reduce(DataFrame.union, map(answer, blocks))


def _best(df: DataFrame, k: int, id: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), id)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn_batch(df: DataFrame, queries: DataFrame, k: int, *, metric: str = "l2", id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each query (query_id, q) its k nearest rows."""
    return _nearest(df, queries, k, metric, id, vector)


def planes(size: int, bits: int, tables: int, seed: int = 5) -> list[list[list[float]]]:
    import random

    rnd = random.Random(seed)
    return [[[rnd.gauss(0, 1) for _ in range(size)] for _ in range(bits)] for _ in range(tables)]


def _whole(v: Column, size: int | None = None) -> Column:
    """The vector as doubles; null if a component is, or if it has another length."""
    fine = F.forall(v, lambda x: x.isNotNull())
    return F.when(fine if size is None else fine & (F.size(v) == size), V.doubles(v))


def _nearest(df: DataFrame, queries: DataFrame, k: int, metric: str, id: str, vector: str, size: int | None = None, hyperplanes: list | None = None) -> DataFrame:
    """Rows stay in the tasks that read them and meet each block of queries there; only the k nearest of a task are shuffled."""
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric: {metric}")
    rows = df.select(F.col(id), _whole(F.col(vector), size).alias(vector))
    asks = queries.select("query_id", _whole(F.col("q"), size).alias("q"))
    if hyperplanes is not None:  # what has no bucket meets nothing
        rows, asks = rows.filter(F.col(vector).isNotNull()), asks.filter(F.col("q").isNotNull())
    kinds = T.StructType([T.StructField("query_id", asks.schema["query_id"].dataType), T.StructField(id, rows.schema[id].dataType), T.StructField("distance", T.DoubleType())])

    def answer(block: DataFrame) -> DataFrame:
        table = block.toArrow().combine_chunks()
        sent = df.sparkSession.sparkContext.broadcast(tuple(_one(c) for c in table.columns))
        return _best(rows.mapInArrow(search(sent, k, metric, hyperplanes, id), kinds), k, id)

    return _by_block(asks, answer)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def ann_batch(df: DataFrame, queries: DataFrame, k: int, size: int, *, metric: str = "l2", bits: int = 4, tables: int = 24, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Approximate k nearest: rows that share a bucket with the query in any table, then exact distances."""
    return _nearest(df, queries, k, metric, id, vector, size, planes(size, bits, tables))


def knn_quantized(df: DataFrame, query: list[float], k: int, *, metric: str = "l2", id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """k nearest by distances to vectors kept as bytes."""
    small = df.select(F.col(id), V.dequantize(V.quantize(F.col(vector))).alias("v"))
    return knn(small, query, k, metric=metric, id=id, vector="v")


def recall(exact: DataFrame, found: DataFrame, k: int, id: str = "vec_id") -> DataFrame:
    """(query_id, recall): distinct exact neighbours that were found, over k."""
    hits = exact.select("query_id", id).distinct().join(found.select("query_id", id).distinct().withColumn("__hit", F.lit(1)), ["query_id", id], "left")
    return hits.groupBy("query_id").agg((F.count("__hit") / F.lit(k)).alias("recall"))


def quantization_report(df: DataFrame, query: list[float], k: int, *, metric: str = "l2", id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row: recall at k, mean reconstruction error and compression of bytes against doubles."""
    a = knn(df, query, k, metric=metric, id=id, vector=vector).withColumn("query_id", F.lit(0))
    b = knn_quantized(df, query, k, metric=metric, id=id, vector=vector).withColumn("query_id", F.lit(0))
    error = df.agg(F.avg(F.sqrt(V.distance("l2", F.col(vector), V.dequantize(V.quantize(F.col(vector)))))).alias("mean_error"))
    return recall(a, b, k, id).select("recall").crossJoin(error).withColumn("compression", F.lit(8.0))
