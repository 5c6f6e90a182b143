import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dynasql.functions import vectors as V
from dynasql.operators import knn as K
from dynasql.operators import search
from dynasql.operators.chunking import chunk_text
from dynasql.plans import api_queries
from dynasql.streaming.windows import stream_table, windowed_counts, write_stream


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0])], "a array<double>, b array<double>")
    got = df.select(*(V.distance(m, F.col("a"), F.col("b")).alias(m) for m in V.METRICS)).first()
    assert got.l2 == 13 and got.l1 == 5 and got.inner_product == -1 and math.isclose(got.cosine, 1 - 1 / math.sqrt(50))
    for bad in ([0.0, 0.0], [1.0]):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad, [1.0, 2.0])], "a array<double>, b array<double>").select(V.distance("cosine", F.col("a"), F.col("b"))).collect()


def test_knn_edges_and_recall(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = [float(x) for x in df.filter("vec_id = 3").first().embedding]
    assert K.knn(df, q, 0).count() == 0 and K.knn(df, q, 10_000).count() == df.count()
    assert K.knn(df, q, 1).first().vec_id == 3
    asks = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    exact, found = K.knn_batch(df, asks, 5), K.ann_batch(df, asks, 5, 64)
    assert K.recall(exact, found, 5).agg(F.avg("recall")).first()[0] >= 0.9
    r = K.quantization_report(df, q, 10).first()
    assert r.recall > 0.9 and r.mean_error < 0.05


def test_batches_of_many_blocks(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    asks = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    rows = lambda f: sorted((r.query_id, r.rank, r.vec_id) for r in f.collect())
    whole = rows(K.knn_batch(df, asks, 5)), rows(K.ann_batch(df, asks, 5, 64))
    monkeypatch.setattr(K, "MOST_QUERIES", (asks.count() + 1) // 2)
    assert whole == (rows(K.knn_batch(df, asks, 5)), rows(K.ann_batch(df, asks, 5, 64)))


def by_pairs(df, asks, k, bits=None, metric="l2"):
    """The k nearest from all pairs; with bits of those that share a bucket in a table, by native Columns."""
    met = df.select("vec_id", "embedding").crossJoin(asks)
    if bits:
        v, q = F.col("embedding"), F.col("q")
        side = lambda c, t: F.aggregate(F.array(*(V.vector(p) for p in t)), F.lit(0), lambda a, p: a * 2 + (V.dot(c, p) > 0).cast("int"))
        buckets = lambda c: F.array(*(side(c, t) for t in bits))
        met = met.filter(F.exists(F.zip_with(buckets(v), buckets(q), lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False))))
    far = met.select("query_id", "vec_id", V.distance(metric, F.col("embedding"), F.col("q")).alias("distance"))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "vec_id")
    return kept(far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))


def kept(df):
    return sorted((r.query_id, r["rank"], r.vec_id, repr(r.distance)) for r in df.collect())


NAN, INF = float("nan"), float("inf")
ODD = [[1.0, 0.0, 2.0], [1.0, 0.0, 2.0], [0.0, 0.0, 0.0], [-0.0, 0.0, 0.0], [NAN, 1.0, 1.0], [INF, 1.0, 0.0], [-INF, 1.0, 0.0], None, [1.0, None, 2.0], [1e200, 1.0, 1.0], [1e200, 2.0, 1.0], [1e-200, 0.0, 1e-170], [3.0, 3.0, 3.0], [3.0, 3.0, 3.0 + 1e-12], [1e8, 1e8, 1e-8], [1e8, 1e8, 0.0]]


def odd(spark):
    # Copies of each, ids out of order, in several tasks.
    rows = [((i * 37 + 5) % 96, v) for i, v in enumerate(ODD * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return df, df.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@pytest.mark.parametrize("k", [1, 5, 200])
def test_ann_batch_equals_all_pairs(spark, sf, monkeypatch, k):
    monkeypatch.setattr(search, "TILE", 7)
    df, asks = odd(spark)
    assert kept(K.ann_batch(df, asks, k, 3, tables=2)) == by_pairs(df, asks, k, K.planes(3, 4, 2))
    assert kept(K.ann_batch(df.limit(0), asks, k, 3)) == kept(K.ann_batch(df, asks.limit(0), k, 3)) == []
    df = spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id < 150")
    df = df.unionByName(df.withColumn("vec_id", F.col("vec_id") + 1000)).repartition(2)
    asks = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert kept(K.ann_batch(df, asks, k, 64, tables=2)) == by_pairs(df, asks, k, K.planes(64, 4, 2))


def test_ann_batch_moves_the_nearest_only(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").repartition(2)
    asks = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    monkeypatch.setattr(K, "_best", lambda df, k, id: df)
    assert K.ann_batch(df, asks, 5, 64).count() <= 2 * asks.count() * 5


@pytest.mark.parametrize("metric", V.METRICS)
@pytest.mark.parametrize("k", [1, 5, 200])
def test_knn_batch_equals_all_pairs(spark, sf, monkeypatch, k, metric):
    monkeypatch.setattr(search, "TILE", 7)
    monkeypatch.setattr(search, "ROWS", 13)
    df, asks = odd(spark)
    if metric == "cosine":
        with pytest.raises(Exception, match="zero vector"):
            K.knn_batch(df, asks, k, metric=metric).collect()
        df, asks = (f.filter(F.coalesce(F.exists(c, lambda x: F.abs(x) > 1e-150), F.lit(True))) for f, c in ((df, "embedding"), (asks, "q")))
    assert kept(K.knn_batch(df, asks, k, metric=metric)) == by_pairs(df, asks, k, metric=metric)
    assert kept(K.knn_batch(df.filter("embedding IS NULL"), asks, k, metric=metric)) == by_pairs(df.filter("embedding IS NULL"), asks, k, metric=metric)


def test_knn_batch_ids_of_text_and_lengths(spark):
    df = spark.createDataFrame([(i, [float(len(i or "")), 1.0]) for i in ["b", "a", "é", "z", None, "aa", "B"]], "vec_id string, embedding array<float>")
    asks = df.select(F.upper("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    rows = lambda f: sorted(map(str, f.collect()))
    far = df.crossJoin(asks).select("query_id", "vec_id", V.distance("l2", F.col("embedding"), F.col("q")).alias("distance"))
    want = far.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).filter("rank <= 3")
    assert rows(K.knn_batch(df, asks, 3)) == rows(want)
    with pytest.raises(Exception, match="length"):
        K.knn_batch(df, spark.createDataFrame([(1, [1.0])], "query_id long, q array<double>"), 3).collect()


def test_knn_batch_compares_pairs_by_blocks(spark, sf):
    """Only the pairs that a bound lets through get exact distances; before, each pair did, by itself."""
    rows = np.random.default_rng(1).normal(size=(4000, 64))
    near = search.Nearest(pa.array(range(80)), pa.array(list(rows[:80])), 5, "l2")
    taken, far = [], near._far
    near._far = lambda rows, query, row: taken.append(len(row)) or far(rows, query, row)
    for at in range(0, 4000, 1000):
        near.add(pa.array(range(at, at + 1000)), pa.array(list(rows[at : at + 1000])))
    assert sum(taken) <= 80 * 5 * 4 and near.found.to_pylist()[::5] == list(range(80))
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    asks = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert "NestedLoop" not in K.knn_batch(df, asks, 5)._jdf.queryExecution().toString()


def test_ann_recall_ranks_the_nearest_of_tasks_only(spark, sf, monkeypatch):
    ranked, best = [], K._best
    monkeypatch.setattr(K, "_best", lambda df, k, id: ranked.append(df) or best(df, k, id))
    got = {r.query_id: r.recall for r in api_queries.ann_recall(spark, sf).collect()}
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    asks = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert len(ranked) == 2 and all(f.count() <= df.rdd.getNumPartitions() * asks.count() * 5 for f in ranked)
    exact, found = ({r[0:3:2] for r in kept(f)} for f in (K.knn_batch(df, asks, 5), K.ann_batch(df, asks, 5, 64)))
    assert got == {q: len({p for p in exact & found if p[0] == q}) / 5 for q, _ in exact}


@pytest.mark.parametrize("size,overlap", [(10, 3), (1, 0), (7, 6), (100, 0)])
def test_chunks(spark, size, overlap):
    texts = ["", "é" * 25, "hello world " * 5, "a", "x" * 10, None]
    got = chunk_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size, overlap).collect()
    for i, t in enumerate(texts):
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r["index"])
        step = size - overlap
        starts = list(range(0, max(len(t) - size, 0) + step, step)) if t else []
        starts = [s for j, s in enumerate(starts) if j == 0 or starts[j - 1] + size < len(t)]
        assert [r.text for r in mine] == [t[s : s + size] for s in starts]
        for r in mine:
            assert t.encode()[r.start : r.end].decode() == r.text


def test_stream_equals_batch(spark, sf, tmp_path):
    src = f"{sf}/events.parquet"
    events = spark.read.parquet(src)
    events.limit(0).write.parquet(str(tmp_path / "in"))
    events.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
    end = events.limit(1).select(*(F.lit("2030-01-01").cast("timestamp_ntz").alias(c) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in events.dtypes))
    query = write_stream(windowed_counts(stream_table(spark, str(tmp_path / "in"), events.schema)), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    end.write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark past all windows
    for _ in range(2):
        write_stream(windowed_counts(stream_table(spark, str(tmp_path / "in"), events.schema)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    rows = lambda df: sorted((str(r[0]), r[1], r[2]) for r in df.collect())
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(windowed_counts(events))
