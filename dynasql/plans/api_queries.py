"""Named queries that use the DataFrame API: vectors, chunks, changes to tables, streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import knn as K
from ..operators.chunking import chunk_text
from ..sources.tables import folder
from ..sql.database import Database
from ..streaming.windows import windowed_counts

#: Query vectors of the checks are those of these rows; 64 components.
QUERY_ID, SIZE, EVERY = 7, 64, 50


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _one(df: DataFrame) -> list[float]:
    return [float(x) for x in df.filter(F.col("vec_id") == QUERY_ID).first().embedding]


def _knn(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _vectors(spark, sf_dir)
        return K.knn(df, _one(df), 10, metric=metric).withColumn("distance", F.round("distance", 9))

    return run


def _asks(df: DataFrame) -> DataFrame:
    return df.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def distance_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir)
    return K.distance_to(df, _one(df), 11).withColumn("distance", F.round("distance", 9))


def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir)
    return K.knn_batch(df, _asks(df), 5).withColumn("distance", F.round("distance", 9))


def ann_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir)
    return K.ann_batch(df, _asks(df), 5, SIZE)


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir)
    return K.recall(K.knn_batch(df, _asks(df), 5), K.ann_batch(df, _asks(df), 5, SIZE), 5)


def vector_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).groupBy(V.valid(F.col("embedding"), SIZE).cast("int").alias("ok")).agg(F.count("*").alias("n"))


def quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _vectors(spark, sf_dir).select("vec_id", V.quantize(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.round("q.scale", 12).alias("scale"), F.aggregate(F.transform("q.codes", lambda x: x.cast("int")), F.lit(0), lambda a, x: a + F.abs(x)).alias("mass"))


def quantization_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir)
    return K.quantization_report(df, _one(df), 10)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_text(spark.read.parquet(f"{sf_dir}/documents.parquet"), 200, 40)


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))


def _script(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Database(spark, folder(spark, sf_dir)).execute(text)[-1]

    return run


_L2 = "list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2))"
_DOT = "list_sum(list_transform(range(1, 65), lambda i: {0}.embedding[i]::DOUBLE * {1}.embedding[i]::DOUBLE))"
_METRIC = {
    "l2": _L2,
    "l1": "list_sum(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)))",
    "inner_product": f"-({_DOT.format('a', 'b')})",
    "cosine": f"1 - {_DOT.format('a', 'b')} / (sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')}))",
}


def _knn_sql(metric: str) -> str:
    return f"SELECT a.vec_id, round({_METRIC[metric]}, 9) AS distance FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id = {QUERY_ID}) b ORDER BY {_METRIC[metric]}, a.vec_id LIMIT 10"


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    **{f"knn_{m}": (_knn(m), _knn_sql(m)) for m in V.METRICS},
    "vector_distance_to": (distance_to_one, f"SELECT a.vec_id, round({_L2}, 9) AS distance FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id = {QUERY_ID}) b WHERE a.vec_id = 11"),
    "knn_batch": (knn_batch, f"SELECT query_id, vec_id, round(d, 9) AS distance, rank FROM (SELECT b.vec_id AS query_id, a.vec_id, {_L2} AS d, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_L2}, a.vec_id)::INTEGER AS rank FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id % {EVERY} = 0) b) WHERE rank <= 5"),
    "ann_batch": (ann_batch, None),
    "ann_recall": (ann_recall, None),
    "vector_valid": (vector_valid, "SELECT (len(embedding) = 64)::INTEGER AS ok, count(*) AS n FROM embeddings GROUP BY 1"),
    "vector_quantize": (quantize, "SELECT vec_id, round(s, 12) AS scale, list_sum(list_transform(embedding, lambda x: abs(round(x::DOUBLE / s))))::INTEGER AS mass FROM (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 127 AS s FROM embeddings)"),
    "vector_quantization_report": (quantization_report, None),
    "chunk_text": (chunks, """SELECT doc_id, i::INTEGER AS "index", octet_length(encode(substring(text, 1, i * 160)))::INTEGER AS start, (octet_length(encode(substring(text, 1, i * 160))) + octet_length(encode(substring(text, i * 160 + 1, 200))))::INTEGER AS "end", substring(text, i * 160 + 1, 200) AS text
        FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 200) / 160.0), 0)::INTEGER + 1)) AS i FROM documents WHERE length(text) > 0)"""),
    "stream_windows": (windows, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"),
    "dml_insert_select": (_script("CREATE TABLE big(k INTEGER PRIMARY KEY, name TEXT, bal REAL DEFAULT 0.5); INSERT INTO big(k, name) SELECT c_custkey, c_name FROM customer WHERE c_custkey <= 50; INSERT INTO big SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey > 1400; SELECT k, name, bal FROM big"),
                          "SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey <= 50 THEN 0.5::DOUBLE ELSE c_acctbal END AS bal FROM customer WHERE c_custkey <= 50 OR c_custkey > 1400"),
    "dml_insert_select_all": (_script("CREATE TABLE big(k INTEGER PRIMARY KEY, name TEXT, bal REAL DEFAULT 0.5); INSERT INTO big(k, name) SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'; INSERT INTO big SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_mktsegment IS NULL; SELECT k, name, bal FROM big"),
                              "SELECT c_custkey AS k, c_name AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.5::DOUBLE ELSE c_acctbal END AS bal FROM customer"),
    "dml_insert_ignore_replace": (_script("CREATE TABLE t(k INT UNIQUE, v TEXT NOT NULL); INSERT INTO t VALUES (1, 'a'), (2, 'b'); INSERT OR IGNORE INTO t VALUES (2, 'x'), (3, 'c'), (4, NULL); REPLACE INTO t VALUES (1, 'z'), (NULL, 'n'); SELECT k, v FROM t"),
                                  "SELECT * FROM (VALUES (1, 'z'), (2, 'b'), (3, 'c'), (NULL, 'n')) t(k, v)"),
    "dml_update": (_script("CREATE TABLE n AS SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation; UPDATE n SET r = r + 10, name = name || '!' WHERE k % 3 = 0; SELECT k, name, r FROM n"),
                   "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN n_name || '!' ELSE n_name END AS name, CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey + 10 ELSE n_regionkey END AS r FROM nation"),
    "dml_delete": (_script("CREATE TABLE s AS SELECT s_suppkey AS k, s_acctbal AS b FROM supplier; DELETE FROM s WHERE b < 5000 OR k IS NULL; SELECT k, b FROM s"), "SELECT s_suppkey AS k, s_acctbal AS b FROM supplier WHERE s_acctbal >= 5000"),
    "ddl_alter_rollback": (_script("CREATE TABLE a(x INT, CHECK (x > 0)); INSERT INTO a VALUES (1), (2); ALTER TABLE a ADD COLUMN y TEXT DEFAULT 'd'; BEGIN; DELETE FROM a; ROLLBACK; INSERT INTO a VALUES (3, 'e'); SELECT x, y, rowid AS r FROM a"),
                           "SELECT * FROM (VALUES (1, 'd', 1), (2, 'd', 2), (3, 'e', 3)) t(x, y, r)"),
    "ddl_pragma_table_info": (_script("CREATE TABLE p(a INTEGER PRIMARY KEY, b TEXT NOT NULL DEFAULT 'd', c REAL); PRAGMA table_info(p)"),
                              "SELECT * FROM (VALUES (0, 'a', 'INTEGER', 0, NULL, 1), (1, 'b', 'TEXT', 1, 'd', 0), (2, 'c', 'REAL', 0, NULL, 0)) t(cid, name, type, \"notnull\", dflt_value, pk)"),
    "ddl_schema_table": (_script("CREATE TABLE q(a INT); CREATE UNIQUE INDEX qi ON q(a); SELECT type, name, tbl_name FROM schema"), "SELECT * FROM (VALUES ('table', 'q', 'q'), ('index', 'qi', 'q')) t(type, name, tbl_name)"),
    "ddl_view": (_script("CREATE VIEW v AS SELECT n_name AS x FROM nation WHERE n_regionkey = 1; SELECT x FROM v"), "SELECT n_name AS x FROM nation WHERE n_regionkey = 1"),
    "rowid_scan": (_script("CREATE TABLE w(v TEXT); INSERT INTO w VALUES ('a'), ('b'), ('c'); SELECT rowid AS r, v FROM w WHERE rowid > 1"), "SELECT * FROM (VALUES (2, 'b'), (3, 'c')) t(r, v)"),
}
