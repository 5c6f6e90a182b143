"""What the training-data operators share: words, let-bindings and shared tables."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: U+0020 and U+0009 to U+000D, nothing else.
SPACES = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(text: Column | str) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for a null or blank one."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it in body any number of times.

    Catalyst inlines projections, which would evaluate a costly array again at
    each use inside a lambda; a one-element transform keeps it bound.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is named and everything runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not hasattr(shared_dir, "own"):
            shared_dir.own = "file://" + tempfile.mkdtemp(prefix="dynasql-")
        where = shared_dir.own
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, so lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that cut() wrote and that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "cut_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Free the shuffle files of finished steps; else they stay until the driver happens to collect its garbage.

    What a plan holds becomes free only after the plan itself was collected, so this takes two rounds.
    """
    gc.collect()
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.1)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal small but costly rows to as many tasks as a shuffle has, at least one for each core."""
    conf, sc = df.sparkSession.conf, df.sparkSession.sparkContext
    return df.repartition(max(int(conf.get("spark.sql.shuffle.partitions")), sc.defaultParallelism), *columns)
