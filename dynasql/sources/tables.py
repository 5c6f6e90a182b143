"""Parquet tables of a folder, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, where: str) -> Callable[[str], DataFrame]:
    """Finds tables as <where>/<name>.parquet, names in any case."""
    return lambda name: spark.read.parquet(f"{where}/{name.lower()}.parquet")


def write(df: DataFrame, path: str, *, sort_by: list[str] | None = None, partition_by: list[str] | None = None) -> None:
    """Write a table; sorting within files makes later filters skip row groups."""
    df = df.sortWithinPartitions(*sort_by) if sort_by else df
    out = df.write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
