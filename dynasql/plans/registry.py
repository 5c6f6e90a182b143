"""All named queries of the engine (without the training-data operators)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import folder
from ..sql.engine import Engine
from . import api_queries, sql_queries


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark, folder(spark, sf_dir)).sql(text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(text) for name, (text, _) in sql_queries.QUERIES.items()} | {name: run for name, (run, _) in api_queries.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: check or text for name, (text, check) in sql_queries.QUERIES.items()} | {name: check for name, (_, check) in api_queries.QUERIES.items() if check}
