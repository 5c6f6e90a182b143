"""The corpus pipeline: documents through five stages, each one of the operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result to the shared folder, reads it back as the next stage's docs, and
deletes it when the next one is written. Part of the subpackage dynasql.llm.

Defined results, in every stage: no rows give no rows; extra columns are kept as
they are, whatever their names, up to the last stage. Quality rules: a null text
has no words and goes; repeated rows are judged each. Line dedup: a null text or
a null doc_id stays as it is; a text without a line left goes; rows that repeat
doc_id and text keep the same lines. Near dedup: rows without a doc_id stay; of
rows that repeat doc_id and text one stays. Mixing: a null source is a source of
its own; texts without a word are not taken. Packing: a null text is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dynasql.llm.base import cut, documents, drop, release
from dynasql.llm.op01_packing import pack
from dynasql.llm.op06_lines import drop_repeats
from dynasql.llm.op07_mixing import mix
from dynasql.llm.op09_simhash import keep_one
from dynasql.llm.op10_quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat or nearly repeat an earlier one."""
    return drop_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask."""
    return mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into token sequences."""
    return pack(docs, added=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Fingerprints, fuzzy lines and token ids have no SQL; tests/llm tests each stage's operator against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
            drop(before)
            release(spark)
    return docs
