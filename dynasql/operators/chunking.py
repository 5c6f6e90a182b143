"""Documents cut into overlapping chunks, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import chunks


def chunk_text(df: DataFrame, size: int, overlap: int, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, index, start, end, text) for each window of each row's text."""
    return df.select(F.col(id), F.explode(chunks(F.col(text), size, overlap)).alias("c")).select(id, "c.*")
