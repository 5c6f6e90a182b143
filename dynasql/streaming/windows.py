"""Event-time windows that run the same on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, length: str = "1 day", *, late: str = "2 days", ts: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """(window_start, by, n, total) for each window; on a stream, rows later than `late` are left out."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if events.isStreaming else rows
    out = rows.groupBy(F.window(ts, length).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "total")


def stream_table(spark, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream: each file is read once."""
    return spark.readStream.schema(schema).parquet(path)


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to a table, exactly once, until the input is used up."""
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
