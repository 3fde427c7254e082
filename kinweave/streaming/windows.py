"""Streaming counterparts of the window panels; an extension, the batch operators are the reference semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(stream: DataFrame, ts: str, key: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows per window and key; rows later than the watermark are dropped by the engine."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


def sliding_counts(stream: DataFrame, ts: str, key: str, width: str = "50 hours", stride: str = "10 hours", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width, stride), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


def sessions(stream: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), user, "n")


def file_stream(spark, path: str, schema, max_files: int = 100) -> DataFrame:
    """New parquet files as they come; the checkpoint of the query is the manifest (OP-015 as a stream)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def latest_per_key(batch: DataFrame, table: DataFrame, key: str, ts: str) -> DataFrame:
    """A table brought up to date by a micro-batch: the latest row of each key (for foreachBatch)."""
    both = table.unionByName(batch)
    return both.groupBy(key).agg(F.max_by(F.struct(*[c for c in table.columns if c != key]), F.col(ts)).alias("r")).select(key, "r.*")
