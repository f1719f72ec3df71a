"""Structured Streaming forms: resumable runs, gap sessions, deduplication and an append log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def resumable(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files: int = 100) -> StreamingQuery:
    """Run work over the files that have come since the last run; what is done is kept in the checkpoint."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(source)
    return work(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gap_windows(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key's events, closed by a gap; rows later than ``late`` are dropped, as a watermark does."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def without_repeats(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark's time."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def append_log(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append rows to a log of JSON lines."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
