"""Windows over events, for tables and for streams alike.

The reference has no streams; this is an extension. The same functions run over a table and over a stream, where a
watermark bounds the state, and the sink upserts what a trigger changed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.sinks import upsert_table


def windowed_counts(events: DataFrame, ts: str, length: str, keys: Sequence[str], value: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """start, end, keys, n, total, greatest per window. late: on a stream, how long a window waits for late events."""
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("greatest"))
    start = events.schema[ts].dataType.simpleString()
    return out.select(F.col("w.start").cast(start).alias("start"), F.col("w.end").cast(start).alias("end"), *keys, "n", "total", "greatest")


def session_lengths(events: DataFrame, ts: str, gap: str, keys: Sequence[str], late: str | None = None) -> DataFrame:
    """start, end, keys, n of each run of events without a silence of gap."""
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    kind = events.schema[ts].dataType.simpleString()
    return out.select(F.col("w.start").cast(kind).alias("start"), F.col("w.end").cast(kind).alias("end"), *keys, "n")


def read_events(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, with the schema of those there."""
    reader = spark.readStream.schema(spark.read.parquet(folder).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def keep_latest(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str):
    """Start a query that upserts every trigger's changed rows into a keyed table; the batch number is their version, so a
    batch that is run again after a failure changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            upsert_table(batch.sparkSession, path, batch.withColumn("batch", F.lit(number)), keys, "batch")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
