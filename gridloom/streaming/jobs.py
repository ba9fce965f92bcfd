"""Structured Streaming: windows over events with late data, ingest of files, append-only logs, upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema: str, at: str = "ts", files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream; the event time becomes a timestamp with a zone, as watermarks need."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn(at, F.col(at).cast("timestamp"))


def tumbling(events: DataFrame, at: str, width: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and keys; events later than ``late`` are dropped by the watermark."""
    grouped = events.withWatermark(at, late).groupBy(F.window(at, width), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sliding(events: DataFrame, at: str, width: str, step: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark(at, late).groupBy(F.window(at, width, step), *keys)
    return grouped.agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Runs of events of the same keys with no pause of ``gap``."""
    grouped = events.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys)
    return grouped.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n")


def first_of_each(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Events without repeats of a key within the watermark: an ingest that may be retried."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs all that has arrived through ``write`` batch by batch, then stops; a rerun goes on where it ended."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_json(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def replace_by_key(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that puts the rows of each key in the place of what the key had: partitions are overwritten."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)

    return write


def file_arrivals(spark: SparkSession, folder: str, pattern: str = "*", below: bool = False) -> DataFrame:
    """New files of a folder (and of those ``below`` it) as rows with path, content and the key of the content.

    A path is read once: a file that changes must arrive under another path.
    """
    kind = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", pattern).option("recursiveFileLookup", below).load(folder)
    key: Column = F.left(F.sha2("content", 256), F.lit(16))
    return stream.withColumn("content_key", key)
