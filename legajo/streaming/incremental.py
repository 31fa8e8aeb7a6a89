"""Incremental processing of arriving rows: an extension, for streams of what the batch operators read.

Keys are kept for a bounded time, so that state does not grow with the stream; a batch is appended through the same anti-join
as in batch, so that a repeated micro-batch adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.sources.tables import append_new


def first_deliveries(stream: DataFrame, keys: list[str], time: str, delay: str = "90 days") -> DataFrame:
    """Rows of a stream whose keys did not arrive within ``delay`` before."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Rows of each window and group; late rows count until ``delay`` has passed."""
    grouped = stream.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("window.start").alias("start"), *by, "n")


def append_to(stream: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Write each micro-batch's new keys to a Parquet table; gives the started query."""

    def write(batch: DataFrame, _: int) -> None:
        append_new(batch, path, keys)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
