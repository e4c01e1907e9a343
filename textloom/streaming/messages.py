"""The column functions on streams: nothing here keeps state but the windowed counts, which a watermark bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import preprocess


def preprocessed(messages: DataFrame, text: str = "text") -> DataFrame:
    """A stream (or table) of messages with the columns of the preprocessing chain."""
    return preprocess(messages, text)


def windowed_counts(events: DataFrame, time: str = "ts", by: str = "event_type", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, by, n) per tumbling window; on a stream rows later than `late` are dropped and closed windows leave the state."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def deduplicated(events: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """First delivery of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
