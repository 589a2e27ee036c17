"""Structured Streaming: pair features on a stream, and question frequencies in event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_features(stream: DataFrame, feature: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Row-wise families run on streams as they are."""
    return feature(stream)


def windowed_frequency(stream: DataFrame, time: str = "ts", every: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Occurrences of each question in tumbling windows; rows later than the watermark are left out."""
    rows = stream.withWatermark(time, late).select(time, F.explode(F.array("question1", "question2")).alias("question"))
    return rows.groupBy(F.window(time, every), "question").agg(F.count(F.lit(1)).alias("n"))


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that is available now, as a table; for tests and backfills."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
