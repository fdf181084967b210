"""Incremental refresh: micro-batches by logical time, and a stream that keeps an aggregate fresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gristmill.sources.tables import write


def refresh(read: Callable[[], DataFrame], build: Callable[[DataFrame], DataFrame], target: str, period: str, logical_time: str, periods: int = 1) -> DataFrame:
    """Rebuilds the last ``periods`` days up to a logical time and replaces just their partitions.

    Late rows are taken in by a look-back of more than one period.
    """
    day = F.to_date(F.lit(logical_time))
    rows = read().where(F.col(period).between(F.date_sub(day, periods - 1), day))
    return write(build(rows), target, "incremental_time", [period])


def windowed(events: DataFrame, time: str, width: str, late: str, keys: list[str], aggregates: list) -> DataFrame:
    """Tumbling windows with a watermark; works for streams and tables alike."""
    df = events.withWatermark(time, late) if events.isStreaming else events
    return df.groupBy(F.window(time, width).alias("window"), *keys).agg(*aggregates).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "*").drop("window")


def upsert_stream(stream: DataFrame, target: str, checkpoint: str, partition_by: list[str]) -> StreamingQuery:
    """Writes each micro-batch's partitions over those of the target."""
    return stream.writeStream.foreachBatch(lambda df, _: write(df, target, "incremental_time", partition_by) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
