"""Rules over streams: scoring is a projection without state; counts by window have a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import first_match


def score_stream(stream: DataFrame, rules: DataFrame, default: float) -> DataFrame:
    """The stream with rule_id and predicted of the first matching rule."""
    return first_match(stream, rules, default)


def windowed_counts(stream: DataFrame, time: str, late: str = "10 minutes", width: str = "1 hour", by: tuple[str, ...] = ("predicted",)) -> DataFrame:
    """Rows per window and group; rows later than the watermark are dropped by the engine. Time stamps without zone are cast first."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width).alias("window"), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
