"""Event-time windows: the streaming form of lead-time sums and decision grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Timestamp with a watermark; a timestamp without zone is read as UTC first."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def lead_time_sums(df: DataFrame, time: str, keys: Sequence[str], value: str | Column, days: int) -> DataFrame:
    """Sum over [d, d + days) for every day d; in append mode a window appears once it is closed."""
    v = F.col(value) if isinstance(value, str) else value
    g = df.groupBy(F.window(time, f"{days} days", "1 day").alias("w"), *keys).agg(
        F.sum(v).alias("y_true"), F.count(v).alias("rows_observed"), F.collect_set(F.when(v.isNotNull(), F.to_date(time))).alias("days"))
    return g.select(*keys, F.to_date("w.start").alias("decision_date"), "y_true", "rows_observed", F.size("days").alias("days_observed"))


def decision_grid(df: DataFrame, time: str, keys: Sequence[str], value: str, days: int) -> DataFrame:
    """One window every ``days`` days, not overlapping."""
    g = df.groupBy(F.window(time, f"{days} days").alias("w"), *keys).agg(
        F.sum(value).alias("y_true"), F.count(value).alias("rows_observed"))
    return g.select(*keys, F.to_date("w.start").alias("decision_date"), "y_true", "rows_observed")


def mark_complete(windows: DataFrame, days_expected: int, seen: str = "days_observed") -> DataFrame:
    """``actuals_complete`` tells a fully observed window from one that is scored but not aggregated."""
    return windows.withColumn("actuals_complete", F.col(seen) >= days_expected)


def dedupe_stream(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key within the watermark."""
    return df.dropDuplicatesWithinWatermark(list(keys))
