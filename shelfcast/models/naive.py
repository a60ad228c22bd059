"""Seasonal naive forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _span_sum(days: int, first: int, last: int) -> tuple[Column, Column]:
    w = f"over (partition by series_id order by date range between {-first} preceding and {-last} preceding)"
    return F.expr(f"sum(observed_demand) {w}"), F.expr(f"count(observed_demand) {w}") == days


def seasonal_naive(panel: DataFrame, horizon: int = 7, period: int = 7, out: str = "naive") -> DataFrame:
    """Sum over the horizon of demand on the latest same-phase day before the origin.

    Step j looks back to one of the ``period`` days before the origin, and steps a whole
    period apart look at the same day. So the sum is so many full periods plus one partial
    span: two windows over calendar days, in the order of the other series windows, so that one sort serves all. Null when any day needed is missing.
    """
    full, part = divmod(horizon, period)
    total, ok = F.lit(0.0), F.lit(True)
    if full:
        s, have = _span_sum(period, -period, -1)
        total, ok = total + s * F.lit(float(full)), ok & have
    if part:
        s, have = _span_sum(part, -period, -period + part - 1)
        total, ok = total + s, ok & have
    return panel.withColumn(out, F.when(ok, F.greatest(total, F.lit(0.0))))
