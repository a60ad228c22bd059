"""Regime labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import scalar_quantiles


def label_stockout_regime(df: DataFrame, threshold: float | None = 1.0) -> DataFrame:
    """High when hours exceed the threshold; ``None`` means the table median."""
    if threshold is None:
        threshold = scalar_quantiles(df, "stockout_hours", [0.5])[0]
    high = F.col("stockout_hours") > F.lit(threshold)
    return df.withColumn("stockout_regime", F.when(high, "high_stockout").otherwise("low_stockout"))


def series_mean(column: str = "observed_demand", so_far: bool = False) -> Column:
    """Mean of a row's series; ``so_far`` leaves later rows out."""
    w = Window.partitionBy("series_id")
    return F.avg(column).over(w.orderBy("date").rowsBetween(Window.unboundedPreceding, 0) if so_far else w)


def label_velocity_regime(df: DataFrame, threshold: float = 1.0, mean: Column | None = None) -> DataFrame:
    """Fast from a mean demand of ``threshold`` on; the mean is the series' own unless one is given."""
    fast = (series_mean() if mean is None else mean) >= F.lit(threshold)
    return df.withColumn("velocity_regime", F.when(fast, "fast_moving").otherwise("slow_moving"))


def label_promo_regime(df: DataFrame, column: str = "discount", threshold: float = 0.0) -> DataFrame:
    """On promotion when ``discount`` exceeds the threshold; a missing discount counts as 0.

    With the default threshold a filled discount of 1.0 (none) also counts; pass a column of
    actual reductions, or another threshold, for a stricter reading.
    """
    on = F.coalesce(F.col(column), F.lit(0.0)) > F.lit(threshold)
    return df.withColumn("promo_regime", F.when(on, "on_promotion").otherwise("baseline_price"))


def label_season_regime(df: DataFrame, column: str = "holiday_flag") -> DataFrame:
    peak = F.coalesce(F.col(column).cast("double"), F.lit(0.0)) > 0
    return df.withColumn("seasonal_regime", F.when(peak, "peak_holiday").otherwise("standard_season"))


def label_all_regimes(df: DataFrame, velocity_threshold: float = 1.0,
                      stockout_threshold: float | None = 1.0, mean: Column | None = None) -> DataFrame:
    return (df.transform(label_stockout_regime, stockout_threshold)
            .transform(label_velocity_regime, velocity_threshold, mean)
            .transform(label_promo_regime).transform(label_season_regime))
