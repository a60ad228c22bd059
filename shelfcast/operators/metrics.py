"""Forecast accuracy and cost summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c, pinball, quantile_columns, quantile_level, rate, sum0, winkler
from .folds import HOLDOUT_FOLD_ID
from .orders import served_units

GROUPS = ["data_strategy", "model_name", "backend_name"]


def exclude_holdout(df: DataFrame) -> DataFrame:
    return df.where(F.col("fold_id") != HOLDOUT_FOLD_ID) if "fold_id" in df.columns else df


def group_columns(df: DataFrame) -> list[str]:
    return [g for g in GROUPS if g in df.columns]


def interval_alpha(lo: str, hi: str) -> float:
    return quantile_level(lo) + (1.0 - quantile_level(hi))


def metric_aggregates(q_cols: list[str], y: str | Column = "y_true", p: str | Column = "y_pred") -> list[Column]:
    """Error, pinball and interval metrics as plain aggregates; interval ones are null without quantiles."""
    y, p = c(y), c(p)
    err = p - y
    out = [F.count(F.lit(1)).alias("observations"), F.avg(F.abs(err)).alias("mae"),
           F.sqrt(F.avg(err * err)).alias("rmse")]
    out += [F.avg(pinball(y, q, quantile_level(q))).alias(f"pinball_{q}") for q in q_cols]
    if len(q_cols) >= 2:
        lo, hi = F.col(q_cols[0]), F.col(q_cols[-1])
        known = (F.count(lo) > 0) & (F.count(hi) > 0)
        covered = rate((y >= lo) & (y <= hi))
        out += [F.when(known, covered).alias("interval_coverage"),
                F.avg(hi - lo).alias("interval_width"),
                F.avg(winkler(y, lo, hi, interval_alpha(q_cols[0], q_cols[-1]))).alias("winkler_score")]
    return out


def summarize_predictions(df: DataFrame) -> DataFrame:
    """Metrics per model over all folds (``fold_id`` null, holdout left out) and per fold (holdout kept).

    Each row feeds both levels, so one scan and one shuffle of partial sums serve the two tables.
    """
    f = F.col("fold_id").cast("int")
    levels = F.when(f != HOLDOUT_FOLD_ID, F.array(f, F.lit(None).cast("int"))).otherwise(F.array(f))
    fanned = df.withColumn("fold_id", F.explode(levels))
    return fanned.groupBy(*group_columns(df), "fold_id").agg(*metric_aggregates(quantile_columns(df)))


def summarize_costs(df: DataFrame) -> DataFrame:
    """Orders, unit and cost totals, service level and fill rate per model; cheapest first."""
    rows = exclude_holdout(df)
    aggs = [
        F.count(F.lit(1)).alias("observations"), F.avg("order_quantity").alias("mean_order_quantity"),
        sum0("overstock_units").alias("total_overstock_units"), sum0("stockout_units").alias("total_stockout_units"),
        sum0("overstock_cost").alias("total_overstock_cost"), sum0("stockout_cost").alias("total_stockout_cost"),
        sum0("total_cost").alias("total_cost"), F.avg("total_cost").alias("mean_cost"),
        rate(F.col("stockout_units") <= 0).alias("service_level"),
        sum0(served_units()).alias("__served"), sum0("y_true").alias("__demand")]
    if "sim_total_cost" in df.columns:
        aggs += [sum0("sim_total_cost").alias("sim_total_cost"), F.avg("sim_total_cost").alias("sim_mean_cost"),
                 rate(F.col("sim_backlog") <= 0).alias("sim_service_level")]
    s = rows.groupBy(*group_columns(df)).agg(*aggs)
    fill = F.when(F.col("__demand") > 0, F.col("__served") / F.col("__demand")).otherwise(F.lit(1.0))
    return s.withColumn("fill_rate", fill).drop("__served", "__demand").orderBy("total_cost")
