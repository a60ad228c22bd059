"""Newsvendor order quantities and their cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import InventoryConfig
from ..functions.columns import both, c, floor0, interpolate, quantile_columns, quantile_level, sum0
from .costs import attach_series_costs
from .folds import HOLDOUT_FOLD_ID

DEFAULT_RATIOS = (1.0, 2.0, 4.0, 8.0, 10.0)


def critical_fractile(cfg: InventoryConfig) -> float:
    return cfg.stockout_cost / (cfg.stockout_cost + cfg.overstock_cost)


def order_up_to(q_cols: Sequence[str], y_pred: str | Column = "y_pred",
                target: str | Column = "critical_fractile") -> Column:
    """Quantile function at the critical fractile; the point forecast where a row has no quantiles."""
    if not q_cols:
        return c(y_pred)
    return F.coalesce(interpolate([quantile_level(q) for q in q_cols], q_cols, c(target)), c(y_pred))


def order_quantity(df: DataFrame, cfg: InventoryConfig = InventoryConfig(), profile: DataFrame | None = None,
                   q_cols: Sequence[str] | None = None, stock: str | None = None,
                   on_order: str | None = None) -> DataFrame:
    """Order up to S, less the inventory position when one is given."""
    out = attach_series_costs(df, cfg, profile)
    cols = quantile_columns(df) if q_cols is None else list(q_cols)
    position = F.lit(0.0)
    for n in (stock, on_order):
        if n is not None:
            position = position + F.coalesce(F.col(n), F.lit(0.0))
    order = order_up_to(cols) - position
    return out.withColumn("order_quantity", floor0(order) if cfg.clip_negative_orders else order)


def inventory_costs(df: DataFrame, cfg: InventoryConfig = InventoryConfig(),
                    profile: DataFrame | None = None) -> DataFrame:
    """Left-over and missing units against ``y_true`` and what they cost; null when either side is unknown."""
    out = attach_series_costs(df, cfg, profile)
    gap = F.col("order_quantity") - F.col("y_true")
    over, under = floor0(gap), floor0(-gap)
    return out.withColumns({
        "overstock_units": over, "stockout_units": under,
        "overstock_cost": F.col("c_over") * over, "stockout_cost": F.col("c_under") * under,
        "total_cost": F.col("c_over") * over + F.col("c_under") * under})


def cost_sensitivity(df: DataFrame, cfg: InventoryConfig = InventoryConfig(),
                     ratios: Sequence[float] = DEFAULT_RATIOS, include_holdout: bool = False) -> DataFrame:
    """Orders and costs redone for each under/over cost ratio, summed per model and strategy.

    Each row fans out to the ratios in place, so all scenarios cost one scan and one aggregation.
    """
    rows = attach_series_costs(df, cfg) if not all(n in df.columns for n in ("c_over", "c_under")) else df
    if not include_holdout and "fold_id" in rows.columns:
        rows = rows.where(F.col("fold_id") != HOLDOUT_FOLD_ID)
    grid = rows.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    if cfg.use_series_costs:
        under = F.col("c_under") * (F.lit(cfg.overstock_cost) * F.col("ratio") / F.lit(cfg.stockout_cost))
        over = F.col("c_over")
    else:
        under, over = F.lit(cfg.overstock_cost) * F.col("ratio"), F.lit(cfg.overstock_cost)
    grid = grid.withColumns({"__u": under, "__o": over})
    s = order_up_to(quantile_columns(df), target=F.col("__u") / (F.col("__u") + F.col("__o")))
    has_q = F.lit(False)
    for q in quantile_columns(df):
        has_q = has_q | F.col(q).isNotNull()
    clipped = floor0(s) if cfg.clip_negative_orders else s
    order = F.when(has_q, clipped).otherwise(F.col("y_pred"))
    grid = grid.withColumn("__q", order)
    gap = F.col("__q") - F.col("y_true")
    keys = [k for k in ("model_name", "data_strategy") if k in df.columns]
    return grid.groupBy("ratio", *keys).agg(
        sum0(F.col("__o") * floor0(gap) + F.col("__u") * floor0(-gap)).alias("total_cost"),
        sum0(F.col("__o") * floor0(gap)).alias("overstock_cost"),
        sum0(F.col("__u") * floor0(-gap)).alias("stockout_cost"),
        F.avg("__q").alias("mean_order_quantity"))


def served_units(y: str = "y_true", q: str = "order_quantity") -> Column:
    return both(F.least, y, q)
