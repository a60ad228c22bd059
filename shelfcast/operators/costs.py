"""Series cost profiles and their attachment to prediction rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import InventoryConfig
from ..functions.columns import rate, ratio, require_columns
from ..functions.ranks import percentile_ranks
from ..session import materialise

# Fixed values of the cost heuristic.
PERISHABILITY_WEIGHTS = (0.5, 0.3, 0.2)
SLOW_MOVING_WEIGHTS = (0.6, 0.4)
CRITICALITY_WEIGHTS = (0.7, 0.3)
PERISHABILITY_FACTOR = (0.8, 0.8)
SLOW_MOVING_FACTOR = (0.9, 0.5)
CRITICALITY_FACTOR = (0.9, 0.5)

# Means are rounded here before they are ranked, so that ties do not hang on the order of a sum.
RANK_DIGITS = 12

COST_COLUMNS = ["c_over", "c_under", "critical_fractile"]
SCORE_COLUMNS = ["synthetic_perishability_score", "service_criticality_score"]


def fractile(under: Column, over: Column) -> Column:
    return under / (under + over)


def series_cost_stats(panel: DataFrame) -> DataFrame:
    """Demand level, spread, intermittency and stock-out rate per series; category of its first day."""
    require_columns(panel, ["series_id", "date", "observed_demand", "stockout_hours", "third_category_id"], "panel")
    stats = panel.groupBy("series_id").agg(
        F.avg("observed_demand").alias("mean_observed_demand"),
        F.coalesce(F.stddev_samp("observed_demand"), F.lit(0.0)).alias("demand_std"),
        rate(F.col("observed_demand") == 0).alias("zero_demand_rate"),
        rate(F.col("stockout_hours") > 0).alias("stockout_day_rate"),
        F.min_by("third_category_id", "date").alias("third_category_id"))
    return stats.withColumn("coefficient_variation",
                            F.coalesce(ratio("demand_std", "mean_observed_demand"), F.lit(0.0)))


def category_cost_ranks(stats: DataFrame) -> DataFrame:
    cats = stats.where(F.col("third_category_id").isNotNull()).groupBy("third_category_id").agg(
        F.round(F.avg("zero_demand_rate"), RANK_DIGITS).alias("category_zero_demand_rate"),
        F.round(F.avg("coefficient_variation"), RANK_DIGITS).alias("category_cv"))
    return percentile_ranks(cats, {"category_zero_rank": "category_zero_demand_rate",
                                   "category_cv_rank": "category_cv"})


def series_cost_profile(panel: DataFrame, cfg: InventoryConfig = InventoryConfig()) -> DataFrame:
    """Synthetic over- and under-stock cost per series from percentile ranks."""
    ranked_columns = ["mean_observed_demand", "zero_demand_rate", "stockout_day_rate"]
    stats = materialise(series_cost_stats(panel).withColumns(
        {n: F.round(n, RANK_DIGITS) for n in ranked_columns}), "series-cost-stats")
    ranked = percentile_ranks(stats, {"demand_rank": "mean_observed_demand", "intermittency_rank": "zero_demand_rate",
                                      "stockout_rank": "stockout_day_rate"})
    ranked = ranked.join(category_cost_ranks(stats).select("third_category_id", "category_zero_rank",
                                                           "category_cv_rank"), "third_category_id", "left")
    (p0, p1, p2), (s0, s1), (k0, k1) = PERISHABILITY_WEIGHTS, SLOW_MOVING_WEIGHTS, CRITICALITY_WEIGHTS
    perish = (F.lit(p0) * F.col("category_zero_rank") + F.lit(p1) * F.col("category_cv_rank")
              + F.lit(p2) * F.col("intermittency_rank"))
    slow = F.lit(s0) * F.col("intermittency_rank") + F.lit(s1) * (1.0 - F.col("demand_rank"))
    crit = F.lit(k0) * F.col("demand_rank") + F.lit(k1) * F.col("stockout_rank")

    def factor(pair: tuple[float, float], score: Column) -> Column:
        return F.lit(pair[0]) + F.lit(pair[1]) * score

    over = F.lit(cfg.overstock_cost) * factor(PERISHABILITY_FACTOR, perish) * factor(SLOW_MOVING_FACTOR, slow)
    under = F.lit(cfg.stockout_cost) * factor(CRITICALITY_FACTOR, crit)
    return ranked.select("series_id", over.alias("c_over"), under.alias("c_under"),
                         fractile(under, over).alias("critical_fractile"),
                         perish.alias("synthetic_perishability_score"), crit.alias("service_criticality_score"))


def attach_series_costs(df: DataFrame, cfg: InventoryConfig = InventoryConfig(),
                        profile: DataFrame | None = None) -> DataFrame:
    """Cost columns on every row: constants, or the series profile.

    A series missing from the profile, or listed twice, fails the query when it runs.
    """
    if not cfg.use_series_costs:
        flat = df.drop(*COST_COLUMNS, *SCORE_COLUMNS)
        return flat.withColumns({"c_over": F.lit(cfg.overstock_cost), "c_under": F.lit(cfg.stockout_cost),
                                 "critical_fractile": F.lit(cfg.stockout_cost / (cfg.stockout_cost
                                                                                 + cfg.overstock_cost))})
    if all(n in df.columns for n in COST_COLUMNS):
        return df
    if profile is None:
        raise ValueError("series costs are enabled but no profile was given")
    require_columns(df, ["series_id"], "predictions")
    kept = [n for n in profile.columns if n != "series_id"]
    once = profile.groupBy("series_id").agg(F.count(F.lit(1)).alias("__n"), *[F.first(n).alias(n) for n in kept])
    joined = df.join(once, "series_id", "left")
    bad = F.col("__n").isNull() | (F.col("__n") > 1)
    for n in COST_COLUMNS:
        bad = bad | F.col(n).isNull()
    checked = {n: F.when(bad, F.raise_error(F.lit("cost profile is missing or repeats a series")).cast("double"))
               .otherwise(F.col(n)) for n in COST_COLUMNS}
    return joined.withColumns(checked).drop("__n")
