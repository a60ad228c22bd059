"""Input frames of the registered queries, all derived from the given tables."""

from __future__ import annotations

import statistics

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DatasetConfig, InventoryConfig, PreprocessingConfig, ValidationConfig
from ..functions.columns import floor0
from ..models.naive import seasonal_naive
from ..operators.features import lead_time_target, rolling_past
from ..operators.folds import assign_validation, walk_forward_folds, distinct_dates
from ..operators.impute import impute_latent
from ..operators.orders import inventory_costs, order_quantity
from ..operators.panel import STATIC_IDS, canonicalise, dealt_by_series, densify, fill_defaults, prepare_panel, series_key
from ..operators.regimes import label_all_regimes
from ..session import materialise
from ..sources.tables import FOLD_END, FOLD_START, raw_split

H = 7
Z90 = statistics.NormalDist().inv_cdf(0.9)
FOLDS = ValidationConfig()
ALL_SERIES = DatasetConfig(top_n_series=None)


def supplier_panel(spark: SparkSession, sf: str, dataset: DatasetConfig = ALL_SERIES) -> DataFrame:
    """Prepared panel with calendar gaps and filled weather."""
    return prepare_panel(raw_split(spark, sf), dataset, PreprocessingConfig())


def supplier_sales(spark: SparkSession, sf: str) -> DataFrame:
    """The same panel before any filling."""
    return series_key(canonicalise(raw_split(spark, sf)))


def daily_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Dense panel: every supplier on each of 180 days."""
    raw = fill_defaults(series_key(canonicalise(raw_split(spark, sf, folded=True))))
    cols = [*STATIC_IDS, "series_id", "date", "observed_demand", "stockout_hours", "discount", "holiday_flag",
            "activity_flag"]
    full = densify(raw.select(*cols), FOLD_START, FOLD_END, zero=("observed_demand", "stockout_hours", "activity_flag"),
                   carry=tuple(STATIC_IDS))
    return full.withColumns({"discount": F.coalesce("discount", F.lit(1.0)),
                             "holiday_flag": (F.weekday("date") >= 6).cast("double")})


def both_strategies(panel: DataFrame) -> DataFrame:
    """Observed and imputed demand as one frame keyed by ``data_strategy``; series ids stay apart."""
    seen = impute_latent(panel, "none").withColumn("data_strategy", F.lit("Observed"))
    latent = impute_latent(panel, "historical_mean").withColumn("data_strategy", F.lit("Latent_historical_mean"))
    return seen.unionByName(latent)


def origin_features(panel: DataFrame) -> DataFrame:
    """28-day mean and deviation, the target, and the seasonal naive forecast of one strategy's panel."""
    df = seasonal_naive(panel, H, 7)
    return df.withColumns({"m28": rolling_past("observed_demand", 28, F.avg),
                           "s28": rolling_past("observed_demand", 28, F.stddev_samp),
                           "target_lead_time_demand": lead_time_target("observed_demand", H)})


def two_models(df: DataFrame) -> DataFrame:
    """Each row once per model: the naive one without quantiles, the other with normal quantiles."""
    mean = F.col("m28") * F.lit(float(H))
    spread = F.col("s28") * F.lit(H ** 0.5 * Z90)
    none = F.lit(None).cast("double")
    model = F.explode(F.array(
        F.struct(F.lit("seasonal_naive").alias("model_name"), F.lit("heuristic").alias("backend_name"),
                 F.col("naive").alias("y_pred"), none.alias("q_0_1"), none.alias("q_0_5"), none.alias("q_0_9")),
        F.struct(F.lit("rolling_normal").alias("model_name"), F.lit("rolling").alias("backend_name"),
                 mean.alias("y_pred"), floor0(mean - spread).alias("q_0_1"), mean.alias("q_0_5"),
                 (mean + spread).alias("q_0_9"))))
    return df.withColumn("m", model).select("*", "m.*").drop("m", "m28", "s28", "naive")


def forecasts(spark: SparkSession, sf: str, labels: bool = False) -> DataFrame:
    """Forecasts of two models on two demand strategies at every validation origin."""
    panel = materialise(daily_panel(spark, sf), "daily-panel")
    folds = walk_forward_folds(distinct_dates(panel), FOLDS, H)
    panel = dealt_by_series(panel)
    out = None
    for strategy, imp in (("Observed", "none"), ("Latent_historical_mean", "historical_mean")):
        p = impute_latent(panel, imp)
        p = label_all_regimes(p) if labels else p
        rows = assign_validation(origin_features(p).where(F.col("target_lead_time_demand").isNotNull()), folds)
        rows = two_models(rows).withColumns({"data_strategy": F.lit(strategy),
                                             "y_true": F.col("target_lead_time_demand")})
        out = rows if out is None else out.unionByName(rows)
    return out


def costed_forecasts(spark: SparkSession, sf: str, labels: bool = False) -> DataFrame:
    cfg = InventoryConfig()
    return inventory_costs(order_quantity(forecasts(spark, sf, labels), cfg), cfg)


