"""Training, persisting and applying the champion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.columns import quantile_column
from ..models.conformal import ConformalModel, Trainer, fit_and_calibrate, forest_trainer
from ..operators import quality
from ..operators.costs import series_cost_profile
from ..operators.features import inference_with_fallback, supervised_frame
from ..operators.orders import inventory_costs, order_quantity
from ..operators.regimes import label_all_regimes
from ..operators.report import exceptions, reorder_recommendations
from ..session import materialise


def train_champion(panel: DataFrame, settings: Settings = Settings(), trainer: Trainer | None = None) -> ConformalModel:
    """Fit the champion on the whole panel, with the last days kept for calibration."""
    frame, names = supervised_frame(label_all_regimes(panel), settings.features, settings.dataset.horizon)
    return fit_and_calibrate(materialise(frame, "champion-train"), names, settings, trainer or forest_trainer())


def retrain(panel: DataFrame, path: str, settings: Settings = Settings(), trainer: Trainer | None = None) -> str:
    quality.raise_on_blocking(quality.data_quality_report(panel, settings.quality, "retrain"))
    train_champion(panel, settings, trainer).save(path)
    return path


def score_rows(rows: DataFrame, model: ConformalModel, settings: Settings = Settings(),
               profile: DataFrame | None = None) -> DataFrame:
    """Model forecasts where features are complete, fallback means elsewhere, then orders.

    A fallback row has no quantiles and orders its point forecast.
    """
    by_model = F.col("prediction_source") == "model"
    q = [quantile_column(x) for x in settings.models.quantiles]
    scored = model.predict(rows)
    out = scored.withColumns({
        "y_pred": F.when(by_model, F.col("y_pred")).otherwise(F.col("fallback_target_lead_time_demand")),
        **{n: F.when(by_model, F.col(n)) for n in q}, "y_true": F.lit(None).cast("double"),
        "model_name": F.lit(model.model_name), "backend_name": F.lit(model.backend_name),
        "fold_id": F.lit(0), "data_strategy": F.lit("Observed")})
    return inventory_costs(order_quantity(out, settings.inventory, profile, q), settings.inventory, profile)


def score_latest(panel: DataFrame, model: ConformalModel, settings: Settings = Settings(),
                 check: bool = True) -> dict[str, DataFrame]:
    """One forecast, order and recommendation per series from its newest row."""
    if check:
        quality.raise_on_blocking(quality.data_quality_report(panel, settings.quality, "score_daily"))
    labelled = label_all_regimes(panel)
    profile = series_cost_profile(panel, settings.inventory) if settings.inventory.use_series_costs else None
    rows, _ = inference_with_fallback(labelled, settings.features, settings.dataset.horizon)
    predictions = materialise(score_rows(rows, model, settings, profile), "scores")
    rec = reorder_recommendations(predictions, settings.business)
    return {"predictions": predictions, "reorder_recommendations": rec, "exceptions": exceptions(rec)}


def run_metadata(rec: DataFrame, exc: DataFrame, settings: Settings, registry: DataFrame | None = None,
                 decision: DataFrame | None = None) -> DataFrame:
    """Counts of recommendations and exceptions with champion and promotion outcome, as one row."""
    champ = None if registry is None else registry.orderBy(F.desc("promoted_at")).first()
    promo = None if decision is None else decision.first()
    return rec.agg(F.count(F.lit(1)).alias("recommendation_rows")).withColumns({
        "exception_rows": exc.agg(F.count(F.lit(1))).scalar(), "run_name": F.lit(settings.run_name),
        "run_mode": F.lit(settings.run_mode),
        "champion_model_name": F.lit(champ["model_name"] if champ else None).cast("string"),
        "champion_backend_name": F.lit(champ["backend_name"] if champ else None).cast("string"),
        "promotion_executed": F.lit(promo is not None),
        "promotion_approved": F.lit(bool(promo["promote"]) if promo else None).cast("boolean")})


def load_champion(spark: SparkSession, path: str) -> ConformalModel:
    return ConformalModel.load(spark, path)
