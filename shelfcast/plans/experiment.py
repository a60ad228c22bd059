"""Walk-forward comparison of forecasters on observed and imputed demand."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.columns import quantile_columns
from ..models.teacher import train_teacher
from ..models.conformal import ConformalModel, Trainer, fit_and_calibrate, forest_trainer
from ..models.naive import seasonal_naive
from ..operators import quality
from ..operators.costs import series_cost_profile
from ..operators.drift import fold_drift_watch
from ..operators.features import supervised_frame
from ..operators.folds import HOLDOUT_FOLD_ID, Fold, distinct_dates, training_rows, walk_forward_folds
from ..operators.impute import Teacher, impute_latent
from ..operators.ledger import simulate_ledger
from ..operators.metrics import summarize_costs, summarize_predictions
from ..operators.orders import cost_sensitivity, inventory_costs, order_quantity
from ..operators.panel import union_all
from ..operators.regimes import label_all_regimes
from ..operators.report import exceptions, reorder_recommendations, seed_predictions
from ..session import materialise


@dataclass
class StrategyRun:
    predictions: DataFrame
    folds: list[Fold]
    models: dict[str, ConformalModel] = field(default_factory=dict)
    drift_folds: list[int] = field(default_factory=list)


def naive_predictions(rows: DataFrame, fold_id: int, strategy: str, settings: Settings,
                      profile: DataFrame | None) -> DataFrame:
    base = rows.select(*seed_predictions(rows).columns[:-1], F.col("target_lead_time_demand").alias("y_true"),
                       F.col("naive").alias("y_pred"))
    return _costed(base, "seasonal_naive", "heuristic", fold_id, strategy, settings, profile)


def model_predictions(rows: DataFrame, model: ConformalModel, fold_id: int, strategy: str, settings: Settings,
                      profile: DataFrame | None) -> DataFrame:
    """Point and quantile forecasts of a fold's rows with labels, orders and costs."""
    scored = model.predict(rows)
    keep = [*seed_predictions(rows).columns[:-1], "y_pred", *quantile_columns(scored)]
    base = scored.select(*keep, F.col("target_lead_time_demand").alias("y_true"))
    return _costed(base, model.model_name, model.backend_name, fold_id, strategy, settings, profile)


def _costed(df: DataFrame, model: str, backend: str, fold_id: int, strategy: str, settings: Settings,
            profile: DataFrame | None) -> DataFrame:
    df = df.withColumns({"model_name": F.lit(model), "backend_name": F.lit(backend),
                         "fold_id": F.lit(fold_id).cast("int"), "data_strategy": F.lit(strategy)})
    return inventory_costs(order_quantity(df, settings.inventory, profile), settings.inventory, profile)


def fold_rows(frame: DataFrame, fold: Fold) -> DataFrame:
    return frame.where(F.col("date").between(F.lit(fold.validation_start_date), F.lit(fold.validation_end_date)))


def run_strategy(panel: DataFrame, settings: Settings, strategy: str, learners: dict[str, Trainer],
                 holdout: DataFrame | None = None, check: bool = True) -> StrategyRun:
    """Naive and learnt forecasts of every fold, and of the holdout when there is one."""
    if check:
        quality.raise_on_blocking(quality.data_quality_report(panel, settings.quality, settings.run_mode))
    horizon, val = settings.dataset.horizon, settings.validation
    profile = series_cost_profile(panel, settings.inventory) if settings.inventory.use_series_costs else None
    base = seasonal_naive(label_all_regimes(panel), horizon, settings.models.seasonal_period)
    frame, names = supervised_frame(base, settings.features, horizon)
    frame = materialise(frame, "supervised")
    folds = walk_forward_folds(distinct_dates(panel), val, horizon)
    parts, models, drifted, force = [], {}, [], False
    first = next(iter(learners), None)
    for fold in folds:
        rows, train = fold_rows(frame, fold), training_rows(frame, fold)
        if train.isEmpty() or rows.isEmpty():
            continue
        parts.append(naive_predictions(rows, fold.fold_id, strategy, settings, profile))
        for name, trainer in learners.items():
            if name not in models or val.retrain_each_fold or force:
                models[name] = fit_and_calibrate(train, names, settings, trainer)
            parts.append(materialise(model_predictions(rows, models[name], fold.fold_id, strategy, settings, profile),
                                     "fold-predictions"))
        force = False
        if val.drift_triggered_retrain and first is not None:
            mine = union_all(*parts).where(F.col("model_name") == models[first].model_name)
            last = fold_drift_watch(summarize_predictions(mine), settings.drift).where(
                F.col("fold_id") == fold.fold_id).first()
            force = bool(last and last["is_drift"])
            if force:
                drifted.append(fold.fold_id)
    if holdout is not None:
        rows = _holdout_rows(panel, holdout, settings)
        parts.append(naive_predictions(rows, HOLDOUT_FOLD_ID, strategy, settings, profile))
        for name, trainer in learners.items():
            models[name] = fit_and_calibrate(frame, names, settings, trainer)
            parts.append(materialise(model_predictions(rows, models[name], HOLDOUT_FOLD_ID, strategy, settings,
                                                       profile), "holdout-predictions"))
    if not parts:
        raise ValueError("no fold produced predictions")
    return StrategyRun(union_all(*parts), folds, models, drifted)


def _holdout_rows(panel: DataFrame, holdout: DataFrame, settings: Settings) -> DataFrame:
    """Holdout rows whose lags and naive forecast reach back into the panel."""
    whole = seasonal_naive(label_all_regimes(union_all(panel, holdout)), settings.dataset.horizon,
                           settings.models.seasonal_period)
    frame, _ = supervised_frame(whole, settings.features, settings.dataset.horizon)
    out = materialise(frame.join(holdout.select("date").distinct(), "date", "left_semi"), "holdout")
    if out.isEmpty():
        raise ValueError("a holdout was given but no supervised row falls on its dates")
    return out


def run_experiment(panel: DataFrame, settings: Settings = Settings(), learners: dict[str, Trainer] | None = None,
                   holdout: DataFrame | None = None, teacher: Teacher | None = None) -> dict[str, DataFrame]:
    """Both demand strategies through the folds, one ledger over all of them, and the summaries."""
    learners = learners if learners is not None else {"forest": forest_trainer()}
    panel = materialise(panel, "panel")
    how = settings.preprocessing.imputation_strategy
    if how == "supervised" and teacher is None:
        teacher = train_teacher(panel, seed=settings.random_seed)
    seen = run_strategy(panel, settings, "Observed", learners, holdout)
    latent = run_strategy(materialise(impute_latent(panel, how, teacher), "latent-panel"), settings, f"Latent_{how}",
                          learners, None if holdout is None else impute_latent(holdout, how, teacher))
    validation = materialise(union_all(seen.predictions, latent.predictions), "validation-predictions")
    profile = series_cost_profile(panel, settings.inventory) if settings.inventory.use_series_costs else None
    decisions = materialise(simulate_ledger(validation, settings.inventory, profile), "decisions")
    drift = sorted({*seen.drift_folds, *latent.drift_folds})
    rec = reorder_recommendations(decisions, settings.business, drift)
    return {
        "validation_predictions": validation, "predictions": decisions,
        "metrics_summary": summarize_predictions(validation), "cost_summary": summarize_costs(decisions),
        "sensitivity_summary": cost_sensitivity(decisions, settings.inventory), "reorder_recommendations": rec,
        "exceptions": exceptions(rec)}
