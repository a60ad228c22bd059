"""Rolling-origin backtest of retraining cadences."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..models.conformal import Trainer
from ..operators import backtest as B
from ..operators.costs import series_cost_profile
from ..operators.features import feature_frame
from ..operators.folds import distinct_dates
from ..operators.panel import union_all
from ..operators.regimes import label_all_regimes, series_mean
from ..session import materialise
from .scoring import train_champion

HistoryTrainer = Callable[[DataFrame], B.Scorer]
EVENTS = "cadence string, day_index int, decision_date date, duration_seconds double, history_rows bigint"


def champion_trainer(settings: Settings, trainer: Trainer | None = None) -> HistoryTrainer:
    """The champion's own training, conformal calibration included, on the history of each version."""
    return lambda history: train_champion(history, settings, trainer).predict


@dataclass
class RollingRun:
    predictions_by_day: DataFrame
    retrain_events: DataFrame
    cadence_summary: DataFrame
    cadence_comparison: DataFrame


def run_rolling_origin(train: DataFrame, evaluation: DataFrame, settings: Settings, trainer: HistoryTrainer,
                       parallel: int = 4) -> RollingRun:
    """Score every evaluation day under every cadence.

    ``trainer`` gets the panel up to a date and returns a function that adds ``y_pred`` and
    quantiles. It runs for the start and for every scheduled retrain day; the days are known
    beforehand, so up to ``parallel`` of these fits are submitted side by side. Cadences share
    the features, the first model and any model trained on the same day. A trainer with a method
    ``fit_versions(panel, cutoffs)`` fits all versions itself (``cutoffs``: version to last day) and returns one
    scorer that tells them apart by ``model_version``; then the origins are read once. Regimes of an origin know its past only.
    """
    spark = train.sparkSession
    horizon, cadences = settings.dataset.horizon, settings.simulation.retrain_cadences
    dates = distinct_dates(evaluation)
    if settings.simulation.simulation_days is not None:
        dates = dates[:settings.simulation.simulation_days]
    if not dates:
        raise ValueError("the evaluation split has no usable dates")
    panel = materialise(union_all(train, evaluation), "rolling-panel")
    features, names = feature_frame(label_all_regimes(panel, mean=series_mean(so_far=True)), settings.features)
    origins = B.origin_rows(features, names, panel, dates, horizon).withColumn("day_index", B.day_index(dates))
    origins = materialise(origins.hint("rebalance", "day_index"), "origins", partition_by="day_index")

    retrained = {B.cadence_label(k): B.retrain_days(len(dates), k) for k in cadences}
    days = sorted({d for listed in retrained.values() for d in listed})
    last = dates[0] - timedelta(days=1)
    cutoffs = {-1: last, **{d: dates[d] for d in days}}

    def fit(version: int) -> tuple[B.Scorer, float]:
        t = time.perf_counter()
        history = train if version < 0 else panel.where(F.col("date") <= F.lit(cutoffs[version]))
        return trainer(history), round(time.perf_counter() - t, 3)

    if hasattr(trainer, "fit_versions"):
        t = time.perf_counter()
        scorer = trainer.fit_versions(panel, cutoffs)
        took = dict.fromkeys(cutoffs, round((time.perf_counter() - t) / len(cutoffs), 3))
    else:
        with ThreadPoolExecutor(parallel) as pool:
            fitted = dict(zip(cutoffs, pool.map(fit, cutoffs)))
        scorer, took = {v: f for v, (f, _) in fitted.items()}, {v: s for v, (_, s) in fitted.items()}
    sizes = {r["date"]: r["n"] for r in panel.groupBy("date").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per calendar day
    rows_until = {d: sum(n for day, n in sizes.items() if day is not None and day <= dates[d]) for d in days}
    events = [(label, d, dates[d], took[d], rows_until[d]) for label, listed in retrained.items() for d in listed]
    scored = B.score_versions(origins, B.serving_table(spark, len(dates), cadences), scorer)
    profile = series_cost_profile(train, settings.inventory) if settings.inventory.use_series_costs else None
    out = materialise(B.cost_origins(scored, evaluation, dates, horizon, settings.inventory, profile), "by-day")
    log = spark.createDataFrame(events, EVENTS)
    labels = [B.cadence_label(k) for k in cadences]
    return RollingRun(out, log, B.cadence_summary(out, log, horizon),
                      B.compare_cadences(out, horizon, labels, settings.random_seed))
