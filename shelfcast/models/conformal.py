"""A forecaster with its conformal radius table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators.conformal import apply_radius, attach_radius, calibrate
from ..operators.folds import calibration_split
from ..operators.orders import critical_fractile
from ..session import materialise
from ..sources.store import exists
from .boost import QuantileBoost, train_boost
from .forest import QuantileForest, train_forest

GROUP = "third_category_id"
Trainer = Callable[[DataFrame, Sequence[str], Settings], object]


def forest_trainer(trees: int | None = None, depth: int | None = None) -> Trainer:
    def train(frame: DataFrame, features: Sequence[str], s: Settings) -> QuantileForest:
        return train_forest(frame, features, quantiles=s.models.quantiles,
                            point_level=critical_fractile(s.inventory), trees=trees or s.models.n_estimators,
                            depth=depth or s.models.max_depth, seed=s.random_seed)
    return train


def boost_trainer(stages: int | None = None, depth: int | None = None, rate: float | None = None, state: str | None = None) -> Trainer:
    """Heads stop early by the settings' patience, unless they have no more stages than that. ``state`` is for a single fit."""
    def train(frame: DataFrame, features: Sequence[str], s: Settings) -> QuantileBoost:
        n, patience = stages or s.models.n_estimators, s.models.patience
        return train_boost(frame, features, quantiles=s.models.quantiles, point_level=critical_fractile(s.inventory),
                           stages=n, depth=depth or s.models.max_depth, rate=rate or s.models.learning_rate, seed=s.random_seed,
                           patience=patience if patience and n > patience else None, state=state)
    return train


@dataclass
class ConformalModel:
    base: object
    radius: DataFrame | None
    alpha: float

    @property
    def model_name(self) -> str:
        return self.base.model_name

    @property
    def backend_name(self) -> str:
        return f"conformal_{self.base.backend_name}"

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.base.predict(df)
        if self.radius is None:
            return out
        group = GROUP if GROUP in df.columns and GROUP in self.radius.columns else None
        return apply_radius(attach_radius(out, self.radius, group=group), self.alpha).drop("q_hat")

    def save(self, path: str) -> None:
        self.base.save(f"{path}/base")
        if self.radius is not None:
            self.radius.write.mode("overwrite").parquet(f"{path}/radius")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.base.model_name, self.alpha)], "kind string, alpha double").coalesce(
            1).write.mode("overwrite").json(f"{path}/conformal")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ConformalModel":
        if not exists(spark, f"{path}/conformal"):
            raise FileNotFoundError(f"no saved model at {path}; train one first")
        m = spark.read.schema("kind string, alpha double").json(f"{path}/conformal").first()
        kind = {"quantile_forest": QuantileForest, "quantile_boost": QuantileBoost}[m["kind"]]
        radius = spark.read.parquet(f"{path}/radius") if exists(spark, f"{path}/radius") else None
        return cls(kind.load(spark, f"{path}/base"), radius, m["alpha"])


def fit_and_calibrate(frame: DataFrame, features: Sequence[str], settings: Settings, trainer: Trainer) -> ConformalModel:
    """Fit on all but the last days, leave a gap of one horizon, calibrate on the last days by category."""
    alpha = 2 * settings.models.quantiles[0]
    sub, calib = calibration_split(frame, settings.validation.calibration_days, settings.dataset.horizon)
    base = trainer(sub, features, settings)
    if calib is None:
        return ConformalModel(base, None, alpha)
    scored = base.predict(calib).withColumn("y_true", F.col("target_lead_time_demand"))
    keep = [n for n in scored.columns if n.startswith("q_") or n in ("y_true", "y_pred", GROUP)]
    scored = materialise(scored.select(*keep), "calibration")
    return ConformalModel(base, materialise(calibrate(scored, alpha), "radius"), alpha)
