"""Parameters of every operator, as frozen dataclasses."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

IMPUTATION_STRATEGIES = ("supervised", "historical_mean", "clipped_scaling", "none")


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class DatasetConfig:
    top_n_series: int | None = None
    min_history_days: int = 70
    max_rows: int | None = None
    horizon: int = 7

    def __post_init__(self):
        _check(self.horizon > 0, "horizon must be positive")
        _check(self.min_history_days >= self.horizon, "min_history_days must be at least horizon")
        _check(self.top_n_series is None or self.top_n_series > 0, "top_n_series must be positive")
        _check(self.max_rows is None or self.max_rows > 0, "max_rows must be positive")


@dataclass(frozen=True)
class PreprocessingConfig:
    drop_negative_sales: bool = True
    fill_missing_values: bool = True
    imputation_strategy: str = "supervised"

    def __post_init__(self):
        _check(self.imputation_strategy in IMPUTATION_STRATEGIES, "unknown imputation strategy")


@dataclass(frozen=True)
class FeatureConfig:
    lags: tuple[int, ...] = (1, 7, 14, 28)
    rolling_windows: tuple[int, ...] = (7, 28)
    include_static_ids: bool = True
    include_weather_lags: bool = True
    include_discount_lags: bool = True
    include_stockout_lags: bool = True

    def __post_init__(self):
        _check(bool(self.lags) and bool(self.rolling_windows), "lags and rolling_windows need a value")


@dataclass(frozen=True)
class ValidationConfig:
    initial_train_days: int = 56
    n_folds: int = 3
    fold_size_days: int = 7
    calibration_days: int = 21
    retrain_each_fold: bool = True
    drift_triggered_retrain: bool = False


@dataclass(frozen=True)
class DriftConfig:
    threshold: float = 15.0
    delta: float = 0.005
    min_instances: int = 2


@dataclass(frozen=True)
class QualityConfig:
    max_missing_fraction_warning: float = 0.05
    max_data_age_days: int | None = None


@dataclass(frozen=True)
class ModelConfig:
    quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)
    seasonal_period: int = 7
    n_estimators: int = 200
    learning_rate: float = 0.05
    max_depth: int = 6
    patience: int | None = 20
    use_tuning: bool = True
    tuning_trials: int = 20

    def __post_init__(self):
        q = list(self.quantiles)
        _check(all(0.0 < v < 1.0 for v in q), "quantiles must be strictly between 0 and 1")
        _check(q == sorted(set(q)) and bool(q), "quantiles must be unique and ascending")


@dataclass(frozen=True)
class InventoryConfig:
    overstock_cost: float = 1.0
    stockout_cost: float = 4.0
    use_series_costs: bool = False
    clip_negative_orders: bool = True
    global_capacity_units: float | None = None

    def __post_init__(self):
        _check(self.overstock_cost > 0 and self.stockout_cost > 0, "costs must be positive")


# What the series report assumes where nothing is set.
REPORT_COSTS = InventoryConfig(overstock_cost=4.0, stockout_cost=18.0, global_capacity_units=12_000.0)
REPORT_COVERAGE = 0.95


@dataclass(frozen=True)
class BusinessConfig:
    flag_cold_start: bool = True
    flag_drift_watch: bool = True
    flag_high_uncertainty: bool = True
    high_uncertainty_interval_quantile: float = 0.95
    flag_extreme_order_quantity: bool = True
    extreme_order_quantity_quantile: float = 0.99
    champion_data_strategy: str | None = "Observed"
    champion_model_name: str = "quantile_forest"
    champion_backend_name: str = "conformal_quantile_forest"
    champion_min_cost_improvement_pct: float = 0.0
    champion_max_service_level_degradation: float = 0.02


@dataclass(frozen=True)
class SimulationConfig:
    retrain_cadences: tuple[int | None, ...] = (None, 7, 1)
    simulation_days: int | None = None

    def __post_init__(self):
        c = self.retrain_cadences
        _check(bool(c) and len(set(c)) == len(c), "retrain_cadences must be unique")
        _check(all(v is None or v > 0 for v in c), "retrain_cadences must be positive or None")


@dataclass(frozen=True)
class Settings:
    random_seed: int = 42
    run_mode: str = "experiment"
    run_name: str = "run"
    dataset: DatasetConfig = field(default_factory=DatasetConfig)
    preprocessing: PreprocessingConfig = field(default_factory=PreprocessingConfig)
    features: FeatureConfig = field(default_factory=FeatureConfig)
    validation: ValidationConfig = field(default_factory=ValidationConfig)
    drift: DriftConfig = field(default_factory=DriftConfig)
    quality: QualityConfig = field(default_factory=QualityConfig)
    models: ModelConfig = field(default_factory=ModelConfig)
    inventory: InventoryConfig = field(default_factory=InventoryConfig)
    business: BusinessConfig = field(default_factory=BusinessConfig)
    simulation: SimulationConfig = field(default_factory=SimulationConfig)

    def __post_init__(self):
        _check(
            self.validation.initial_train_days >= self.dataset.horizon,
            "initial_train_days must be at least horizon",
        )


def fingerprint(*parts: object, length: int = 12) -> str:
    """Stable short digest of config parts, used to name materialised tables."""
    body = json.dumps([asdict(p) if hasattr(p, "__dataclass_fields__") else p for p in parts],
                      sort_keys=True, default=str)
    return hashlib.sha256(body.encode()).hexdigest()[:length]
