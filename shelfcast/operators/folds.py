"""Walk-forward folds and temporal splits. Dates are few, so they are settled on the driver."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ValidationConfig

HOLDOUT_FOLD_ID = 999


@dataclass(frozen=True)
class Fold:
    """Validation days [start, end]; training stops one horizon before the start."""

    fold_id: int
    horizon: int
    train_end_date: date
    validation_start_date: date
    validation_end_date: date

    def __post_init__(self):
        gap = (self.validation_start_date - self.train_end_date).days
        if gap != self.horizon or self.validation_end_date < self.validation_start_date:
            raise ValueError(f"fold {self.fold_id}: a gap of {gap} days for a horizon of {self.horizon}, "
                             f"validation {self.validation_start_date} to {self.validation_end_date}")


def distinct_dates(panel: DataFrame, column: str = "date") -> list[date]:
    """Sorted distinct days: as many rows as the calendar has."""
    return sorted(r[0] for r in panel.select(column).where(F.col(column).isNotNull()).distinct().collect())


def walk_forward_folds(dates: list[date], cfg: ValidationConfig = ValidationConfig(), horizon: int = 7) -> list[Fold]:
    """Validation blocks of equal size, end to end from the first day after the initial ones. A block counts if its last
    day's whole horizon is on the calendar, so the calendar fits (days - horizon + 1 - initial) / size of them."""
    size, start = cfg.fold_size_days, cfg.initial_train_days
    wanted = start + cfg.n_folds * size + horizon - 1
    if wanted > len(dates):
        raise ValueError(f"walk-forward folds need at least {wanted} dates, found {len(dates)}")
    fit = min(cfg.n_folds, (len(dates) - horizon + 1 - start) // size)
    if fit < 1:
        raise ValueError("the configuration allows no fold")
    blocks = [dates[start + k * size:start + (k + 1) * size] for k in range(fit)]
    return [Fold(k, horizon, days[0] - timedelta(horizon), days[0], days[-1]) for k, days in enumerate(blocks)]


def folds_frame(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    return spark.createDataFrame(
        [(f.fold_id, f.horizon, f.train_end_date, f.validation_start_date, f.validation_end_date) for f in folds],
        "fold_id int, horizon int, train_end_date date, validation_start_date date, validation_end_date date")


def assign_validation(frame: DataFrame, folds: list[Fold]) -> DataFrame:
    """Rows of the frame in some fold's validation window, with ``fold_id``. One scan, no join."""
    spans = F.array(*[F.struct(F.lit(f.fold_id).alias("fold_id"), F.lit(f.validation_start_date).alias("a"),
                               F.lit(f.validation_end_date).alias("b")) for f in folds])
    own = F.filter(spans, lambda s: (F.col("date") >= s["a"]) & (F.col("date") <= s["b"]))
    return frame.withColumn("__f", F.explode(own)).withColumn("fold_id", F.col("__f.fold_id")).drop("__f")


def training_rows(frame: DataFrame, fold: Fold) -> DataFrame:
    return frame.where(F.col("date") <= F.lit(fold.train_end_date))


def fold_counts(frame: DataFrame, folds: list[Fold]) -> DataFrame:
    """Rows and series in each fold's train and validation part, all folds in one aggregation."""
    aggs = []
    for f in folds:
        tr = F.col("date") <= F.lit(f.train_end_date)
        va = F.col("date").between(F.lit(f.validation_start_date), F.lit(f.validation_end_date))
        i = f.fold_id
        aggs += [F.sum(tr.cast("bigint")).alias(f"t{i}"), F.sum(va.cast("bigint")).alias(f"v{i}")]
    per = frame.groupBy("series_id").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f.fold_id).alias("fold_id"), F.col(f"t{f.fold_id}").alias("t"),
                              F.col(f"v{f.fold_id}").alias("v")) for f in folds])
    return (per.select(F.explode(rows).alias("r")).groupBy(F.col("r.fold_id").alias("fold_id"))
            .agg(F.sum("r.t").alias("train_rows"), F.sum("r.v").alias("validation_rows"),
                 F.count_if(F.col("r.t") > 0).alias("train_series"),
                 F.count_if(F.col("r.v") > 0).alias("validation_series")))


def temporal_masks(panel: DataFrame, fraction: float = 1.0 / 3.0, out: str = "is_validation") -> DataFrame:
    """Mark the rows of the last ``fraction`` of the calendar, at least one day and never all of it; nothing is removed."""
    *earlier, last = distinct_dates(panel) or [None]
    if not earlier:
        raise ValueError("a temporal split needs at least two distinct dates")
    held = sorted((1, round((len(earlier) + 1) * fraction), len(earlier)))[1]
    return panel.withColumn(out, F.col("date") >= F.lit([*earlier, last][-held]))


def calibration_split(frame: DataFrame, calibration_days: int = 21,
                      horizon: int = 7) -> tuple[DataFrame, DataFrame | None]:
    """The last days for calibration, an embargo of one horizon, the rest for training.

    When nothing would be left to train on, everything trains and nothing calibrates.
    """
    row = frame.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    if row["b"] is None:
        return frame, None
    cut = row["b"] - timedelta(days=calibration_days)
    last_train = cut - timedelta(days=horizon)
    if row["a"] > last_train:
        return frame, None
    return frame.where(F.col("date") <= F.lit(last_train)), frame.where(F.col("date") > F.lit(cut))


def run_description(panel: DataFrame) -> DataFrame:
    """Rows, series, dates and span of a panel."""
    return panel.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("series_id").alias("series"),
                     F.count_distinct("date").alias("unique_dates"), F.min("date").alias("date_min"),
                     F.max("date").alias("date_max"))
