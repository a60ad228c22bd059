"""Supervised estimate of a full day's demand, learnt from days without stock-outs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.impute import Teacher, is_clean
from ..session import materialise
from .bins import UNSAMPLED

# Stock-out hours are left out: they are 0 on every training day and never 0 where the teacher is used.
COVARIATES = ["discount", "holiday_flag", "avg_temperature", "precpt", "avg_humidity", "avg_wind_level"]
SERIES_MEAN = "series_mean_demand"
DERIVED = ["month", "day_of_week", "day_of_month", SERIES_MEAN]


def input_names(panel: DataFrame) -> list[str]:
    return [*DERIVED, *[n for n in COVARIATES if n in panel.columns]]


def calendar_inputs(df: DataFrame) -> DataFrame:
    return df.withColumns({"month": F.month("date"), "day_of_week": F.weekday("date"), "day_of_month": F.dayofmonth("date")})


def assembled(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """The inputs as one vector ``__x``; missing values are 0."""
    out = df.withColumns({f"__i_{n}": F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in inputs})
    return VectorAssembler(inputCols=[f"__i_{n}" for n in inputs], outputCol="__x").transform(out)


def boosted(rows: DataFrame, iterations: int, depth: int, step: float, seed: int) -> GBTRegressionModel:
    """Boosted trees. Rows with a weight ``__w`` are cells of binned days (``bins.py``): every bin is a candidate, so no sample of the cells is taken."""
    trees = GBTRegressor(featuresCol="__x", labelCol="__y", predictionCol="teacher_prediction", maxIter=iterations,
                         maxDepth=depth, stepSize=step, seed=seed, subsamplingRate=1.0)
    return (trees.setWeightCol("__w").setMaxBins(UNSAMPLED) if "__w" in rows.columns else trees).fit(rows)


def train_teacher(panel: DataFrame, iterations: int = 20, depth: int = 5, step: float = 0.1,
                  seed: int = 42) -> Teacher:
    """Gradient-boosted trees on clean days. The series enters through its clean-day mean."""
    clean = panel.where(is_clean())
    means = materialise(clean.groupBy("series_id").agg(F.avg("observed_demand").alias(SERIES_MEAN)), "means")
    overall = clean.agg(F.avg("observed_demand")).first()[0]
    inputs = input_names(panel)

    def with_inputs(df: DataFrame) -> DataFrame:
        out = calendar_inputs(df.join(means, "series_id", "left"))
        return assembled(out.withColumn(SERIES_MEAN, F.coalesce(SERIES_MEAN, F.lit(overall))), inputs)

    rows = materialise(with_inputs(clean).select("__x", F.col("observed_demand").alias("__y")), "teacher-train")
    model = boosted(rows, iterations, depth, step, seed)

    def teach(df: DataFrame) -> DataFrame:
        return model.transform(with_inputs(df)).select(*df.columns, "teacher_prediction")

    return teach
