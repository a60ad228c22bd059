"""Quantile regression forest on Spark ML (Meinshausen 2006).

One random forest gives every quantile: each leaf keeps a small grid of quantiles of the
training targets that fall in it, and a row's forecast distribution is the mixture of its
leaves over the trees. The leaf table has at most trees x 2^depth rows whatever the data size,
and its grids are bounded sketches, so it travels with the plan as one scalar.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import quantile_column
from ..session import materialise
from ..sources.store import exists

GRID = 21
MODEL_NAME, BACKEND_NAME = "quantile_forest", "quantile_forest"


def numeric_inputs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in features})


@dataclass
class QuantileForest:
    pipeline: PipelineModel
    leaves: DataFrame
    trees: int
    width: int
    features: list[str]
    quantiles: tuple[float, ...]
    point_level: float
    model_name: str = MODEL_NAME
    backend_name: str = BACKEND_NAME

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``y_pred`` (the quantile at the critical fractile) and one column per quantile."""
        table = (self.leaves.agg(F.array_sort(F.collect_list(F.struct("slot", "grid"))).alias("t"))
                 .select(F.transform("t", lambda s: s["grid"])).scalar())
        scored = self.pipeline.transform(numeric_inputs(df, self.features)).withColumn("__table", table)
        w = self.width
        mix = F.flatten(F.transform(vector_to_array("__leaf"),
                                    lambda leaf, i: F.get(F.col("__table"), (i * w + leaf).cast("int"))))
        scored = scored.withColumn("__mix", F.array_sort(F.filter(mix, lambda v: v.isNotNull())))

        def at(level: float) -> Column:
            pos = F.lit(level) * (F.size("__mix") - 1)
            lo, hi = F.floor(pos).cast("int"), F.ceil(pos).cast("int")
            a, b = F.get(F.col("__mix"), lo), F.get(F.col("__mix"), hi)
            return F.greatest(a + (pos - lo) * (b - a), F.lit(0.0))

        out = {quantile_column(q): at(q) for q in self.quantiles}
        out["y_pred"] = at(self.point_level)
        keep = [n for n in df.columns if n not in out]
        return scored.withColumns(out).select(*[df_col(n) for n in keep], *out)

    def importance(self, spark: SparkSession) -> DataFrame:
        """Share of split gain per feature."""
        shares = self.pipeline.stages[-1].featureImportances.toArray()
        return spark.createDataFrame([(n, float(v)) for n, v in zip(self.features, shares)],
                                     "feature string, importance double")

    def save(self, path: str) -> None:
        spark = self.leaves.sparkSession
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        self.leaves.write.mode("overwrite").parquet(f"{path}/leaves")
        spark.createDataFrame([(self.trees, self.width, list(self.features), list(self.quantiles), self.point_level)],
                              "trees int, width int, features array<string>, quantiles array<double>, point double"
                              ).coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "QuantileForest":
        if not exists(spark, f"{path}/meta"):
            raise FileNotFoundError(f"no saved model at {path}")
        m = spark.read.schema("trees int, width int, features array<string>, quantiles array<double>, point double"
                              ).json(f"{path}/meta").first()
        return cls(PipelineModel.load(f"{path}/pipeline"), spark.read.parquet(f"{path}/leaves"), m["trees"],
                   m["width"], list(m["features"]), tuple(m["quantiles"]), m["point"])


def df_col(name: str) -> Column:
    return F.col(f"`{name}`")


def train_forest(frame: DataFrame, features: Sequence[str], target: str = "target_lead_time_demand",
                 quantiles: Sequence[float] = (0.1, 0.5, 0.9), point_level: float = 0.8, trees: int = 20,
                 depth: int = 6, seed: int = 42) -> QuantileForest:
    features = list(features)
    rows = numeric_inputs(frame, features).select(*features, F.col(target).cast("double").alias("__y"))
    rows = materialise(rows, "forest-train")
    assembler = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep")
    forest = RandomForestRegressor(featuresCol="__x", labelCol="__y", predictionCol="__mean", leafCol="__leaf",
                                   numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=1.0)
    model = forest.fit(assembler.transform(rows))
    pipeline = PipelineModel([assembler, model])
    width = 2 ** depth
    levels = F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)])
    placed = pipeline.transform(rows).select("__y", F.posexplode(vector_to_array("__leaf")).alias("t", "l"))
    leaves = placed.groupBy((F.col("t") * width + F.col("l")).cast("int").alias("slot")).agg(
        F.percentile_approx("__y", levels, F.lit(2000)).alias("grid"))
    spark = frame.sparkSession
    dense = spark.range(trees * width).select(F.col("id").cast("int").alias("slot")).join(leaves, "slot", "left")
    return QuantileForest(pipeline, materialise(dense, "forest-leaves"), trees, width, features, tuple(quantiles),
                          point_level)
