"""Quantile boosting on Spark ML decision trees (Friedman 2001).

Each stage fits a tree to the sign gradient of the pinball loss and then sets every leaf to
the quantile of the residuals in it. Trees, leaf values and the start value are all that is
kept. Leaf quantiles come from mergeable sketches, so no leaf's rows are gathered anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import fingerprint
from ..functions.columns import pinball, quantile_column
from ..operators.conformal import monotone_quantiles
from ..session import materialise
from ..sources.store import exists
from .forest import numeric_inputs

MODEL_NAME, BACKEND_NAME = "quantile_boost", "quantile_boost"
ACCURACY = 2000


@dataclass
class Head:
    """Additive model of one quantile level."""

    level: float
    start: float
    trees: list[DecisionTreeRegressionModel] = field(default_factory=list)
    steps: list[list[float]] = field(default_factory=list)


@dataclass
class QuantileBoost:
    heads: list[Head]
    features: list[str]
    quantiles: tuple[float, ...]
    point_level: float
    model_name: str = MODEL_NAME
    backend_name: str = BACKEND_NAME

    def predict(self, df: DataFrame) -> DataFrame:
        keep = list(df.columns)
        out = assemble(df, self.features)
        for i, head in enumerate(self.heads):
            total = F.lit(head.start)
            for j, (tree, steps) in enumerate(zip(head.trees, head.steps)):
                leaf = f"__leaf_{i}_{j}"
                tree.setLeafCol(leaf).setPredictionCol(f"__g_{i}_{j}")
                out = tree.transform(out)
                total = total + F.get(F.array(*[F.lit(v) for v in steps]), F.col(leaf).cast("int"))
            out = out.withColumn(f"__f{i}", F.greatest(total, F.lit(0.0)))
        names = {h.level: f"__f{i}" for i, h in enumerate(self.heads)}
        new = {quantile_column(q): F.col(names[q]) for q in self.quantiles}
        new["y_pred"] = F.col(names[self.point_level])
        out = out.withColumns(new).select(*[n for n in keep if n not in new], *new)
        return monotone_quantiles(out, [quantile_column(q) for q in self.quantiles])

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        rows = []
        for i, h in enumerate(self.heads):
            for j, (tree, steps) in enumerate(zip(h.trees, h.steps)):
                tree.write().overwrite().save(f"{path}/trees/{i}_{j}")
                rows.append((i, h.level, h.start, j, steps))
        spark.createDataFrame(rows, "head int, level double, start double, stage int, steps array<double>").coalesce(
            1).write.mode("overwrite").parquet(f"{path}/steps")
        spark.createDataFrame([(list(self.features), list(self.quantiles), self.point_level)],
                              "features array<string>, quantiles array<double>, point double").coalesce(
            1).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "QuantileBoost":
        if not exists(spark, f"{path}/meta"):
            raise FileNotFoundError(f"no saved model at {path}")
        m = spark.read.schema("features array<string>, quantiles array<double>, point double").json(f"{path}/meta").first()
        heads: dict[int, Head] = {}
        for r in spark.read.parquet(f"{path}/steps").orderBy("head", "stage").collect():
            h = heads.setdefault(r["head"], Head(r["level"], r["start"]))
            h.trees.append(DecisionTreeRegressionModel.load(f"{path}/trees/{r['head']}_{r['stage']}"))
            h.steps.append(list(r["steps"]))
        return cls([heads[i] for i in sorted(heads)], list(m["features"]), tuple(m["quantiles"]), m["point"])


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    va = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep")
    return va.transform(numeric_inputs(df, features))


def side_by_side(df: DataFrame, most: int) -> int:
    """How many fits on ``df`` run at a time: enough to fill the cores twice, as each fit keeps its own binned copy of the rows meanwhile."""
    return max(1, min(most, -(-2 * df.sparkSession.sparkContext.defaultParallelism // max(1, df.rdd.getNumPartitions()))))


def load_block(spark: SparkSession, path: str, upto: int) -> tuple[list[DecisionTreeRegressionModel], list[list[float]], float | None] | None:
    """Trees, leaf steps and held-out loss of a finished block of stages; None where it was not finished."""
    if not exists(spark, f"{path}/block_{upto}/_SUCCESS"):
        return None
    rows = sorted(spark.read.parquet(f"{path}/block_{upto}").collect(), key=lambda r: r["stage"])  # a row per tree of the block
    return [DecisionTreeRegressionModel.load(f"{path}/trees/{r['stage']}") for r in rows], [list(r["steps"]) for r in rows], rows[0]["loss"]


def save_block(data: DataFrame, path: str, first: int, trees: Sequence[DecisionTreeRegressionModel], steps: Sequence[list[float]], loss: float | None) -> DataFrame:
    """Keep a block of stages and the scores it ends with; the table that says it is whole is written last."""
    spark, upto = data.sparkSession, first + len(trees)
    data.write.mode("overwrite").parquet(f"{path}/rows_{upto}")
    for s, tree in enumerate(trees, first):
        tree.write().overwrite().save(f"{path}/trees/{s}")
    spark.createDataFrame([(s, v, loss) for s, v in enumerate(steps, first)], "stage int, steps array<double>, loss double").coalesce(
        1).write.mode("overwrite").parquet(f"{path}/block_{upto}")
    return spark.read.schema(data.schema).parquet(f"{path}/rows_{upto}")


def grow(data: DataFrame, level: float, depth: int, rate: float, seed: int) -> tuple[DecisionTreeRegressionModel, list[float], DataFrame]:
    """One stage, learnt from the rows that are not held out: the tree, what it adds in each leaf, and the rows with their new scores."""
    grad = F.when(F.col("__y") > F.col("__f"), F.lit(level)).otherwise(F.lit(level - 1.0))
    tree = DecisionTreeRegressor(featuresCol="__x", labelCol="__g", predictionCol="__p", leafCol="__leaf",
                                 maxDepth=depth, seed=seed).fit(data.where("not __held").withColumn("__g", grad))
    placed = tree.transform(data)
    got = placed.where("not __held").groupBy(F.col("__leaf").cast("int").alias("leaf")).agg(
        F.percentile_approx(F.col("__y") - F.col("__f"), F.lit(level), F.lit(ACCURACY)).alias("v")).collect()
    found = {r["leaf"]: float(r["v"]) * rate for r in got}
    steps = [found.get(i, 0.0) for i in range(max(found) + 1)]
    move = F.get(F.array(*[F.lit(v) for v in steps]), F.col("__leaf").cast("int"))
    return tree, steps, placed.withColumn("__f", F.col("__f") + move).select("__x", "__y", "__held", "__f")


def train_head(base: DataFrame, level: float, start: float, stages: int, depth: int, rate: float, seed: int, write_every: int,
               patience: int | None, path: str | None) -> Head:
    """The head of one level, block by block of ``write_every`` stages."""
    spark, head, data = base.sparkSession, Head(level, start), base.withColumn("__f", F.lit(start))
    best, best_at = math.inf, 0
    while len(head.trees) < stages:
        first = len(head.trees)
        upto = min(stages, first + write_every)
        kept = load_block(spark, path, upto) if path else None
        if kept:
            trees, steps, loss = kept
            data = spark.read.parquet(f"{path}/rows_{upto}")
        else:
            trees, steps = [], []
            for s in range(first, upto):
                tree, step, data = grow(data, level, depth, rate, seed + s)
                trees.append(tree)
                steps.append(step)
            if not path and upto < stages:
                data = materialise(data, "boost-stage")
            loss = data.where("__held").agg(F.avg(pinball(F.col("__y"), F.col("__f"), level))).first()[0] if patience else None
            if path:
                data = save_block(data, path, first, trees, steps, loss)
        head.trees += trees
        head.steps += steps
        if loss is not None and loss < best:
            best, best_at = loss, upto
        if patience and loss is not None and upto - best_at >= patience:
            break
    if best_at:
        del head.trees[best_at:], head.steps[best_at:]
    return head


def train_boost(frame: DataFrame, features: Sequence[str], target: str = "target_lead_time_demand",
                quantiles: Sequence[float] = (0.1, 0.5, 0.9), point_level: float = 0.8, stages: int = 20,
                depth: int = 4, rate: float = 0.2, seed: int = 42, write_every: int = 5, patience: int | None = None,
                parallel: int = 4, state: str | None = None) -> QuantileBoost:
    """One head per quantile plus the point level, fitted side by side on one stored matrix. Running scores are written out every few stages.

    A tree reads its rows four times, and vectors are slow to read from files: the matrix is also cached (memory, then disk) until the heads are fitted.

    With ``patience`` a tenth of the rows, chosen by a hash of their content, is held out. A head stops when its pinball loss on them,
    taken whenever scores are written, has not improved for so many stages, and keeps the stages up to its best. Without a held-out row it goes on to the end.

    With ``state``, a folder on shared storage, the matrix and each finished block of stages are kept there, and a later call with the
    same settings goes on from the last of them, on the rows of the first call. Only the number of stages may differ; other settings are a ``ValueError``.
    """
    spark, levels = frame.sparkSession, sorted({*quantiles, point_level})
    held = F.pmod(F.xxhash64(*[F.col(f"`{n}`") for n in (*features, target)]), F.lit(10)) == 0 if patience else F.lit(False)
    matrix = assemble(frame.select(*features, target, held.alias("__held")), features).select("__x", F.col(target).cast("double").alias("__y"), "__held")
    if state:
        mark = fingerprint(list(features), target, levels, depth, rate, seed, write_every, patience)
        if not exists(spark, f"{state}/settings/_SUCCESS"):
            matrix.write.mode("overwrite").parquet(f"{state}/matrix")
            spark.createDataFrame([(mark,)], "mark string").coalesce(1).write.mode("overwrite").json(f"{state}/settings")
        elif spark.read.schema("mark string").json(f"{state}/settings").first()["mark"] != mark:
            raise ValueError(f"{state} holds the stages of other settings")
        base = spark.read.schema(matrix.schema).parquet(f"{state}/matrix")
    else:
        base = materialise(matrix, "boost-train")
    base.persist()
    try:
        starts = base.where("not __held").agg(F.percentile_approx("__y", F.array(*[F.lit(q) for q in levels]), F.lit(ACCURACY))).first()[0]
        with ThreadPoolExecutor(side_by_side(base, parallel)) as pool:
            heads = list(pool.map(lambda i: train_head(base, levels[i], float(starts[i]), stages, depth, rate, seed, write_every, patience,
                                                       f"{state}/head_{i}" if state else None), range(len(levels))))
    finally:
        base.unpersist()
    return QuantileBoost(heads, list(features), tuple(quantiles), point_level)
