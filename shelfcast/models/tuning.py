"""Trials, Pareto fronts and gates. Every trial is a distributed fit; the trial table is small."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import timedelta
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.columns import pinball, quantile_column, ratio, sum0, winkler
from ..operators.folds import HOLDOUT_FOLD_ID
from ..operators.orders import critical_fractile
from ..operators.skyline import pareto_front
from ..session import materialise
from .boost import side_by_side
from .conformal import boost_trainer

TRIALS = "trial_number int, pinball double, winkler double, n_estimators int, learning_rate double, max_depth int"
LOSS_DIGITS = 6


def policy_frontier(df: DataFrame, scales: Sequence[float], keys: Sequence[str] = ("data_strategy",)) -> DataFrame:
    """Cost, service and fill of each model's orders under a range of scales, with the efficient ones marked."""
    rows = df.where(F.col("fold_id") != HOLDOUT_FOLD_ID) if "fold_id" in df.columns else df
    rows = rows.withColumn("order_scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))
    q = F.col("order_quantity") * F.col("order_scale")
    gap = q - F.col("y_true")
    over, short = F.greatest(gap, F.lit(0.0)), F.greatest(-gap, F.lit(0.0))
    g = rows.groupBy(*keys, "model_name", "order_scale").agg(
        sum0(F.col("c_over") * over + F.col("c_under") * short).alias("total_cost"),
        F.avg((short <= 0).cast("double")).alias("service_level"),
        (1.0 - ratio(F.sum(short), F.sum("y_true"))).alias("fill_rate"))
    g = g.withColumns({n: F.round(n, LOSS_DIGITS) for n in ("total_cost", "service_level", "fill_rate")})  # sums depend on the order of rows
    g = g.withColumns({"__s": -F.col("service_level"), "__f": -F.col("fill_rate")})
    return pareto_front(g, ["total_cost", "__s", "__f"], keys).drop("__s", "__f")


@lru_cache
def t_quantile(p: float, dof: int) -> float:
    """Student-t quantile by bisection on a Simpson integral of the density."""
    norm = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)

    def mass(x: float, n: int = 2000) -> float:
        h = x / n
        f = [norm * (1 + (i * h) ** 2 / dof) ** (-(dof + 1) / 2) for i in range(n + 1)]
        return h / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))

    lo, hi = 0.0, 1.0
    while mass(hi) < p - 0.5:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mass(mid) < p - 0.5 else (lo, mid)
    return (lo + hi) / 2


@dataclass(frozen=True)
class PairedInterval:
    mean: float
    low: float
    high: float
    n: int


def student_interval(mean: float, deviation: float, n: int) -> PairedInterval:
    half = t_quantile(0.975, n - 1) * deviation / math.sqrt(n)
    return PairedInterval(mean, mean - half, mean + half, n)


def paired_ci(df: DataFrame, a: str, b: str) -> PairedInterval:
    """95 % Student-t interval of the mean of ``a - b`` over draws."""
    d = F.col(a) - F.col(b)
    r = df.agg(F.avg(d).alias("m"), F.stddev_samp(d).alias("s"), F.count(d).alias("n")).first()
    if r["n"] < 2:
        raise ValueError(f"an interval for the mean needs at least 2 draws, got {r['n']}")
    return student_interval(r["m"], r["s"], r["n"])


def best_so_far(trials: DataFrame, loss: str = "mae", order: str = "trial_number") -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return trials.withColumn("best_so_far", F.min(loss).over(w))


def tuning_split(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last 20 % of days, but at least 3 and at most 14, are held out."""
    r = frame.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    days = max(3, min(14, int((r["b"] - r["a"]).days * 0.2)))
    cut = r["b"] - timedelta(days=days)
    return frame.where(F.col("date") <= F.lit(cut)), frame.where(F.col("date") > F.lit(cut))


def sample_trials(n: int, seed: int = 42, max_stages: int = 200, max_depth: int = 6) -> list[dict]:
    rng = random.Random(seed)
    return [{"n_estimators": rng.randint(5, max_stages),
             "learning_rate": math.exp(rng.uniform(math.log(0.02), math.log(0.5))),
             "max_depth": rng.randint(2, max_depth)} for _ in range(n)]


def tune_boost(frame: DataFrame, features: Sequence[str], settings: Settings, trials: Sequence[dict] | None = None,
               parallel: int = 2) -> DataFrame:
    """Trial table with both losses, the front and the choice (least sum of losses on the front).

    Empty when the split leaves nothing on one side; the caller then keeps its defaults.
    """
    spark = frame.sparkSession
    train, held = tuning_split(frame)
    if train.isEmpty() or held.isEmpty():
        return spark.createDataFrame([], TRIALS + ", is_on_front boolean, is_selected boolean")
    train, held = materialise(train, "tuning-train"), materialise(held, "tuning-held")
    trials = list(trials or sample_trials(settings.models.tuning_trials, settings.random_seed, settings.models.n_estimators, settings.models.max_depth))
    lo, hi = settings.models.quantiles[0], settings.models.quantiles[-1]
    level, alpha = critical_fractile(settings.inventory), lo + (1.0 - hi)

    def run(i: int) -> tuple:
        t = trials[i]
        model = boost_trainer(t["n_estimators"], t["max_depth"], t["learning_rate"])(train, features, settings)
        y = F.col("target_lead_time_demand")
        r = model.predict(held).agg(
            F.avg(pinball(y, "y_pred", level)).alias("p"),
            F.avg(winkler(y, quantile_column(lo), quantile_column(hi), alpha)).alias("w")).first()
        w = r["w"] if len(settings.models.quantiles) >= 2 else 2.0 * r["p"]
        return (i, r["p"], w, t["n_estimators"], t["learning_rate"], t["max_depth"])

    with ThreadPoolExecutor(side_by_side(train, parallel)) as pool:
        rows = list(pool.map(run, range(len(trials))))
    table = pareto_front(spark.createDataFrame(rows, TRIALS), ["pinball", "winkler"])
    whole = Window.partitionBy(F.lit(0))
    chosen = F.min_by("trial_number", F.when(F.col("is_on_front"), F.col("pinball") + F.col("winkler"))).over(whole)
    return table.withColumn("is_selected", F.col("trial_number") == chosen)
