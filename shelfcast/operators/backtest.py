"""Rolling-origin comparison of retraining cadences."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import InventoryConfig
from ..functions.columns import hash52, ratio, sum0
from .features import expanding_fallback, reveal_actuals, rows_as_of, all_present
from .orders import inventory_costs, order_quantity
from .panel import union_all

BASELINE = "never"
MIN_ORIGINS = 8
RESAMPLES = 2000
Scorer = Callable[[DataFrame], DataFrame]


def cadence_label(k: int | None) -> str:
    return BASELINE if k is None else f"every_{k}d"


def retrain_days(n_days: int, k: int | None) -> list[int]:
    """Day indexes on which a cadence retrains, just before it scores."""
    return [] if k is None else [i for i in range(n_days) if (i + 1) % k == 0]


def independent_origins(df: DataFrame, horizon: int) -> DataFrame:
    """Origins whose windows do not overlap and whose actuals are all in."""
    return df.where((F.col("day_index") % horizon == 0) & F.col("actuals_complete"))


def day_index(dates: Sequence[date]) -> Column:
    return F.element_at(F.create_map(*[x for i, d in enumerate(dates) for x in (F.lit(d), F.lit(i))]),
                        F.col("decision_date"))


def origin_rows(features: DataFrame, names: Sequence[str], panel: DataFrame, dates: Sequence[date],
                horizon: int) -> DataFrame:
    """Inference rows for every decision date at once.

    Features look only backwards, so one feature frame over the whole panel holds what each
    day's own history would give; only the fallback means need sums up to the date.
    """
    rows = rows_as_of(features, dates).withColumn(
        "prediction_source", F.when(all_present(names), "model").otherwise("cold_start_fallback"))
    out = expanding_fallback(rows, panel, dates, horizon)
    cold = F.col("prediction_source") == "cold_start_fallback"
    return out.withColumns({"fallback_level": F.when(cold, F.col("fallback_level")),
                            "fallback_target_lead_time_demand":
                                F.when(cold, F.col("fallback_target_lead_time_demand"))})


def serving_table(spark: SparkSession, n_days: int, cadences: Sequence[int | None]) -> DataFrame:
    """``cadence, day_index, model_version, retrained_this_step``: the model that each cadence serves on each day.

    A version is the day on which it was trained, -1 for the first model. As many rows as cadences times days.
    """
    rows = []
    for k in cadences:
        days, version = set(retrain_days(n_days, k)), -1
        for day in range(n_days):
            version = day if day in days else version
            rows.append((cadence_label(k), day, version, day in days))
    return spark.createDataFrame(rows, "cadence string, day_index int, model_version int, retrained_this_step boolean")


def score_versions(origins: DataFrame, serving: DataFrame, scorer: Scorer | dict[int, Scorer]) -> DataFrame:
    """Every origin under every cadence, scored by the version that serves on its day.

    A single ``scorer`` knows all versions by the column ``model_version``: the origins meet the serving table by day and are
    read once, whatever the number of versions. Scorers by version each read the days that their version serves in any
    cadence, and score an origin once for all cadences that share it; keep the origins partitioned by day for that.
    """
    calendar = F.broadcast(serving)  # a row per cadence and day
    if not isinstance(scorer, dict):
        return scorer(origins.join(calendar, "day_index"))
    days: dict[int, set[int]] = {}
    for r in serving.select("model_version", "day_index").distinct().collect():
        days.setdefault(r["model_version"], set()).add(r["day_index"])
    parts = [scorer[v](origins.where(F.col("day_index").isin(sorted(d)))).withColumn("model_version", F.lit(v)) for v, d in sorted(days.items())]
    return union_all(*parts).join(calendar, ["day_index", "model_version"])


def cost_origins(scored: DataFrame, eval_panel: DataFrame, dates: Sequence[date], horizon: int,
                 cfg: InventoryConfig = InventoryConfig(), profile: DataFrame | None = None) -> DataFrame:
    """Orders, revealed actuals and cost. A date is complete when every series seen has all its days."""
    actual = reveal_actuals(eval_panel, dates, horizon)
    complete = actual.groupBy("decision_date").agg((F.min("actuals_days_observed") >= horizon).alias("actuals_complete"))
    df = scored.drop("y_true").join(actual.select("decision_date", "series_id", "y_true"),
                                    ["decision_date", "series_id"], "left")
    df = df.join(complete, "decision_date", "left").withColumn(
        "actuals_complete", F.coalesce("actuals_complete", F.lit(False)))
    cold = F.col("prediction_source") == "cold_start_fallback"
    df = df.withColumn("y_pred", F.when(cold, F.col("fallback_target_lead_time_demand")).otherwise(F.col("y_pred")))
    return inventory_costs(order_quantity(df, cfg, profile), cfg, profile)


def cadence_summary(df: DataFrame, events: DataFrame, horizon: int) -> DataFrame:
    """Cost and service per cadence over independent origins; cadences without any are kept."""
    ok = (F.col("day_index") % horizon == 0) & F.col("actuals_complete")

    def part(x: Column) -> Column:
        return F.when(ok, x)

    g = df.groupBy("cadence").agg(
        F.count_distinct(part(F.col("decision_date"))).alias("n_origins"), F.count_if(ok).alias("n_observations"),
        sum0(part(F.col("total_cost"))).alias("total_cost"),
        sum0(part(F.col("stockout_units"))).alias("total_stockout_units"),
        sum0(part(F.col("overstock_units"))).alias("total_overstock_units"),
        sum0(part(F.col("y_true") - F.col("stockout_units"))).alias("__served"),
        sum0(part(F.col("y_true"))).alias("__demand"),
        F.avg(part(F.coalesce(F.col("stockout_units") == 0, F.lit(False)).cast("double"))).alias("service_level"))
    e = events.groupBy("cadence").agg(F.count(F.lit(1)).alias("n_retrains"),
                                      F.avg("duration_seconds").alias("mean_retrain_seconds"))
    return g.join(e, "cadence", "left").select(
        "cadence", "n_origins", "n_observations", "total_cost",
        ratio("total_cost", "n_observations").alias("mean_cost_per_observation"), "total_stockout_units",
        "total_overstock_units", ratio("__served", "__demand").alias("fill_rate"), "service_level",
        F.coalesce("n_retrains", F.lit(0)).alias("n_retrains"),
        F.coalesce("mean_retrain_seconds", F.lit(0.0)).alias("mean_retrain_seconds")).orderBy("total_cost")


def paired_costs(df: DataFrame, horizon: int, cadences: Sequence[str]) -> DataFrame:
    """Cost per origin and cadence over the (date, series) pairs every cadence has."""
    rows = independent_origins(df, horizon)
    wide = rows.groupBy("decision_date", "series_id").pivot("cadence", list(cadences)).agg(F.sum("total_cost"))
    return wide.na.drop(subset=list(cadences))


def compare_cadences(df: DataFrame, horizon: int, cadences: Sequence[str], seed: int = 42,
                     resamples: int = RESAMPLES) -> DataFrame:
    """Each cadence against no retraining, with a bootstrap over whole origins.

    Differences are taken per series before they are summed, so two cadences that still serve the
    same model differ by exactly 0. After pairing there is one row per origin, so the resampling works on a table with as many
    rows as decision dates: resamples times positions, each looked up by a hash of its place.
    """
    others = [k for k in cadences if k != BASELINE]
    paired = paired_costs(df, horizon, cadences)
    n_series = paired.agg(F.count_distinct("series_id")).scalar()
    base = F.col(BASELINE)
    by = paired.groupBy("decision_date").agg(
        F.sum(base).alias("base"), *[F.sum(F.col(f"`{k}`") - base).alias(k) for k in others])
    long = by.select("decision_date", "base", F.explode(F.array(*[
        F.struct(F.lit(k).alias("cadence"), F.col(f"`{k}`").alias("delta")) for k in others])).alias("x")
    ).select("decision_date", "base", "x.*")
    w = Window.partitionBy("cadence")
    idx = long.select("cadence", "base", "delta", (F.row_number().over(w.orderBy("decision_date")) - 1).alias("i"),
                      F.count(F.lit(1)).over(w).alias("n"))
    sizes = idx.groupBy("cadence").agg(F.max("n").alias("n"))
    draws = (sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
             .withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
             .select("cadence", "draw", F.pmod(hash52(F.lit(seed), "draw", "pos"), F.col("n")).alias("i")))
    boot = draws.join(idx.select("cadence", "i", "base", "delta"), ["cadence", "i"]).groupBy("cadence", "draw").agg(
        (ratio(F.sum("delta"), F.sum("base")) * 100.0).alias("pct"))
    ci = boot.groupBy("cadence").agg(F.percentile("pct", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    s = idx.groupBy("cadence").agg(F.count(F.lit(1)).alias("n_origins"),
                                   (ratio(F.sum("delta"), F.sum("base")) * 100.0).alias("cost_change_pct"),
                                   F.count_if(F.col("delta") < 0).alias("origins_cheaper_than_baseline"))
    lo, hi = F.col("ci")[0], F.col("ci")[1]
    few = F.col("n_origins") < MIN_ORIGINS
    return s.join(ci, "cadence").select(
        "cadence", F.lit(BASELINE).alias("baseline"), "n_origins", n_series.alias("n_series"), "cost_change_pct",
        lo.alias("ci95_low_pct"), hi.alias("ci95_high_pct"), "origins_cheaper_than_baseline",
        (~few & ((lo > 0) | (hi < 0))).alias("conclusive"), few.alias("underpowered"))


def comparison_verdict(cmp: DataFrame) -> DataFrame:
    """Reading of each comparison, and the change turned round into a saving."""
    verdict = (F.when(F.col("underpowered"), "underpowered").when(F.col("conclusive"), "excludes_zero")
               .otherwise("indistinguishable"))
    return cmp.select("cadence", "baseline", "n_origins", (-F.col("cost_change_pct")).alias("saving_pct"),
                      (-F.col("ci95_high_pct")).alias("saving_low_pct"), (-F.col("ci95_low_pct")).alias("saving_high_pct"),
                      verdict.alias("verdict"))


def weekly_blocks(df: DataFrame, lower: str = "q_0_1", upper: str = "q_0_9") -> DataFrame:
    """Coverage, cost and error per week and cadence, from complete rows only; null when a week has none."""
    ok = F.col("actuals_complete")
    covered = F.coalesce((F.col("y_true") >= F.col(lower)) & (F.col("y_true") <= F.col(upper)), F.lit(False))
    week = df.where(F.col("day_index") % 7 == 0).withColumn("week_index", F.floor(F.col("day_index") / 7))
    any_ok = F.count_if(ok) > 0
    return week.groupBy("week_index", "cadence").agg(
        F.min("decision_date").alias("origin_date"),
        F.avg(F.when(ok, covered.cast("double"))).alias("coverage"),
        F.when(any_ok, sum0(F.when(ok, F.col("total_cost")))).alias("total_cost"),
        F.avg(F.when(ok, F.abs(F.col("y_pred") - F.col("y_true")))).alias("mae"),
        F.when(any_ok, F.count_distinct(F.when(ok, F.col("series_id")))).otherwise(
            F.count_distinct("series_id")).alias("n_series"),
        F.max("retrained_this_step").alias("retrained"),
        (F.min(ok.cast("int")) == 1).alias("actuals_complete"))


def series_by_volume(df: DataFrame, limit: int | None = None) -> DataFrame:
    rows = df.where(F.col("day_index") % 7 == 0)
    ordered = rows.groupBy("series_id").agg(sum0("y_true").alias("volume")).orderBy(F.desc("volume"), "series_id")
    return ordered.limit(limit) if limit else ordered


def series_trajectory(df: DataFrame, series_id: str, cadence: str = "every_7d", lower: str = "q_0_1",
                      upper: str = "q_0_9") -> DataFrame:
    """Weekly forecast, band and actual of one series under one cadence."""
    rows = df.where((F.col("series_id") == series_id) & (F.col("cadence") == cadence) & (F.col("day_index") % 7 == 0))
    covered = F.coalesce((F.col("y_true") >= F.col(lower)) & (F.col("y_true") <= F.col(upper)), F.lit(False))
    return rows.select(F.floor(F.col("day_index") / 7).alias("week_index"), "decision_date", "y_pred",
                       F.col(lower).alias("lower"), F.col(upper).alias("upper"), "y_true", "order_quantity",
                       "total_cost", covered.alias("covered"), "actuals_complete").orderBy("week_index")


def cumulative_cost(df: DataFrame, horizon: int) -> DataFrame:
    """Running cost by date per cadence; one row per origin and cadence enters the window."""
    daily = independent_origins(df, horizon).groupBy("cadence", "decision_date").agg(sum0("total_cost").alias("cost"))
    w = Window.partitionBy("cadence").orderBy("decision_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.withColumn("cumulative_cost", F.sum("cost").over(w))
