"""Queries on rolling origins, learnt models and streams."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (DatasetConfig, DriftConfig, FeatureConfig, ModelConfig, PreprocessingConfig, Settings,
                      SimulationConfig, ValidationConfig)
from ..functions.columns import floor0
from ..models import tuning as U
from ..models.conformal import ConformalModel, boost_trainer, fit_and_calibrate, forest_trainer
from ..models.imputer_search import tune_imputer
from ..models.teacher import train_teacher
from ..operators import backtest as B
from ..operators import impute as I
from ..operators.features import feature_frame, lead_time_target, supervised_frame
from ..operators.panel import series_window
from ..plans.experiment import run_experiment
from ..plans.rolling import run_rolling_origin
from ..plans.scoring import run_metadata, score_latest, train_champion
from ..session import materialise, scratch_path
from ..sources import store
from ..sources.tables import table
from ..streaming.detector import scan_page_hinkley
from ..streaming.windows import decision_grid, dedupe_stream, event_time, lead_time_sums
from .base import cte, query
from .frames import H, Z90, costed_forecasts, daily_panel
from .q_eval import PAGE_HINKLEY
from .q_panel import md5_52

SIM = Settings(
    dataset=DatasetConfig(top_n_series=None),
    features=FeatureConfig(lags=(1, 7), rolling_windows=(28,), include_static_ids=False, include_weather_lags=False,
                           include_discount_lags=False, include_stockout_lags=False),
    simulation=SimulationConfig(retrain_cadences=(None, 1, 7, 20), simulation_days=56))


class RatioTrainer:
    """Forecast = 28-day mean scaled by how demand has run against it so far; all versions come from one pass."""

    @staticmethod
    def fit_versions(panel: DataFrame, cutoffs: dict):
        """A pair of demand and mean counts for a version if its last day is not after the version's cutoff."""
        frame, _ = feature_frame(panel, SIM.features)
        pairs = frame.select(F.lead("date", H - 1).over(series_window()).alias("known"), lead_time_target("observed_demand", H).alias("y"),
                             (F.col("demand_roll_mean_28") * float(H)).alias("m")).where("y is not null and m is not null")
        by_day = pairs.groupBy("known").agg(F.sum("y").alias("y"), F.sum("m").alias("m")).collect()  # a row per calendar day
        scales = []
        for version, last in cutoffs.items():
            seen = [r for r in by_day if r["known"] <= last]
            scales.append((version, math.fsum(r["y"] for r in seen) / math.fsum(r["m"] for r in seen)))
        table = F.broadcast(panel.sparkSession.createDataFrame(scales, "model_version int, scale double"))

        def score(df: DataFrame) -> DataFrame:
            mid = F.col("demand_roll_mean_28") * (F.lit(float(H)) * F.col("scale"))
            spread = F.col("demand_roll_std_28") * F.lit(H ** 0.5 * Z90)
            return df.join(table, "model_version").withColumns({"y_pred": mid, "q_0_1": floor0(mid - spread), "q_0_5": mid, "q_0_9": mid + spread}).drop("scale")

        return score


def rolling(spark, sf):
    p = materialise(daily_panel(spark, sf), "daily-panel")
    return run_rolling_origin(p.where(F.col("date") < "1998-05-01"), p.where(F.col("date") >= "1998-05-01"), SIM, RatioTrainer())


# 56 decision dates from day 120 on; each cadence serves a version trained at the last retrain day. Regimes know the past only.
cte("sim_features", """SELECT *, CAST(date - DATE '1998-05-01' AS INTEGER) AS day_index,
 CASE WHEN count(*) OVER p=28 THEN avg(observed_demand) OVER p END AS m28, CASE WHEN count(*) OVER p=28 THEN stddev_samp(observed_demand) OVER p END AS s28,
 sum(observed_demand) OVER n AS y7, count(*) OVER n AS n7,
 CASE WHEN stockout_hours>1 THEN 'high_stockout' ELSE 'low_stockout' END AS stockout_regime,
 CASE WHEN avg(observed_demand) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING)>=1 THEN 'fast_moving' ELSE 'slow_moving' END AS velocity_regime,
 CASE WHEN discount>0 THEN 'on_promotion' ELSE 'baseline_price' END AS promo_regime,
 CASE WHEN holiday_flag>0 THEN 'peak_holiday' ELSE 'standard_season' END AS seasonal_regime FROM daily
 WINDOW p AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING),
 n AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)""", "daily")
cte("sim_versions", """SELECT v, sum(y7)/sum(m28*7e0) AS r FROM (SELECT i-1 AS v FROM range(57) t(i)) vs
 JOIN sim_features ON day_index+6<=v WHERE m28 IS NOT NULL AND n7=7 GROUP BY 1""", "sim_features")
cte("sim_serving", """SELECT 'never' AS cadence, i AS day_index, -1 AS v, FALSE AS retrained_this_step FROM range(56) t(i)
 UNION ALL SELECT 'every_1d', i, i, TRUE FROM range(56) t(i)
 UNION ALL SELECT 'every_7d', i, CASE WHEN i<6 THEN -1 ELSE ((i+1)//7)*7-1 END, (i+1)%7=0 FROM range(56) t(i)
 UNION ALL SELECT 'every_20d', i, CASE WHEN i<19 THEN -1 ELSE ((i+1)//20)*20-1 END, (i+1)%20=0 FROM range(56) t(i)""", "sim_versions")
cte("by_day", """SELECT *, greatest(order_quantity-y_true,0e0) AS overstock_units, greatest(y_true-order_quantity,0e0) AS stockout_units,
 greatest(order_quantity-y_true,0e0)+4e0*greatest(y_true-order_quantity,0e0) AS total_cost FROM (SELECT *,
 (q_0_9-q_0_5)/4e-1*(8e-1-5e-1)+q_0_5 AS order_quantity FROM (SELECT s.cadence, s.v AS model_version, s.retrained_this_step, stockout_regime, velocity_regime, promo_regime, seasonal_regime, f.day_index, f.date AS decision_date, f.series_id, f.y7 AS y_true,
 m28*(7e0*r) AS y_pred, greatest(m28*(7e0*r)-s28*(sqrt(7e0)*1.2815515655446008e0),0e0) AS q_0_1, m28*(7e0*r) AS q_0_5,
 m28*(7e0*r)+s28*(sqrt(7e0)*1.2815515655446008e0) AS q_0_9, (min(n7) OVER (PARTITION BY f.date))>=7 AS actuals_complete
 FROM sim_features f JOIN sim_serving s ON s.day_index=f.day_index JOIN sim_versions USING (v)))""", "sim_features", "sim_serving", "sim_versions")
_GRID = "SELECT * FROM by_day WHERE day_index%7=0 AND actuals_complete"


@query("rolling_origin_backtest", "cadence @decision_date #day_index series_id ~y_true ~y_pred ~q_0_1 ~q_0_9 ~order_quantity ~total_cost "
       "#actuals_complete #retrained_this_step #model_version stockout_regime velocity_regime promo_regime seasonal_regime", "E10 J05 J11 J12 T06", "by_day", "SELECT * FROM by_day", digits=5)
def _(spark, sf):
    return rolling(spark, sf).predictions_by_day


@query("independent_origins", "cadence @decision_date series_id ~total_cost", "E09 T02", "by_day", _GRID, digits=5)
def _(spark, sf):
    return B.independent_origins(rolling(spark, sf).predictions_by_day, H)


@query("cadence_summary", "cadence #n_origins #n_observations ~total_cost ~mean_cost_per_observation ~total_stockout_units "
       "~total_overstock_units ~fill_rate ~service_level #n_retrains", "A34 S07", "by_day", digits=4,
       sql=f"""SELECT cadence, count(DISTINCT decision_date) AS n_origins, count(*) AS n_observations, sum(total_cost) AS total_cost,
 sum(total_cost)/count(*) AS mean_cost_per_observation, sum(stockout_units) AS total_stockout_units, sum(overstock_units) AS total_overstock_units,
 sum(y_true-stockout_units)/sum(y_true) AS fill_rate, avg(CASE WHEN stockout_units=0 THEN 1e0 ELSE 0e0 END) AS service_level,
 CASE cadence WHEN 'never' THEN 0 WHEN 'every_1d' THEN 56 WHEN 'every_7d' THEN 8 ELSE 2 END AS n_retrains FROM ({_GRID}) GROUP BY 1""")
def _(spark, sf):
    return rolling(spark, sf).cadence_summary


_BOOT = f"""SELECT cadence, quantile_cont(pct, 0.025) AS lo, quantile_cont(pct, 0.975) AS hi FROM (SELECT cadence, draw, sum(delta)/sum(base)*1e2 AS pct FROM
 (SELECT cadence, draw, {md5_52('42', 'draw', 'pos')} % n AS i FROM (SELECT cadence, count(*) AS n FROM idx GROUP BY 1) CROSS JOIN range(2000) d(draw) CROSS JOIN range(1000) p(pos) WHERE pos<n)
 JOIN idx USING (cadence, i) GROUP BY 1, 2) GROUP BY 1"""
cte("idx", f"""SELECT cadence, row_number() OVER (PARTITION BY cadence ORDER BY decision_date)-1 AS i, base, delta FROM (SELECT c.cadence, decision_date,
 sum(b.total_cost) AS base, sum(c.total_cost-b.total_cost) AS delta FROM ({_GRID}) c JOIN ({_GRID}) b USING (decision_date, series_id)
 WHERE b.cadence='never' AND c.cadence<>'never' GROUP BY 1, 2)""", "by_day")
_CMP = f"""SELECT cadence, 'never' AS baseline, count(*) AS n_origins, (SELECT count(DISTINCT series_id) FROM daily) AS n_series, sum(delta)/sum(base)*1e2 AS cost_change_pct,
 min(lo) AS ci95_low_pct, min(hi) AS ci95_high_pct, count(*) FILTER (delta<0) AS origins_cheaper_than_baseline,
 count(*)>=8 AND (min(lo)>0 OR min(hi)<0) AS conclusive, count(*)<8 AS underpowered FROM idx JOIN ({_BOOT}) USING (cadence) GROUP BY 1"""


@query("cadence_comparison", "cadence baseline #n_origins #n_series ~cost_change_pct ~ci95_low_pct ~ci95_high_pct "
       "#origins_cheaper_than_baseline #conclusive #underpowered", "E13 J14", "idx", _CMP, digits=4)
def _(spark, sf):
    return rolling(spark, sf).cadence_comparison


@query("comparison_verdict", "cadence #n_origins ~saving_pct ~saving_low_pct ~saving_high_pct verdict", "P26 E13", "idx", digits=4,
       sql=f"""SELECT cadence, n_origins, -cost_change_pct AS saving_pct, -ci95_high_pct AS saving_low_pct, -ci95_low_pct AS saving_high_pct,
 CASE WHEN underpowered THEN 'underpowered' WHEN conclusive THEN 'excludes_zero' ELSE 'indistinguishable' END AS verdict FROM ({_CMP})""")
def _(spark, sf):
    return B.comparison_verdict(rolling(spark, sf).cadence_comparison)


_COV = "CASE WHEN y_true>=q_0_1 AND y_true<=q_0_9 THEN 1e0 ELSE 0e0 END"


@query("weekly_blocks", "#week_index cadence @origin_date ~coverage ~total_cost ~mae #n_series #retrained #actuals_complete", "A35 T03", "by_day", digits=4,
       sql=f"""SELECT day_index//7 AS week_index, cadence, min(decision_date) AS origin_date, avg({_COV}) FILTER (actuals_complete) AS coverage,
 sum(total_cost) FILTER (actuals_complete) AS total_cost, avg(abs(y_pred-y_true)) FILTER (actuals_complete) AS mae, count(DISTINCT series_id) AS n_series,
 bool_or(retrained_this_step) AS retrained, bool_and(actuals_complete) AS actuals_complete FROM by_day WHERE day_index%7=0 GROUP BY 1, 2""")
def _(spark, sf):
    return B.weekly_blocks(rolling(spark, sf).predictions_by_day)


@query("cumulative_cost", "cadence @decision_date ~cumulative_cost", "W10", "by_day", digits=4,
       sql=f"""SELECT cadence, decision_date, sum(cost) OVER (PARTITION BY cadence ORDER BY decision_date) AS cumulative_cost FROM
 (SELECT cadence, decision_date, sum(total_cost) AS cost FROM ({_GRID}) GROUP BY 1, 2)""")
def _(spark, sf):
    return B.cumulative_cost(rolling(spark, sf).predictions_by_day, H)


@query("series_by_volume", "series_id ~volume", "L09", "by_day",
       "SELECT series_id, sum(y_true) AS volume FROM by_day WHERE day_index%7=0 GROUP BY 1 ORDER BY volume DESC, series_id LIMIT 60")
def _(spark, sf):
    return B.series_by_volume(rolling(spark, sf).predictions_by_day, 60)


@query("series_trajectory", "#week_index @decision_date ~y_pred ~lower ~upper ~y_true ~order_quantity #covered #actuals_complete", "L11", "by_day", digits=5,
       sql=f"""SELECT day_index//7 AS week_index, decision_date, y_pred, q_0_1 AS lower, q_0_9 AS upper, y_true, order_quantity, {_COV} AS covered, actuals_complete
 FROM by_day WHERE day_index%7=0 AND cadence='every_7d' AND series_id=(SELECT min(series_id) FROM daily)""")
def _(spark, sf):
    by_day = rolling(spark, sf).predictions_by_day
    return B.series_trajectory(by_day, by_day.agg(F.min("series_id")).first()[0])


# Learnt models: checked by rows here and by behaviour in the tests.
LEARN = Settings(
    dataset=DatasetConfig(top_n_series=None), features=FeatureConfig(lags=(1, 7, 14), rolling_windows=(7, 28), include_weather_lags=False),
    validation=ValidationConfig(initial_train_days=98, n_folds=2), preprocessing=PreprocessingConfig(imputation_strategy="historical_mean"),
    models=ModelConfig(tuning_trials=2))


def supervised(spark, sf):
    frame, names = supervised_frame(daily_panel(spark, sf), LEARN.features, H)
    return materialise(frame, "supervised"), names


_PRED = "series_id @date ~target_lead_time_demand ~y_pred ~q_0_1 ~q_0_5 ~q_0_9"


@query("forest_forecast", _PRED, "M03 M15 M04 M06")
def _(spark, sf):
    frame, names = supervised(spark, sf)
    model = fit_and_calibrate(frame.where(F.col("date") < "1998-06-01"), names, LEARN, forest_trainer(10, 5))
    return model.predict(frame.where(F.col("date") >= "1998-06-01"))


@query("boost_forecast", _PRED, "M02 M04")
def _(spark, sf):
    frame, names = supervised(spark, sf)
    model = boost_trainer(4, 3, 0.4)(frame.where(F.col("date") < "1998-06-01"), names, LEARN)
    return model.predict(frame.where(F.col("date") >= "1998-06-01"))


@query("feature_importance", "feature ~importance", "M13 L04")
def _(spark, sf):
    frame, names = supervised(spark, sf)
    return forest_trainer(10, 5)(frame, names, LEARN).importance(spark).orderBy(F.desc("importance"), "feature").limit(7)


@query("score_latest", "series_id @decision_date prediction_source fallback_level ~predicted_lead_time_demand ~order_quantity risk_flag", "M09 M10 E07 T05 S12")
def _(spark, sf):
    panel = materialise(daily_panel(spark, sf), "daily-panel")
    path = scratch_path(spark, "champion")
    train_champion(panel, LEARN, forest_trainer(5, 4)).save(path)
    return score_latest(panel, ConformalModel.load(spark, path), LEARN)["reorder_recommendations"]


@query("experiment_cost_summary", "data_strategy model_name backend_name #observations ~total_cost ~service_level ~sim_total_cost", "E18 E19 M14 M15")
def _(spark, sf):
    return run_experiment(daily_panel(spark, sf), LEARN, {"forest": forest_trainer(5, 4)})["cost_summary"]


@query("tuning_trials", "#trial_number ~pinball ~winkler #n_estimators ~learning_rate #max_depth #is_on_front #is_selected", "M11 E12 W08")
def _(spark, sf):
    frame, names = supervised(spark, sf)
    keep = names[:16]
    trials = [{"n_estimators": 2, "learning_rate": 0.5, "max_depth": 2}, {"n_estimators": 2, "learning_rate": 0.2, "max_depth": 3}]
    return U.tune_boost(frame.select("series_id", "date", "target_lead_time_demand", *keep), keep, LEARN, trials)


@query("imputer_search", "#trial_number params ~mae #n_draws #stopped #is_selected ~best_so_far #beats_default #persisted ~ci95_low ~ci95_high", "M12 W14 E02 E11")
def _(spark, sf):
    found = tune_imputer(daily_panel(spark, sf), [{"iterations": 5, "depth": 3, "step": 0.3}, {"iterations": 2, "depth": 1, "step": 0.05}],
                         n_selection=6, n_validation=4, default={"iterations": 3, "depth": 2, "step": 0.1}, race_after=3)
    verdict = found.decision.first()
    return found.trials.withColumns({n: F.lit(verdict[n]) for n in ("beats_default", "persisted", "ci95_low", "ci95_high")})


@query("supervised_imputation", "strategy ~mae ~rmse ~bias ~mape #n_eval", "M08 A31")
def _(spark, sf):
    p = materialise(daily_panel(spark, sf), "daily-panel")
    draws = I.synthetic_censor(p, [42])
    teacher = train_teacher(I.censored_panel(p, draws, [42]).drop("true_demand", "seed"), iterations=5, depth=4)
    return I.imputation_quality(p, 42, ["supervised", *I.CLOSED_FORM], teacher)


cte("policies", """SELECT data_strategy, model_name, k AS order_scale, round(sum(greatest(order_quantity*k-y_true,0e0)+4e0*greatest(y_true-order_quantity*k,0e0)), 6) AS total_cost,
 round(avg(CASE WHEN y_true-order_quantity*k<=0 THEN 1e0 ELSE 0e0 END), 6) AS service_level, round(1e0-sum(greatest(y_true-order_quantity*k,0e0))/sum(y_true), 6) AS fill_rate
 FROM costed CROSS JOIN (VALUES (8e-1),(9e-1),(1e0),(11e-1),(12e-1)) v(k) GROUP BY 1, 2, 3""", "costed")
cte("trials", """SELECT series_id, round(avg(abs(y_pred-y_true)),6) AS mae, round(avg(q_0_9-q_0_1),6) AS width FROM forecasts WHERE model_name='rolling_normal' GROUP BY 1""", "forecasts")


@query("policy_frontier", "data_strategy model_name ~order_scale ~total_cost ~service_level ~fill_rate #is_on_front", "E12", "policies", digits=4,
       sql="""SELECT a.*, NOT EXISTS (SELECT 1 FROM policies b WHERE b.data_strategy=a.data_strategy AND b.total_cost<=a.total_cost AND b.service_level>=a.service_level
 AND b.fill_rate>=a.fill_rate AND (b.total_cost<a.total_cost OR b.service_level>a.service_level OR b.fill_rate>a.fill_rate)) AS is_on_front FROM policies a""")
def _(spark, sf):
    return U.policy_frontier(costed_forecasts(spark, sf), [0.8, 0.9, 1.0, 1.1, 1.2])


@query("trial_front", "series_id ~mae ~width #is_on_front", "E12 L10", "trials",
       "SELECT a.*, NOT EXISTS (SELECT 1 FROM trials b WHERE b.mae<=a.mae AND b.width<=a.width AND (b.mae<a.mae OR b.width<a.width)) AS is_on_front FROM trials a")
def _(spark, sf):
    from .frames import forecasts
    f = forecasts(spark, sf).where(F.col("model_name") == "rolling_normal")
    g = f.groupBy("series_id").agg(F.round(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))), 6).alias("mae"),
                                   F.round(F.avg(F.col("q_0_9") - F.col("q_0_1")), 6).alias("width"))
    return U.pareto_front(g, ["mae", "width"])


@query("paired_interval", "~mean ~low ~high #n", "E11", "forecasts", digits=4,
       sql="""SELECT avg(d) AS mean, count(*) AS n, avg(d)-t*stddev_samp(d)/sqrt(CAST(count(*) AS DOUBLE)) AS low, avg(d)+t*stddev_samp(d)/sqrt(CAST(count(*) AS DOUBLE)) AS high FROM
 (SELECT date, avg(abs(naive-y_true))-avg(abs(7e0*m28-y_true)) AS d FROM validation WHERE data_strategy='Observed' GROUP BY 1), (SELECT 2.0859634472658364e0 AS t) GROUP BY t""")
def _(spark, sf):
    from .frames import forecasts
    f = forecasts(spark, sf).where(F.col("data_strategy") == "Observed")
    e = F.abs(F.col("y_pred") - F.col("y_true"))
    wide = f.groupBy("date").agg(F.avg(F.when(F.col("model_name") == "seasonal_naive", e)).alias("a"),
                                 F.avg(F.when(F.col("model_name") == "rolling_normal", e)).alias("b"))
    ci = U.paired_ci(wide, "a", "b")
    return spark.createDataFrame([(ci.mean, ci.low, ci.high, ci.n)], "mean double, low double, high double, n int")


@query("latest_run_artifacts", "run_id data_strategy model_name ~total_cost", "S05 S09 S12", "cost_summary",
       "SELECT *, 'demo_20240101_000000' AS run_id FROM cost_summary", digits=5)
def _(spark, sf):
    from ..operators.metrics import summarize_costs
    root, run = scratch_path(spark, "runs"), "demo_20240101_000000"
    f = materialise(costed_forecasts(spark, sf), "forecasts")
    store.write_run(root, run, {"predictions": f, "cost_summary": summarize_costs(f)}, LEARN)
    latest = store.latest_run(spark, root, ["predictions", "cost_summary"])
    return store.read_artifact(spark, root, "cost_summary", latest)


@query("run_metadata", "#recommendation_rows #exception_rows run_mode #promotion_executed", "S12", "costed",
       """SELECT count(*) AS recommendation_rows, (SELECT count(*) FROM costed WHERE q_0_9-q_0_1>=(SELECT quantile_cont(q_0_9-q_0_1, 0.95) FROM costed WHERE q_0_9-q_0_1>0)
 OR order_quantity>=(SELECT quantile_cont(order_quantity, 0.99) FROM costed)) AS exception_rows, 'experiment' AS run_mode, FALSE AS promotion_executed FROM costed""")
def _(spark, sf):
    from ..operators.report import exceptions, reorder_recommendations
    rec = reorder_recommendations(materialise(costed_forecasts(spark, sf), "forecasts"))
    return run_metadata(rec, exceptions(rec), LEARN)


@query("stored_panel", "series_id @date ~observed_demand ~avg_humidity", "S02 S03 S01 L01", "panel", "SELECT * FROM panel WHERE date>=DATE '2000-01-01'")
def _(spark, sf):
    from ..sources.tables import raw_split
    raw, out = scratch_path(spark, "raw"), scratch_path(spark, "panels")
    split = raw_split(spark, sf)
    split.write.parquet(f"{raw}/train.parquet")
    cfg = DatasetConfig(top_n_series=None)
    panel = store.load_prepared_panel(spark, raw, out, cfg)
    return panel.where(F.col("date") >= "2000-01-01")


# Streams over the event table, run to the end and compared with the closed windows in SQL.
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark, sf):
    s = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)
    return event_time(s, "ts", "1 day")


def drained(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over all it has and read what it wrote."""
    spark = df.sparkSession
    out = scratch_path(spark, name)
    q = (df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


_CLOSED = "(SELECT max(ts)-INTERVAL 1 DAY FROM events)"


@query("stream_lead_time_sums", "event_type @decision_date ~y_true #rows_observed", "T01 T03", "", digits=4,
       sql=f"""SELECT event_type, d AS decision_date, sum(value) AS y_true, count(value) AS rows_observed FROM (SELECT *, unnest([CAST(CAST(ts AS DATE)-i AS DATE) FOR i IN [0,1,2,3,4,5,6]]) AS d
 FROM events) WHERE d+INTERVAL 7 DAY<={_CLOSED} GROUP BY 1, 2""")
def _(spark, sf):
    return drained(lead_time_sums(event_stream(spark, sf), "ts", ["event_type"], "value", H), "lead-time")


@query("stream_decision_grid", "event_type @decision_date ~y_true #rows_observed", "T02 T03", "", digits=4,
       sql=f"""SELECT event_type, DATE '1970-01-01'+CAST(((CAST(ts AS DATE)-DATE '1970-01-01')//7)*7 AS INTEGER) AS decision_date, sum(value) AS y_true, count(value) AS rows_observed
 FROM events GROUP BY 1, 2 HAVING DATE '1970-01-01'+CAST(((min(CAST(ts AS DATE))-DATE '1970-01-01')//7)*7 AS INTEGER)+INTERVAL 7 DAY<={_CLOSED}""")
def _(spark, sf):
    return drained(decision_grid(event_stream(spark, sf), "ts", ["event_type"], "value", H), "grid")


@query("stream_dedupe", "event_type #n ~total", "T07", "", digits=4,
       sql="SELECT event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1")
def _(spark, sf):
    s = event_stream(spark, sf)
    kept = drained(dedupe_stream(s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy"), ["event_id"]), "dedupe")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("stream_page_hinkley", "event_type #event_id #ph_n ~ph_score #is_drift", "T04 W09", "", digits=4, sql=PAGE_HINKLEY)
def _(spark, sf):
    """Half of the events, then the rest after a restart; a key's rows are scanned day by day."""
    events, root = table(spark, sf, "events").withColumn("day", F.to_date("ts")), scratch_path(spark, "detector")
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    late = F.col("ts") >= F.lit(lo + (hi - lo) / 2)
    for part in (events.where(~late), events.where(late)):
        part.write.mode("append").parquet(f"{root}/events")
        source = spark.readStream.schema(part.schema).parquet(f"{root}/events")
        scan_page_hinkley(source, ["event_type"], ["ts", "event_id"], "value", "day", root, f"{root}/checkpoint",
                          DriftConfig(threshold=2000.0, delta=0.0051234567, min_instances=30), buckets=4).awaitTermination()
    return spark.read.parquet(f"{root}/scores")
