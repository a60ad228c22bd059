"""Queries on accuracy, calibration, drift, imputation and reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import REPORT_COSTS, BusinessConfig, DriftConfig
from ..operators import conformal as N
from ..operators import drift as V
from ..operators import impute as I
from ..operators import ledger as L
from ..operators import metrics as M
from ..operators import report as B
from ..operators.folds import temporal_masks
from ..session import materialise
from ..sources.tables import table
from .base import cte, query
from .frames import costed_forecasts, daily_panel, forecasts, supplier_sales
from .q_inventory import _LEDGER, PRED, Q
from .q_panel import md5_52


_MET = f"""count(*) AS observations, avg(abs(y_pred-y_true)) AS mae, sqrt(avg((y_pred-y_true)*(y_pred-y_true))) AS rmse,
 avg(CASE WHEN q_0_1 IS NOT NULL THEN greatest(1e-1*(y_true-q_0_1), (1e-1-1e0)*(y_true-q_0_1)) END) AS pinball_q_0_1,
 avg(CASE WHEN q_0_5 IS NOT NULL THEN greatest(5e-1*(y_true-q_0_5), (5e-1-1e0)*(y_true-q_0_5)) END) AS pinball_q_0_5,
 avg(CASE WHEN q_0_9 IS NOT NULL THEN greatest(9e-1*(y_true-q_0_9), (9e-1-1e0)*(y_true-q_0_9)) END) AS pinball_q_0_9,
 CASE WHEN count(q_0_1)>0 THEN avg(CASE WHEN y_true>=q_0_1 AND y_true<=q_0_9 THEN 1e0 ELSE 0e0 END) END AS interval_coverage,
 avg(q_0_9-q_0_1) AS interval_width,
 avg((q_0_9-q_0_1)+CASE WHEN y_true<q_0_1 THEN 1e1*(q_0_1-y_true) WHEN y_true>q_0_9 THEN 1e1*(y_true-q_0_9) ELSE 0e0 END) AS winkler_score"""
METRICS = ("#observations ~mae ~rmse ~pinball_q_0_1 ~pinball_q_0_5 ~pinball_q_0_9 ~interval_coverage ~interval_width "
           "~winkler_score")
# The last fold stands in for a holdout, to show that the overall metrics leave it out.
cte("with_holdout", "SELECT * REPLACE (CASE WHEN fold_id=2 THEN 999 ELSE fold_id END AS fold_id) FROM forecasts", "forecasts")
cte("fold_metrics", f"SELECT data_strategy, model_name, backend_name, fold_id, {_MET} FROM with_holdout GROUP BY 1, 2, 3, 4", "with_holdout")


def with_holdout(spark, sf):
    return forecasts(spark, sf).withColumn("fold_id", F.when(F.col("fold_id") == 2, 999).otherwise(F.col("fold_id")))


@query("prediction_summary", "data_strategy model_name backend_name #fold_id " + METRICS, "A22 A23 A24 P16", "fold_metrics",
       f"""SELECT * FROM fold_metrics UNION ALL BY NAME SELECT data_strategy, model_name, backend_name, CAST(NULL AS INTEGER) AS fold_id,
 {_MET} FROM with_holdout WHERE fold_id<>999 GROUP BY 1, 2, 3""", digits=5)
def _(spark, sf):
    return M.summarize_predictions(with_holdout(spark, sf))


cte("normal", "SELECT *, greatest(q_0_1-y_true, y_true-q_0_9) AS score FROM forecasts WHERE model_name='rolling_normal'", "forecasts")


def _kth(source: str, keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    sel = f"{keys}," if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {sel} greatest(max(score) FILTER (rn=least(n, CAST(ceil((n+1)*CAST(0.8 AS DOUBLE)) AS BIGINT))), 0e0) AS q_hat,
 max(n) AS n_scores FROM (SELECT *, row_number() OVER ({part} ORDER BY score) AS rn, count(score) OVER ({part}) AS n FROM {source}) {grp}"""


_CAL = "(SELECT * FROM normal WHERE fold_id<2)"
cte("radius", f"""SELECT 'global' AS scope, data_strategy, CAST(NULL AS BIGINT) AS third_category_id, q_hat, n_scores FROM ({_kth(_CAL, 'data_strategy')})
 UNION ALL SELECT 'group', data_strategy, third_category_id, q_hat, n_scores FROM ({_kth(_CAL, 'data_strategy, third_category_id')})""", "normal")


def _normal(spark, sf):
    return forecasts(spark, sf).where(F.col("model_name") == "rolling_normal")


@query("conformity_scores", PRED + " ~score", "M05", "normal", "SELECT * FROM normal")
def _(spark, sf):
    f = _normal(spark, sf)
    return f.withColumn("score", N.conformity_score(f, 0.2))


@query("conformal_radius", "scope data_strategy #third_category_id ~q_hat #n_scores", "W11 M06 M15", "radius", "SELECT * FROM radius")
def _(spark, sf):
    f = materialise(_normal(spark, sf).where(F.col("fold_id") < 2), "calibration")
    return N.calibrate(f, 0.2, ["data_strategy"])


@query("conformal_quantiles", PRED + " ~q_hat ~q_0_1 ~q_0_5 ~q_0_9", "M07 J06 M06", "radius",
       """SELECT n.* REPLACE (greatest(q_0_1-r.q_hat,0e0) AS q_0_1, greatest(q_0_9+r.q_hat,0e0) AS q_0_9), r.q_hat AS q_hat FROM normal n
 JOIN radius r ON r.scope='group' AND r.data_strategy=n.data_strategy AND r.third_category_id=n.third_category_id WHERE fold_id=2""")
def _(spark, sf):
    f = materialise(_normal(spark, sf), "forecasts")
    cal = N.calibrate(f.where(F.col("fold_id") < 2), 0.2, ["data_strategy"])
    return N.apply_radius(N.attach_radius(f.where(F.col("fold_id") == 2), cal, ["data_strategy"]), 0.2)


@query("symmetric_conformal", "series_id @date ~q_0_1 ~q_0_5 ~q_0_9", "M07 M05 W11", "validation",
       f"""SELECT series_id, date, greatest(naive-h, 0e0) AS q_0_1, naive AS q_0_5, greatest(naive+h, 0e0) AS q_0_9 FROM validation,
 (SELECT q_hat AS h FROM ({_kth("(SELECT abs(y_true-naive) AS score FROM validation WHERE fold_id<2 AND data_strategy='Observed')", '')}))
 WHERE fold_id=2 AND data_strategy='Observed'""")
def _(spark, sf):
    f = materialise(forecasts(spark, sf).where((F.col("model_name") == "seasonal_naive") & (F.col("data_strategy") == "Observed"))
                    .drop(*Q), "forecasts")
    cal = N.calibrate(f.where(F.col("fold_id") < 2), 0.2, group=None)
    return N.apply_radius(N.attach_radius(f.where(F.col("fold_id") == 2), cal, group=None), 0.2)


@query("monotone_quantiles", PRED + " ~q_0_1 ~q_0_5 ~q_0_9", "M04", "normal",
       """SELECT * REPLACE (list_sort([q_0_9, q_0_1, q_0_5*11e-1])[1] AS q_0_1, list_sort([q_0_9, q_0_1, q_0_5*11e-1])[2] AS q_0_5,
 list_sort([q_0_9, q_0_1, q_0_5*11e-1])[3] AS q_0_9) FROM normal""")
def _(spark, sf):
    f = _normal(spark, sf)
    crossed = f.withColumns({"q_0_1": F.col("q_0_9"), "q_0_5": F.col("q_0_1"), "q_0_9": F.col("q_0_5") * 1.1})
    return N.monotone_quantiles(crossed)


# Population stability of features between the older and newer half of the panel.
_PSI_FEATURES = ["observed_demand", "discount", "avg_humidity"]


def _psi_sql(rows: str, key: str) -> str:
    """``rows`` gives (key, v, cur); ten bins from the unique deciles of the older part, open at both ends."""
    return f"""SELECT {key}, CASE WHEN max(rt)>0 AND max(ct)>0 THEN sum((ks-rs)*ln(ks/rs)) ELSE 0e0 END AS psi FROM (SELECT *,
 greatest(r/rt, 1e-4) AS rs, greatest(k/ct, 1e-4) AS ks FROM (SELECT *, sum(r) OVER (PARTITION BY {key}) AS rt, sum(k) OVER (PARTITION BY {key}) AS ct FROM
 (SELECT {key}, bin, CAST(count(*) FILTER (NOT cur) AS DOUBLE) AS r, CAST(count(*) FILTER (cur) AS DOUBLE) AS k FROM (SELECT x.*, len(list_filter(e, lambda q: q<=v)) AS bin
 FROM ({rows}) x JOIN (SELECT {key}, CASE WHEN len(u)>2 THEN u[2:len(u)-1] ELSE [] END AS e FROM (SELECT {key}, list_sort(list_distinct(quantile_cont(v,
 [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]))) AS u FROM ({rows}) WHERE NOT cur GROUP BY 1)) USING ({key})) GROUP BY 1, 2))) GROUP BY 1"""


_HALVES = " UNION ALL ".join(f"""SELECT '{c}' AS name, CAST({c} AS DOUBLE) AS v,
 (date - DATE '1970-01-01')>=(SELECT quantile_cont(date - DATE '1970-01-01', 0.5) FROM sales) AS cur FROM sales""" for c in _PSI_FEATURES)


@query("population_stability", "name ~psi", "E14 A36", "sales", _psi_sql(_HALVES, "name"))
def _(spark, sf):
    from ..operators.profile import stacked
    s = materialise(supplier_sales(spark, sf).select("date", *_PSI_FEATURES), "sales")
    long = stacked(V.halves_by_date(s), _PSI_FEATURES, ["is_current"]).withColumnRenamed("column_name", "name")
    return V.psi(long, ["name"], "value", "is_current")


_IMP = {"observed_demand": 5.0, "discount": 3.0, "avg_humidity": 2.0, "holiday_flag": 1.0}


@query("feature_drift_report", "name type ~importance ~psi status", "E15 L04 P22 E14", "sales", digits=4,
       sql=f"""SELECT name, 'numeric' AS type, CASE name WHEN 'observed_demand' THEN 5e0/11e0 WHEN 'discount' THEN 3e0/11e0 ELSE 2e0/11e0 END AS importance,
 psi, CASE WHEN psi>=0.2 THEN 'critical' WHEN psi>=0.1 THEN 'warning' ELSE 'ok' END AS status FROM ({_psi_sql(_HALVES, 'name')})""")
def _(spark, sf):
    s = materialise(supplier_sales(spark, sf).select("date", *_IMP), "sales")
    imp = spark.createDataFrame(list(_IMP.items()), "feature string, importance double")
    return V.feature_drift_report(s, imp, top_n=3)


@query("drift_rollup", "#critical_count ~average_psi", "A36", "sales", digits=4,
       sql=f"SELECT count(*) FILTER (p>=0.2) AS critical_count, avg(p) AS average_psi FROM (SELECT round(psi, 4) AS p FROM ({_psi_sql(_HALVES, 'name')}))")
def _(spark, sf):
    s = materialise(supplier_sales(spark, sf).select("date", *_IMP), "sales")
    imp = spark.createDataFrame(list(_IMP.items()), "feature string, importance double")
    return B.drift_rollup(V.feature_drift_report(s, imp, top_n=3))


_SERIES_HALVES = """SELECT series_id, observed_demand AS v, rn>n//2 AS cur FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn,
 count(*) OVER (PARTITION BY series_id) AS n FROM daily)"""


@query("series_stability", "series_id ~psi", "E16 W12", "daily", _psi_sql(_SERIES_HALVES, "series_id"), digits=3)
def _(spark, sf):
    return V.series_psi(daily_panel(spark, sf), value="observed_demand")


@query("category_stability", "name ~psi", "E14", "sales",
       """SELECT 'holiday_flag' AS name, sum((k-r)*ln(k/r)) AS psi FROM (SELECT holiday_flag, greatest(count(*) FILTER (cur)/sum(count(*) FILTER (cur)) OVER (), 1e-4) AS k,
 greatest(count(*) FILTER (NOT cur)/sum(count(*) FILTER (NOT cur)) OVER (), 1e-4) AS r FROM (SELECT holiday_flag,
 (date - DATE '1970-01-01')>=(SELECT quantile_cont(date - DATE '1970-01-01', 0.5) FROM sales) AS cur FROM sales) GROUP BY 1)""")
def _(spark, sf):
    s = V.halves_by_date(supplier_sales(spark, sf)).withColumn("name", F.lit("holiday_flag"))
    return V.category_psi(s, ["name"], "holiday_flag", "is_current")


# Page-Hinkley over the event stream, by event type in time order.
_PH = """SELECT event_type, event_id, ts, dev, sum(dev) OVER w AS s, n FROM (SELECT *, value-avg(value) OVER w-CAST(0.0051234567 AS DOUBLE) AS dev,
 count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


PAGE_HINKLEY = f"""SELECT event_type, event_id, n AS ph_n, s-least(0e0, m) AS ph_score, n>30 AND s-least(0e0, m)>2000 AS is_drift FROM (SELECT *, min(s) OVER
 (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM ({_PH}))"""


@query("page_hinkley", "event_type #event_id #ph_n ~ph_score #is_drift", "W09 T04", digits=4, sql=PAGE_HINKLEY)
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("minute", F.date_trunc("minute", F.col("ts").cast("timestamp")))
    return V.page_hinkley(e, ["event_type"], ["ts", "event_id"], "value",
                          DriftConfig(threshold=2000.0, delta=0.0051234567, min_instances=30), bucket="minute")


@query("fold_drift_watch", "data_strategy model_name #fold_id ~mae ~ph_score #is_drift", "E17 W09", "forecasts", digits=5,
       sql="""SELECT *, s-least(0e0, min(s) OVER p) AS ph_score, n>2 AND s-least(0e0, min(s) OVER p)>15 AS is_drift FROM (SELECT *, sum(dev) OVER p AS s FROM
 (SELECT *, mae-avg(mae) OVER p-CAST(0.005 AS DOUBLE) AS dev, count(*) OVER p AS n FROM (SELECT data_strategy, model_name, fold_id, avg(abs(y_pred-y_true)) AS mae
 FROM forecasts GROUP BY 1, 2, 3) WINDOW p AS (PARTITION BY data_strategy, model_name ORDER BY fold_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 WINDOW p AS (PARTITION BY data_strategy, model_name ORDER BY fold_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 WINDOW p AS (PARTITION BY data_strategy, model_name ORDER BY fold_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    return V.fold_drift_watch(M.summarize_predictions(forecasts(spark, sf)))


# Latent demand.
_CLEAN = """coalesce(avg(CASE WHEN stockout_hours=0 THEN observed_demand END) OVER (PARTITION BY series_id),
 (SELECT avg(observed_demand) FROM daily WHERE stockout_hours=0))"""
_LONG = f"""SELECT series_id, date, 'historical_mean' AS strategy, observed_demand AS observed, CASE WHEN stockout_hours=0 THEN observed_demand
 ELSE greatest(observed_demand, {_CLEAN}) END AS latent_demand_est, stockout_hours, stockout_hours<>0 AS is_imputed FROM daily UNION ALL
 SELECT series_id, date, 'clipped_scaling', observed_demand, CASE WHEN stockout_hours=0 THEN observed_demand ELSE observed_demand*12e-1 END,
 stockout_hours, stockout_hours<>0 FROM daily"""


@query("latent_long", "series_id @date strategy ~observed ~latent_demand_est ~stockout_hours #is_imputed", "S08 M08 J04", "daily", _LONG)
def _(spark, sf):
    return I.latent_long(daily_panel(spark, sf))


@query("imputed_panel", "series_id @date ~observed_demand ~original_observed_demand ~latent_demand_est #is_imputed", "M08 J04", "daily",
       """SELECT series_id, date, observed AS original_observed_demand, latent_demand_est, latent_demand_est AS observed_demand, is_imputed
 FROM (L) WHERE strategy='historical_mean'""".replace("(L)", f"({_LONG})"))
def _(spark, sf):
    return I.impute_latent(daily_panel(spark, sf), "historical_mean")


def drawn(source: str, seed: int, panel: str = "") -> str:
    """Clean days of ``source`` that a seed censors, with the severity of a real stock-out of the same rows."""
    rows = f"(SELECT series_id, date, observed_demand AS true_demand, {seed} AS seed, {md5_52('series_id', 'date', str(seed))} AS h FROM {source} WHERE stockout_hours=0)"
    return f"""SELECT series_id, date, true_demand, hours AS severity_hours, true_demand*(1e0-hours/16e0) AS censored_demand FROM (SELECT *,
 CAST(floor({md5_52('series_id', 'date', str(seed), "'severity'")}*CAST((SELECT count(*) FROM {source} WHERE stockout_hours>0) AS DOUBLE)/4503599627370496e0) AS BIGINT) AS k
 FROM (SELECT *, row_number() OVER (ORDER BY h) AS rn, count(*) OVER () AS n FROM {rows}) WHERE rn<=greatest(1, CAST(floor(n*3e-1) AS BIGINT)))
 JOIN (SELECT stockout_hours AS hours, sum(count(*)) OVER (ORDER BY stockout_hours)-count(*) AS lo, sum(count(*)) OVER (ORDER BY stockout_hours) AS hi
 FROM {source} WHERE stockout_hours>0 GROUP BY 1) ON k>=lo AND k<hi"""


cte("draws", drawn("daily", 42), "daily")


@query("synthetic_censoring", "series_id @date ~true_demand ~severity_hours ~censored_demand", "E03 A33", "draws", "SELECT * FROM draws")
def _(spark, sf):
    return I.synthetic_censor(materialise(daily_panel(spark, sf), "daily-panel"), [42])


def censored(panel: str, draws: str) -> str:
    return f"""SELECT d.series_id, d.date, x.true_demand, coalesce(x.censored_demand, d.observed_demand) AS y, coalesce(x.severity_hours, d.stockout_hours) AS hrs
 FROM {panel} d LEFT JOIN {draws} x USING (series_id, date)"""


def signals(source: str) -> str:
    return f"""SELECT * FROM (SELECT series_id, date, true_demand, unnest([{{'strategy': 'none', 'signal': y}}, {{'strategy': 'historical_mean',
 'signal': greatest(y, coalesce(own, overall))}}, {{'strategy': 'clipped_scaling', 'signal': y*12e-1}}], recursive := true) FROM (SELECT *,
 avg(CASE WHEN hrs=0 THEN y END) OVER (PARTITION BY series_id) AS own, avg(CASE WHEN hrs=0 THEN y END) OVER () AS overall FROM {source})) WHERE true_demand IS NOT NULL"""


cte("censored", censored("daily", "draws"), "draws")
cte("signals", signals("censored"), "censored")
_QUAL = """SELECT strategy, avg(abs(signal-true_demand)) AS mae, sqrt(avg((signal-true_demand)*(signal-true_demand))) AS rmse, avg(signal-true_demand) AS bias,
 avg(CASE WHEN true_demand>0 THEN abs(signal-true_demand)/true_demand END)*1e2 AS mape, count(*) AS n_eval FROM signals WHERE strategy<>'none' GROUP BY 1"""


@query("imputation_quality", "strategy ~mae ~rmse ~bias ~mape #n_eval", "A31 E03 M08", "signals", _QUAL)
def _(spark, sf):
    return I.imputation_quality(materialise(daily_panel(spark, sf), "daily-panel"))


@query("ranked_quality", "strategy ~mae #rank ~bar_pct direction", "P25", "signals",
       f"""SELECT *, row_number() OVER (ORDER BY mae, strategy) AS rank, mae/max(mae) OVER ()*1e2 AS bar_pct,
 CASE WHEN bias<-0.5 THEN 'under' WHEN bias>0.5 THEN 'over' ELSE 'neutral' END AS direction FROM ({_QUAL})""")
def _(spark, sf):
    return B.rank_quality(I.imputation_quality(materialise(daily_panel(spark, sf), "daily-panel")))


_FAIR = """SELECT CASE WHEN strategy='none' THEN 'Observed' ELSE 'Latent_'||strategy END AS strategy, avg(abs(signal-true_demand)) AS signal_mae,
 sum(greatest(q-true_demand,0e0)+4e0*greatest(true_demand-q,0e0)) AS total_cost, (1e0-sum(greatest(true_demand-q,0e0))/sum(true_demand))*1e2 AS fill_rate,
 avg(q) AS mean_order, count(*) AS n_eval FROM (SELECT *, greatest(signal+8416212335729143e-16*(stddev_pop(true_demand) OVER (PARTITION BY strategy)), 0e0) AS q FROM signals) GROUP BY 1"""


@query("fair_cost", "strategy ~signal_mae ~total_cost ~fill_rate ~mean_order #n_eval", "A32 E03", "signals", _FAIR, digits=4)
def _(spark, sf):
    return I.fair_cost(materialise(daily_panel(spark, sf), "daily-panel"))


cte("sampled", f"SELECT * FROM daily WHERE series_id IN (SELECT series_id FROM (SELECT DISTINCT series_id FROM daily) ORDER BY {md5_52('series_id', '42')} LIMIT 30)", "daily")
cte("sampled_draws", drawn("sampled", 42), "sampled")
cte("sampled_signals", signals(f"({censored('sampled', 'sampled_draws')})"), "sampled_draws")


@query("fair_cost_sample", "strategy ~signal_mae ~total_cost ~fill_rate #source_panel_series #sampled_series #n_eval", "A33 A32", "sampled_signals",
       f"""SELECT *, (SELECT count(DISTINCT series_id) FROM daily) AS source_panel_series, (SELECT count(DISTINCT series_id) FROM sampled) AS sampled_series
 FROM ({_FAIR.replace("FROM signals", "FROM sampled_signals")})""", digits=4)
def _(spark, sf):
    return I.fair_cost_sample(materialise(daily_panel(spark, sf), "daily-panel"), 30)


_SEEDS = (1, 2, 3, 4)


cte("late_days", """SELECT * FROM daily WHERE date>=(SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date)-1 AS i, count(*) OVER () AS n FROM calendar)
 WHERE i=n-least(n-1, greatest(1, CAST(round_even(n/3e0, 0) AS BIGINT))))""", "daily", "calendar")
for _seed in _SEEDS:
    cte(f"draws_{_seed}", drawn("late_days", _seed), "late_days")


@query("draw_errors", "#seed strategy ~mae #n_eval", "E03 E02 A31", " ".join(f"draws_{s}" for s in _SEEDS),
       " UNION ALL ".join(f"SELECT {s} AS seed, strategy, avg(abs(signal-true_demand)) AS mae, count(*) AS n_eval FROM ({signals('(' + censored('daily', f'draws_{s}') + ')')}) GROUP BY 2"
                          for s in _SEEDS))
def _(spark, sf):
    p = materialise(temporal_masks(daily_panel(spark, sf)), "masked-panel")
    draws = materialise(I.synthetic_censor(p, _SEEDS, mask=F.col("is_validation")), "draws")
    return I.draw_errors(p, draws, ["none", "historical_mean", "clipped_scaling"])


@query("draw_means", "#seed series_id ~clean_mean", "M12 E03 E02", " ".join(f"draws_{s}" for s in _SEEDS),
       " UNION ALL ".join(f"""SELECT {s} AS seed, series_id, coalesce(avg(observed_demand) FILTER (clean), min(overall)) AS clean_mean FROM
 (SELECT *, avg(observed_demand) FILTER (clean) OVER () AS overall FROM (SELECT p.*, d.series_id IS NOT NULL AS hit, stockout_hours=0 AND d.series_id IS NULL AS clean
 FROM daily p LEFT JOIN draws_{s} d ON d.series_id=p.series_id AND d.date=p.date)) GROUP BY series_id HAVING bool_or(hit)""" for s in _SEEDS))
def _(spark, sf):
    p = materialise(temporal_masks(daily_panel(spark, sf)), "masked-panel")
    return I.draw_means(p, materialise(I.synthetic_censor(p, _SEEDS, mask=F.col("is_validation")), "draws"))


@query("strategies_side_by_side", "@date ~observed ~stockout_hours ~historical_mean ~clipped_scaling", "A43", "daily",
       f"""SELECT date, max(observed) AS observed, max(stockout_hours) AS stockout_hours, max(latent_demand_est) FILTER (strategy='historical_mean') AS historical_mean,
 max(latent_demand_est) FILTER (strategy='clipped_scaling') AS clipped_scaling FROM ({_LONG}) WHERE series_id=(SELECT min(series_id) FROM daily) GROUP BY 1""")
def _(spark, sf):
    p = materialise(daily_panel(spark, sf), "daily-panel")
    first = p.agg(F.min("series_id")).first()[0]
    return B.compare_strategies(I.latent_long(p), first, list(I.CLOSED_FORM))


# Recommendations.
_FLAG = """CASE WHEN fold_id=1 THEN 'drift_watch' WHEN q_0_9-q_0_1>=(SELECT quantile_cont(q_0_9-q_0_1, 0.95) FROM costed WHERE q_0_9-q_0_1>0) THEN 'high_uncertainty'
 WHEN order_quantity>=(SELECT quantile_cont(order_quantity, 0.99) FROM costed) THEN 'extreme_order_quantity' END"""
_REC = f"""SELECT *, date AS decision_date, y_pred AS predicted_lead_time_demand, CAST(store_id AS VARCHAR) AS store_text, split_part(series_id, '_', 2) AS product_text,
 'model' AS prediction_source, {_FLAG} AS risk_flag FROM costed"""


@query("reorder_recommendations", "@decision_date series_id @store_id product_id ~predicted_lead_time_demand ~order_quantity prediction_source risk_flag "
       "data_strategy model_name #fold_id ~q_0_1 ~q_0_9", "P13 P14", "costed",
       f"SELECT * REPLACE (store_text AS store_id, product_text AS product_id) FROM ({_REC})")
def _(spark, sf):
    return B.reorder_recommendations(materialise(costed_forecasts(spark, sf), "forecasts"), BusinessConfig(), [1])


@query("exceptions", "@decision_date series_id risk_flag ~order_quantity model_name #fold_id", "P15", "costed",
       f"SELECT * FROM ({_REC}) WHERE risk_flag IS NOT NULL")
def _(spark, sf):
    return B.exceptions(B.reorder_recommendations(materialise(costed_forecasts(spark, sf), "forecasts"), BusinessConfig(), [1]))


@query("alert_rows", "series_id risk_flag severity ~order_quantity", "P24", "costed",
       f"""SELECT *, CASE WHEN regexp_matches(risk_flag, 'extreme|drift') THEN 'critical' ELSE 'warning' END AS severity FROM ({_REC})
 WHERE risk_flag IS NOT NULL AND model_name='rolling_normal' AND data_strategy='Observed' ORDER BY decision_date, series_id, risk_flag LIMIT 20""")
def _(spark, sf):
    rec = B.reorder_recommendations(materialise(costed_forecasts(spark, sf), "forecasts"), BusinessConfig(), [1])
    rec = rec.where((F.col("model_name") == "rolling_normal") & (F.col("data_strategy") == "Observed"))
    return B.alert_rows(B.exceptions(rec), 20)


# Per-series status on the Observed rolling forecasts.
cte("skus", "SELECT * FROM forecasts WHERE model_name='rolling_normal' AND data_strategy='Observed'", "forecasts")
_CONF = """SELECT series_id, count(*) AS observations, avg(abs(r)) AS mae, quantile_cont(abs(r), CAST(1-(1-0.95) AS DOUBLE)) AS width,
 quantile_cont(r, 18e0/22e0) AS cr FROM (SELECT *, y_true-y_pred AS r FROM skus) GROUP BY 1"""


def skus(spark, sf):
    f = forecasts(spark, sf).where((F.col("model_name") == "rolling_normal") & (F.col("data_strategy") == "Observed"))
    return materialise(f.select("series_id", "date", "y_true", "y_pred", "third_category_id"), "skus")


@query("series_conformal", "series_id #observations ~mae ~width ~coverage_pct ~residual_quantile", "A38", "skus",
       f"""SELECT c.series_id, observations, mae, width, cr AS residual_quantile, (SELECT avg(CASE WHEN abs(y_true-y_pred)<=width THEN 1e0 ELSE 0e0 END) FROM skus s
 WHERE s.series_id=c.series_id)*1e2 AS coverage_pct FROM ({_CONF.replace("CAST(1-(1-0.95) AS DOUBLE)", "0.95")}) c""", digits=4)
def _(spark, sf):
    return B.series_conformal(skus(spark, sf))


_COST = """CASE WHEN y_true-{q}>0 THEN (y_true-{q})*18e0 ELSE ({q}-y_true)*4e0 END"""
_Q1, _Q2 = "least(greatest(y_pred+cr,0e0),300e0)", "least(y_pred,300e0)"


@query("what_if_cost", "series_id ~inventory_cost ~delta_vs_naive", "A40", "skus", digits=2,
       sql=f"""SELECT series_id, sum({_COST.format(q=_Q1)}) AS inventory_cost, round(sum({_COST.format(q=_Q1)}),2)-sum({_COST.format(q=_Q2)}) AS delta_vs_naive
 FROM skus JOIN (SELECT series_id, cr FROM ({_CONF})) USING (series_id) GROUP BY 1""")
def _(spark, sf):
    return B.what_if_cost(skus(spark, sf), replace(REPORT_COSTS, global_capacity_units=300.0))


_SKU = f"""SELECT c.series_id, any_value(third_category_id) AS category, round_even(arg_max(y_true, date), 0) AS last_actual,
 round_even(least(greatest(arg_max(y_pred, date)+any_value(cr),0e0),12000e0), 0) AS q_star,
 avg(CASE WHEN abs(y_true-y_pred)<=width THEN 1e0 ELSE 0e0 END)*1e2 AS coverage_pct FROM skus s JOIN ({_CONF.replace("CAST(1-(1-0.95) AS DOUBLE)", "0.95")}) c
 ON s.series_id=c.series_id GROUP BY 1"""


@query("sku_table", "series_id category ~last_actual ~q_star ~coverage_pct status", "A39 P21 E16", "skus", digits=3,
       sql=f"""SELECT * REPLACE (CAST(category AS VARCHAR) AS category), CASE WHEN coverage_pct<92 THEN 'shortage' WHEN coverage_pct>97 THEN 'overstock' ELSE 'ok' END AS status
 FROM ({_SKU})""")
def _(spark, sf):
    return B.sku_table(skus(spark, sf))


@query("sku_filter_sort", "series_id category ~q_star", "P23", "skus", digits=3,
       sql=f"SELECT * REPLACE (CAST(category AS VARCHAR) AS category) FROM ({_SKU}) WHERE (series_id LIKE '%1_2%' OR CAST(category AS VARCHAR) LIKE '%1_2%')".replace("1_2", "11"))
def _(spark, sf):
    return B.sku_filter_sort(B.sku_table(skus(spark, sf), limit=None), search="11", sort="q_star")


@query("sku_kpis", "series_id #observations ~mae ~mae_delta ~q_star ~utilization", "A41 W12", "skus", digits=3,
       sql=f"""SELECT series_id, count(*) AS observations, avg(a) AS mae, avg(a) FILTER (rn>n//2)-avg(a) FILTER (rn<=n//2) AS mae_delta,
 least(greatest(arg_max(y_pred, date)+any_value(cr),0e0),300e0) AS q_star,
 least(1e2, round_even(least(greatest(arg_max(y_pred, date)+any_value(cr),0e0),300e0)/300e0*1e2, 1)) AS utilization FROM (SELECT *, abs(y_true-y_pred) AS a,
 row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM skus JOIN (SELECT series_id, cr FROM ({_CONF})) USING (series_id)) GROUP BY 1""")
def _(spark, sf):
    return B.sku_kpis(skus(spark, sf), replace(REPORT_COSTS, global_capacity_units=300.0))


@query("forecast_chart_rows", "#day label date ~actual ~predicted ~lower ~upper", "A39 A41", "skus",
       f"""SELECT row_number() OVER (ORDER BY date) AS day, strftime(date, '%d/%m') AS label, strftime(date, '%Y-%m-%d') AS date, round_even(y_true, 0) AS actual,
 round_even(y_pred, 0) AS predicted, round_even(greatest(0e0, y_pred-width), 0) AS lower, round_even(y_pred+width, 0) AS upper FROM skus
 JOIN ({_CONF.replace("CAST(1-(1-0.95) AS DOUBLE)", "0.95")}) USING (series_id) WHERE series_id=(SELECT min(series_id) FROM skus)""")
def _(spark, sf):
    s = skus(spark, sf)
    return B.forecast_series(s, s.agg(F.min("series_id")).first()[0])


@query("worst_series", "series_id ~sim_total_cost ~zero_rate ~mae diagnoses", "A37 U02", "decisions", digits=4,
       sql=f"""SELECT series_id, sim_total_cost, zero_rate, mae, CASE WHEN d='' THEN 'accumulated_error' ELSE d END AS diagnoses FROM (SELECT *,
 array_to_string(list_filter(['concept_drift', CASE WHEN zero_rate>0.6 THEN 'high_intermittency' END, CASE WHEN m>0 AND mae/m>0.8 THEN 'low_predictability' END,
 CASE WHEN sl<0.8 THEN 'stockout_risk' END], lambda x: x IS NOT NULL), ',') AS d FROM (SELECT l.series_id, sum(sim_total_cost) AS sim_total_cost,
 avg(CASE WHEN y_true=0 THEN 1e0 ELSE 0e0 END) AS zero_rate, avg(y_true) AS m, avg(abs(y_true-y_pred)) AS mae, avg(CASE WHEN sim_backlog<=0 THEN 1e0 ELSE 0e0 END) AS sl
 FROM ({_LEDGER}) l JOIN decisions d ON d.data_strategy=l.data_strategy AND d.model_name=l.model_name AND d.series_id=l.series_id AND d.fold_id=l.fold_id GROUP BY 1
 ORDER BY 2 DESC, 1 LIMIT 5))""")
def _(spark, sf):
    return B.worst_series(L.simulate_ledger(costed_forecasts(spark, sf)), [1])

