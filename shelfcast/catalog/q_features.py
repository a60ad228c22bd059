"""Queries on features, folds, inference rows and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FeatureConfig, ValidationConfig
from ..models.naive import seasonal_naive
from ..operators import features as X
from ..operators import folds as D
from ..operators.panel import latest_rows, union_all
from ..session import materialise
from .base import cte, query
from .frames import H, daily_panel, forecasts, supplier_sales

CFG = FeatureConfig(lags=(1, 7, 14), rolling_windows=(7, 28), include_weather_lags=False)
NAMES = ["day_of_week", "day_of_month", "month", "week_of_year", "is_weekend", "demand_lag_1", "demand_lag_7",
         "demand_lag_14", *[f"demand_roll_{k}_{w}" for w in (7, 28) for k in ("mean", "sum", "std")],
         "discount_lag_1", "discount_lag_7", "discount_lag_14", "stockout_lag_1", "stockout_lag_7", "stockout_lag_14",
         "stockout_roll_mean_7", "stockout_roll_mean_28"]


def _roll(c: str, w: int, fn: str, win: str) -> str:
    return f"CASE WHEN count({c}) OVER {win}={w} THEN {fn}({c}) OVER {win} END"


def feature_sql(source: str, target: bool = True) -> str:
    cols = ["isodow(date)-1 AS day_of_week", "day(date) AS day_of_month", "month(date) AS month",
            "week(date) AS week_of_year", "CASE WHEN isodow(date)>=6 THEN 1 ELSE 0 END AS is_weekend"]
    for src, pre in (("observed_demand", "demand"), ("discount", "discount"), ("stockout_hours", "stockout")):
        cols += [f"lag({src}, {k}) OVER w AS {pre}_lag_{k}" for k in (1, 7, 14)]
    for w in (7, 28):
        for tag, fn in (("mean", "avg"), ("sum", "sum"), ("std", "stddev_samp")):
            cols.append(f"{_roll('observed_demand', w, fn, f'r{w}')} AS demand_roll_{tag}_{w}")
        cols.append(f"{_roll('stockout_hours', w, 'avg', f'r{w}')} AS stockout_roll_mean_{w}")
    if target:
        cols.append(f"{_roll('observed_demand', 7, 'sum', 'n7')} AS target_lead_time_demand")
    part = "PARTITION BY series_id ORDER BY date"
    return f"""SELECT *, {', '.join(cols)} FROM {source} WINDOW w AS ({part}), r7 AS ({part} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
 r28 AS ({part} ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), n7 AS ({part} ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)"""


WHOLE = " AND ".join(f"{n} IS NOT NULL" for n in NAMES)
cte("features", feature_sql("sales"), "sales")
cte("supervised", f"SELECT * FROM features WHERE target_lead_time_demand IS NOT NULL AND {WHOLE}", "features")
FEATURE_SPEC = " ".join(("#" if i < 5 else "~") + n for i, n in enumerate(NAMES))


@query("feature_frame", f"series_id @date {FEATURE_SPEC}", "W01 W02 P19", "features", "SELECT * FROM features")
def _(spark, sf):
    return X.feature_frame(supplier_sales(spark, sf), CFG)[0]


@query("weather_lags", "series_id @date " + " ".join(f"~{c}_lag_{k}" for c in X.WEATHER for k in (1, 28)), "W01", "panel",
       "SELECT *, " + ", ".join(f"lag({c}, {k}) OVER (PARTITION BY series_id ORDER BY date) AS {c}_lag_{k}"
                                for c in X.WEATHER for k in (1, 28)) + " FROM panel")
def _(spark, sf):
    from .frames import supplier_panel
    return X.feature_frame(supplier_panel(spark, sf), FeatureConfig(lags=(1, 28), rolling_windows=(7,)))[0]


@query("lead_time_target", "series_id @date ~target_lead_time_demand", "W03", "features", "SELECT * FROM features")
def _(spark, sf):
    s = supplier_sales(spark, sf)
    return s.withColumn("target_lead_time_demand", X.lead_time_target("observed_demand", H))


@query("supervised_frame", f"series_id @date ~observed_demand {FEATURE_SPEC} ~target_lead_time_demand", "E05 P18 P19 P20 W01 W02 W03",
       "supervised", "SELECT * FROM supervised")
def _(spark, sf):
    return X.supervised_frame(supplier_sales(spark, sf), CFG, H)[0]


@query("incomplete_row_counts", "#input_rows #dropped_rows_missing_target #dropped_rows_missing_features #output_rows", "P20",
       "features", f"""SELECT count(*) AS input_rows, count(*) FILTER (target_lead_time_demand IS NULL) AS dropped_rows_missing_target,
 count(*) FILTER (target_lead_time_demand IS NOT NULL AND NOT ({WHOLE})) AS dropped_rows_missing_features,
 count(*) FILTER (target_lead_time_demand IS NOT NULL AND ({WHOLE})) AS output_rows FROM features""")
def _(spark, sf):
    frame, names = X.feature_frame(supplier_sales(spark, sf), CFG, H)
    has, whole = F.col("target_lead_time_demand").isNotNull(), X.all_present(names)
    return frame.agg(F.count(F.lit(1)).alias("input_rows"), F.count_if(~has).alias("dropped_rows_missing_target"),
                     F.count_if(has & ~whole).alias("dropped_rows_missing_features"),
                     F.count_if(has & whole).alias("output_rows"))


@query("inference_frame", f"series_id @date {FEATURE_SPEC}", "E06 W07", "features",
       f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn FROM features
 WHERE {WHOLE}) WHERE rn=1""")
def _(spark, sf):
    return X.inference_frame(supplier_sales(spark, sf), CFG)[0]


@query("last_rows_per_series", "series_id @date ~observed_demand", "W08", "sales",
       "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn FROM sales) WHERE rn<=14")
def _(spark, sf):
    return latest_rows(supplier_sales(spark, sf), 14)


# Sales in which some series, products and categories have no known demand, and some a short history.
cte("patchy", """SELECT * REPLACE (product_id % 20 AS product_id, product_id % 5 AS third_category_id,
 CASE WHEN product_id % 2 = 0 OR product_id % 20 IN (7, 9) OR product_id % 5 = 1 THEN NULL ELSE observed_demand END AS observed_demand)
 FROM sales WHERE product_id % 3 > 0 OR date < DATE '1995-02-20'""", "sales")


def patchy(spark, sf):
    k = F.col("product_id")
    s = supplier_sales(spark, sf).where((k % 3 > 0) | (F.col("date") < "1995-02-20"))
    gone = (k % 2 == 0) | (k % 20).isin(7, 9) | (k % 5 == 1)
    return s.withColumn("observed_demand", F.when(~gone, F.col("observed_demand"))).withColumns(
        {"product_id": k % 20, "third_category_id": k % 5})


_MEANS = """LEFT JOIN (SELECT series_id, avg(observed_demand) AS ms FROM patchy GROUP BY 1) a USING (series_id)
 LEFT JOIN (SELECT product_id, avg(observed_demand) AS mp FROM patchy GROUP BY 1) b USING (product_id)
 LEFT JOIN (SELECT third_category_id, avg(observed_demand) AS mt FROM patchy GROUP BY 1) c USING (third_category_id)
 CROSS JOIN (SELECT avg(observed_demand) AS mg FROM patchy) g"""
_LEVEL = """CASE WHEN ms IS NOT NULL THEN 'series' WHEN mp IS NOT NULL THEN 'product' WHEN mt IS NOT NULL THEN 'third_category'
 ELSE 'global' END"""
_ROUTED = f"""SELECT *, CASE WHEN {WHOLE} THEN 'model' ELSE 'cold_start_fallback' END AS prediction_source,
 CASE WHEN NOT ({WHOLE}) THEN {_LEVEL} END AS fallback_level,
 CASE WHEN NOT ({WHOLE}) THEN coalesce(ms, mp, mt, mg)*7e0 END AS fallback_target_lead_time_demand FROM
 (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn FROM ({feature_sql('patchy', False)})) WHERE rn=1) {_MEANS}"""


@query("inference_with_fallback", "series_id @date prediction_source fallback_level ~fallback_target_lead_time_demand",
       "E07 J03 A28", "patchy", _ROUTED)
def _(spark, sf):
    return X.inference_with_fallback(materialise(patchy(spark, sf), "patchy"), CFG, H)[0]


@query("fallback_counts", "#output_rows #model_rows #cold_start_rows #fallback_rows_series #fallback_rows_product "
       "#fallback_rows_third_category #fallback_rows_global", "A29 E07", "patchy",
       f"""SELECT count(*) AS output_rows, count(*) FILTER (prediction_source='model') AS model_rows,
 count(*) FILTER (prediction_source<>'model') AS cold_start_rows, count(*) FILTER (fallback_level='series') AS fallback_rows_series,
 count(*) FILTER (fallback_level='product') AS fallback_rows_product, count(*) FILTER (fallback_level='third_category') AS fallback_rows_third_category,
 count(*) FILTER (fallback_level='global') AS fallback_rows_global FROM ({_ROUTED})""")
def _(spark, sf):
    return X.fallback_counts(X.inference_with_fallback(materialise(patchy(spark, sf), "patchy"), CFG, H)[0])


@query("hierarchical_means", "level key ~mean", "A28", "patchy",
       """SELECT 'series' AS level, series_id AS key, avg(observed_demand) AS mean FROM patchy GROUP BY 2
 UNION ALL SELECT 'product', CAST(product_id AS VARCHAR), avg(observed_demand) FROM patchy GROUP BY 2
 UNION ALL SELECT 'third_category', CAST(third_category_id AS VARCHAR), avg(observed_demand) FROM patchy GROUP BY 2
 UNION ALL SELECT 'global', 'all', avg(observed_demand) FROM patchy""")
def _(spark, sf):
    means = X.hierarchical_means(materialise(patchy(spark, sf), "patchy"))
    out = [df.select(F.lit(k).alias("level"), (F.col(df.columns[0]).cast("string") if k != "global" else F.lit("all"))
                     .alias("key"), F.col(f"mean_{k}").alias("mean")) for k, df in means.items()]
    return union_all(*out)


_HOLD = "DATE '1998-06-15'"


@query("holdout_frame", f"series_id @date {FEATURE_SPEC} ~target_lead_time_demand", "E08 U01 J08", "daily",
       f"SELECT * FROM ({feature_sql('daily')}) WHERE date>={_HOLD} AND target_lead_time_demand IS NOT NULL AND {WHOLE}")
def _(spark, sf):
    p = materialise(daily_panel(spark, sf), "daily-panel")
    return X.holdout_frame(p.where(F.col("date") < "1998-06-15"), p.where(F.col("date") >= "1998-06-15"), CFG, H)


cte("ordinals", """SELECT date, row_number() OVER (ORDER BY date)-1 AS i, count(*) OVER () AS n FROM
 (SELECT DISTINCT date FROM sales)""", "sales")
_FOLD_SQL = """SELECT f AS fold_id, 7 AS horizon, a.date - 7 AS train_end_date, a.date AS validation_start_date, b.date AS validation_end_date
 FROM range(5) r(f) JOIN ordinals a ON a.i=200+f*14 JOIN ordinals b ON b.i=200+f*14+13 WHERE b.i<=b.n-7"""
_FOLD_CFG = ValidationConfig(initial_train_days=200, n_folds=5, fold_size_days=14)


@query("walk_forward_folds", "#fold_id #horizon @train_end_date @validation_start_date @validation_end_date", "E01 U04 W13",
       "ordinals", _FOLD_SQL)
def _(spark, sf):
    return D.folds_frame(spark, D.walk_forward_folds(D.distinct_dates(supplier_sales(spark, sf)), _FOLD_CFG, H))


@query("validation_rows", "series_id @date #fold_id ~observed_demand", "J13 E01", "ordinals",
       f"SELECT s.*, f.fold_id FROM sales s JOIN ({_FOLD_SQL}) f ON s.date BETWEEN f.validation_start_date AND f.validation_end_date")
def _(spark, sf):
    s = materialise(supplier_sales(spark, sf), "sales")
    return D.assign_validation(s, D.walk_forward_folds(D.distinct_dates(s), _FOLD_CFG, H))


@query("fold_counts", "#fold_id #train_rows #validation_rows #train_series #validation_series", "A42 J13", "ordinals",
       f"""SELECT fold_id, count(*) FILTER (date<=train_end_date) AS train_rows,
 count(*) FILTER (date BETWEEN validation_start_date AND validation_end_date) AS validation_rows,
 count(DISTINCT series_id) FILTER (date<=train_end_date) AS train_series,
 count(DISTINCT series_id) FILTER (date BETWEEN validation_start_date AND validation_end_date) AS validation_series
 FROM sales CROSS JOIN ({_FOLD_SQL}) GROUP BY 1""")
def _(spark, sf):
    s = materialise(supplier_sales(spark, sf), "sales")
    return D.fold_counts(s, D.walk_forward_folds(D.distinct_dates(s), _FOLD_CFG, H))


@query("temporal_masks", "series_id @date #is_validation", "E02 W13", "ordinals",
       """SELECT series_id, date, date>=(SELECT date FROM ordinals WHERE i=n-least(n-1, greatest(1,
 CAST(round_even(n/3e0, 0) AS BIGINT)))) AS is_validation FROM sales""")
def _(spark, sf):
    return D.temporal_masks(materialise(supplier_sales(spark, sf), "sales"))


@query("calibration_split", "part #rows @first_date @last_date", "E04", "supervised",
       """SELECT part, count(*) AS rows, min(date) AS first_date, max(date) AS last_date FROM (SELECT date, CASE
 WHEN date<=(SELECT max(date) FROM supervised)-28 THEN 'train' WHEN date>(SELECT max(date) FROM supervised)-21 THEN 'calibration' END AS part
 FROM supervised) WHERE part IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    frame = materialise(X.supervised_frame(supplier_sales(spark, sf), CFG, H)[0].select("date"), "dates")
    a, b = D.calibration_split(frame, 21, 7)
    rows = union_all(a.select("date", F.lit("train").alias("part")), b.select("date", F.lit("calibration").alias("part")))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"),
                                    F.max("date").alias("last_date"))


def naive_sql(h: int, p: int) -> str:
    steps = [-(-(j + 1) // p) * p - j for j in range(h)]
    lags = " UNION ALL ".join(f"SELECT {j} AS j, {lag} AS lag" for j, lag in enumerate(steps))
    return f"""SELECT s.series_id, s.date, CASE WHEN count(b.observed_demand)={h} THEN greatest(sum(b.observed_demand), 0e0) END AS naive
 FROM sales s CROSS JOIN ({lags}) l LEFT JOIN sales b ON b.series_id=s.series_id AND b.date=s.date-l.lag GROUP BY 1, 2"""


@query("seasonal_naive", "series_id @date ~naive", "M01 J10", "sales", naive_sql(2, 3))
def _(spark, sf):
    return seasonal_naive(supplier_sales(spark, sf), 2, 3)


@query("seasonal_naive_long_horizon", "series_id @date ~naive", "M01 J10", "daily",
       naive_sql(10, 7).replace("FROM sales", "FROM daily").replace("JOIN sales", "JOIN daily"))
def _(spark, sf):
    return seasonal_naive(daily_panel(spark, sf), 10, 7)


def _decision_dates(spark, sf):
    days = D.distinct_dates(supplier_sales(spark, sf))
    return days[300::120]


_DATES = "(SELECT date AS d FROM ordinals WHERE i>=300 AND (i-300)%120=0)"


@query("rows_as_of", "@decision_date series_id @date ~observed_demand", "J12", "ordinals",
       f"""SELECT d AS decision_date, series_id, max(date) AS date, arg_max(observed_demand, date) AS observed_demand
 FROM {_DATES} JOIN sales ON date<=d GROUP BY 1, 2""")
def _(spark, sf):
    return X.rows_as_of(supplier_sales(spark, sf), _decision_dates(spark, sf))


@query("revealed_actuals", "@decision_date series_id ~y_true #actuals_days_observed", "J11 J05", "ordinals",
       f"""SELECT d AS decision_date, series_id, sum(observed_demand) AS y_true, count(*) AS actuals_days_observed
 FROM {_DATES} JOIN sales ON date>=d AND date<d+30 GROUP BY 1, 2""")
def _(spark, sf):
    return X.reveal_actuals(supplier_sales(spark, sf), _decision_dates(spark, sf), 30)


@query("expanding_fallback", "@decision_date series_id fallback_level ~fallback_target_lead_time_demand", "J03 J12 A28",
       "ordinals patchy", f"""SELECT x.d AS decision_date, x.series_id AS series_id, {_LEVEL} AS fallback_level,
 coalesce(ms, mp, mt, mg)*7e0 AS fallback_target_lead_time_demand FROM
 (SELECT d, series_id, arg_max(product_id, date) AS product_id, arg_max(third_category_id, date) AS third_category_id FROM {_DATES} JOIN patchy ON date<=d GROUP BY 1, 2) x
 LEFT JOIN (SELECT d, series_id, avg(observed_demand) AS ms FROM {_DATES} JOIN patchy ON date<=d GROUP BY 1, 2) a ON a.d=x.d AND a.series_id=x.series_id
 LEFT JOIN (SELECT d, product_id, avg(observed_demand) AS mp FROM {_DATES} JOIN patchy ON date<=d GROUP BY 1, 2) b ON b.d=x.d AND b.product_id=x.product_id
 LEFT JOIN (SELECT d, third_category_id, avg(observed_demand) AS mt FROM {_DATES} JOIN patchy ON date<=d GROUP BY 1, 2) c ON c.d=x.d AND c.third_category_id=x.third_category_id
 LEFT JOIN (SELECT d, avg(observed_demand) AS mg FROM {_DATES} JOIN patchy ON date<=d GROUP BY 1) g ON g.d=x.d""")
def _(spark, sf):
    p, days = materialise(patchy(spark, sf), "patchy"), _decision_dates(spark, sf)
    return X.expanding_fallback(X.rows_as_of(p, days), p, days, H)


@query("forecast_origins", "data_strategy model_name series_id @date #fold_id ~y_true ~y_pred ~q_0_1 ~q_0_5 ~q_0_9",
       "M14 P12 J13 E18 U01", "forecasts", "SELECT * FROM forecasts")
def _(spark, sf):
    return forecasts(spark, sf)


