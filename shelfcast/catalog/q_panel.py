"""Queries on the raw split, the prepared panel and its profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DatasetConfig, QualityConfig
from ..operators import panel as P
from ..operators import profile as R
from ..operators import quality as Q
from ..operators import regimes as G
from ..operators.folds import run_description
from ..session import materialise
from .base import query
from .frames import daily_panel, supplier_panel, supplier_sales

stored = materialise  # operators that read their input more than once are given a stored panel

RAW = ("#city_id #store_id #management_group_id #first_category_id #second_category_id #third_category_id #product_id "
       "@date ~observed_demand ~stockout_hours ~discount #holiday_flag #activity_flag ~precpt ~avg_temperature "
       "~avg_humidity ~avg_wind_level")


@query("scan_raw_split", RAW + " series_id", "S01 P01 P05", "sales", "SELECT * FROM sales")
def _(spark, sf):
    return supplier_sales(spark, sf)


@query("prepared_panel", RAW + " series_id", "S02 P03 P04 P06 W04 A01 L01", "panel", "SELECT * FROM panel")
def _(spark, sf):
    return supplier_panel(spark, sf)


_EDGE = """SELECT store_id, product_id, date, observed_demand, stockout_hours, discount FROM sales
 UNION ALL SELECT store_id, product_id, date, observed_demand+1, stockout_hours, discount FROM sales WHERE day(date)=3
 UNION ALL SELECT store_id, product_id, date, -observed_demand, stockout_hours, discount FROM sales WHERE day(date)=4"""


def edge_sales(spark, sf):
    """Sales with repeated keys on day 3 and negative rows on day 4."""
    cols = ["store_id", "product_id", "date", "observed_demand", "stockout_hours", "discount"]
    s = supplier_sales(spark, sf).select(*cols)
    up = s.where(F.dayofmonth("date") == 3).withColumn("observed_demand", F.col("observed_demand") + 1)
    neg = s.where(F.dayofmonth("date") == 4).withColumn("observed_demand", -F.col("observed_demand"))
    return P.union_all(s, up, neg)


@query("dedupe_and_drop_negative", "#store_id #product_id @date ~observed_demand ~stockout_hours ~discount series_id",
       "P03 P04 P05 U01", "sales",
       f"""SELECT *, CAST(store_id AS VARCHAR)||'_'||CAST(product_id AS VARCHAR) AS series_id FROM (SELECT *,
 row_number() OVER (PARTITION BY store_id, product_id, date ORDER BY observed_demand, stockout_hours, discount) AS rn
 FROM ({_EDGE}) e WHERE observed_demand>=0) WHERE rn=1""")
def _(spark, sf):
    return P.series_key(P.dedupe_key(P.drop_negative_sales(edge_sales(spark, sf))))


@query("row_cap", "#store_id #product_id @date ~observed_demand", "P02", "sales",
       """SELECT * FROM (SELECT *, row_number() OVER (ORDER BY store_id, product_id, date) AS rn FROM sales)
 WHERE rn<=(SELECT count(*) FROM sales)*2//3""")
def _(spark, sf):
    s = stored(supplier_sales(spark, sf))
    return P.row_cap(s, s.count() * 2 // 3)


@query("fill_defaults", "series_id @date ~discount ~precpt ~stockout_hours #holiday_flag #activity_flag", "P06", "sales",
       """SELECT *, coalesce(CASE WHEN discount<0.93 THEN NULL ELSE discount END, CAST(1 AS DOUBLE)) AS d2,
 least(greatest(coalesce(CASE WHEN stockout_hours=4 THEN NULL WHEN stockout_hours=8 THEN 17e0 ELSE stockout_hours END, 0e0),0e0),16e0) AS s2,
 coalesce(precpt, 0e0) AS p2 FROM sales""".replace("SELECT *,", "SELECT series_id, date, holiday_flag, activity_flag,")
       .replace("AS d2", "AS discount").replace("AS s2", "AS stockout_hours").replace("AS p2", "AS precpt"))
def _(spark, sf):
    s = supplier_sales(spark, sf)
    return P.fill_defaults(s.withColumns({
        "discount": F.when(F.col("discount") >= 0.93, F.col("discount")),
        "stockout_hours": F.when(F.col("stockout_hours") == 8, F.lit(17.0)).when(F.col("stockout_hours") != 4,
                                                                                F.col("stockout_hours"))}))


@query("weather_fill", "series_id @date ~avg_temperature ~avg_humidity", "W04", "sales",
       """SELECT series_id, date, coalesce(last_value(t IGNORE NULLS) OVER p, first_value(t IGNORE NULLS) OVER n,
 (SELECT quantile_cont(f, 0.5) FROM (SELECT coalesce(last_value(t IGNORE NULLS) OVER p, first_value(t IGNORE NULLS) OVER n) AS f
 FROM (SELECT *, CASE WHEN product_id % 10 = 0 THEN NULL ELSE avg_temperature END AS t FROM sales)
 WINDOW p AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 n AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))) AS avg_temperature, avg_humidity
 FROM (SELECT *, CASE WHEN product_id % 10 = 0 THEN NULL ELSE avg_temperature END AS t FROM sales)
 WINDOW p AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 n AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def _(spark, sf):
    s = supplier_sales(spark, sf)
    return P.weather_fill(s.withColumn("avg_temperature", F.when(F.col("product_id") % 10 != 0, F.col("avg_temperature"))))


@query("top_series", "series_id ~demand_total", "L03", "sales",
       """SELECT series_id, sum(observed_demand) AS demand_total FROM sales GROUP BY 1
 ORDER BY demand_total DESC, series_id LIMIT 25""")
def _(spark, sf):
    return P.top_series(supplier_sales(spark, sf), 25)


@query("inherited_series", "series_id @date ~observed_demand", "J08 S02", "sales",
       """SELECT * FROM sales WHERE date>=DATE '2000-01-01' AND series_id IN (SELECT series_id FROM sales
 WHERE date<DATE '2000-01-01' GROUP BY 1 HAVING count(*)>=350)""")
def _(spark, sf):
    s = supplier_sales(spark, sf)
    train = P.min_history(s.where(F.col("date") < "2000-01-01"), 350)
    return P.semi_filter(s.where(F.col("date") >= "2000-01-01"), train, ["series_id"])


@query("excluded_series", "series_id @date ~observed_demand", "J09 L03", "sales",
       """SELECT * FROM sales WHERE series_id NOT IN (SELECT series_id FROM (SELECT series_id, sum(observed_demand) AS t
 FROM sales GROUP BY 1 ORDER BY t DESC, series_id LIMIT 50))""")
def _(spark, sf):
    s = supplier_sales(spark, sf)
    return P.anti_filter(s, P.top_series(s, 50), ["series_id"])


@query("carved_split", "series_id @date ~observed_demand part", "S04 W13 L03", "daily",
       """SELECT series_id, date, observed_demand, CASE WHEN date < (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date)-1 AS o
 FROM (SELECT DISTINCT date FROM daily)) WHERE o=120) THEN 'train' ELSE 'eval' END AS part FROM daily WHERE series_id IN
 (SELECT series_id FROM (SELECT series_id, sum(observed_demand) AS t FROM daily GROUP BY 1 ORDER BY t DESC, series_id LIMIT 20))""")
def _(spark, sf):
    a, b = P.carve_split(stored(daily_panel(spark, sf)), 20, 120)
    return P.union_all(a.withColumn("part", F.lit("train")), b.withColumn("part", F.lit("eval")))


@query("densified_panel", "series_id @date ~observed_demand ~stockout_hours ~discount ~holiday_flag #third_category_id",
       "P05 J08", "daily", "SELECT * FROM daily")
def _(spark, sf):
    return daily_panel(spark, sf)


@query("date_ordinals", "@date #ordinal", "W13 U04", "sales",
       "SELECT date, row_number() OVER (ORDER BY date)-1 AS ordinal FROM (SELECT DISTINCT date FROM sales)")
def _(spark, sf):
    return P.date_ordinals(supplier_sales(spark, sf))


@query("regime_labels", "series_id @date stockout_regime velocity_regime promo_regime seasonal_regime",
       "P07 P08 P09 P10 P11 W05", "sales",
       """SELECT *, CASE WHEN stockout_hours>1 THEN 'high_stockout' ELSE 'low_stockout' END AS stockout_regime,
 CASE WHEN avg(observed_demand) OVER (PARTITION BY series_id)>=28 THEN 'fast_moving' ELSE 'slow_moving' END AS velocity_regime,
 CASE WHEN coalesce(discount,0)>0 THEN 'on_promotion' ELSE 'baseline_price' END AS promo_regime,
 CASE WHEN coalesce(holiday_flag,0)>0 THEN 'peak_holiday' ELSE 'standard_season' END AS seasonal_regime FROM sales""")
def _(spark, sf):
    return G.label_all_regimes(supplier_sales(spark, sf), velocity_threshold=28.0)


@query("stockout_regime_by_median", "series_id @date stockout_regime", "P07", "sales",
       """SELECT *, CASE WHEN stockout_hours>(SELECT median(stockout_hours) FROM sales) THEN 'high_stockout'
 ELSE 'low_stockout' END AS stockout_regime FROM sales""")
def _(spark, sf):
    return G.label_stockout_regime(stored(supplier_sales(spark, sf)), None)


@query("dataset_summary", "#rows #unique_series @date_min @date_max ~observed_demand_sum ~observed_demand_mean "
       "~observed_demand_std ~zero_demand_rate ~stockout_day_rate ~mean_stockout_hours ~median_history_days "
       "#min_history_days #max_history_days", "A02", "daily",
       """SELECT count(*) AS rows, count(DISTINCT series_id) AS unique_series, min(date) AS date_min, max(date) AS date_max,
 sum(observed_demand) AS observed_demand_sum, avg(observed_demand) AS observed_demand_mean, stddev_pop(observed_demand) AS observed_demand_std,
 avg(CASE WHEN observed_demand=0 THEN 1e0 ELSE 0e0 END) AS zero_demand_rate,
 avg(CASE WHEN stockout_hours>0 THEN 1e0 ELSE 0e0 END) AS stockout_day_rate, avg(stockout_hours) AS mean_stockout_hours,
 (SELECT median(n) FROM h) AS median_history_days, (SELECT min(n) FROM h) AS min_history_days, (SELECT max(n) FROM h) AS max_history_days
 FROM daily""".replace("FROM h)", "FROM (SELECT count(DISTINCT date) AS n FROM daily GROUP BY series_id))"))
def _(spark, sf):
    return R.dataset_summary(stored(daily_panel(spark, sf)))


_MISS = ["series_id", "date", "observed_demand", "stockout_hours", "precpt", "avg_temperature", "holiday_flag"]


@query("missingness_summary", "column_name #null_count ~null_rate #n_unique", "A03 L02", "sales",
       " UNION ALL ".join(f"""SELECT '{c}' AS column_name, count(*)-count({c}) AS null_count,
 (count(*)-count({c}))/CAST(count(*) AS DOUBLE) AS null_rate, count(DISTINCT {c}) AS n_unique FROM sales""" for c in _MISS))
def _(spark, sf):
    return R.missingness_summary(supplier_sales(spark, sf).select(*_MISS))


_SERIES = """SELECT series_id, min(date) AS start_date, max(date) AS end_date, count(DISTINCT date) AS history_days,
 coalesce(sum(observed_demand), 0e0) AS observed_demand_sum, avg(observed_demand) AS observed_demand_mean,
 coalesce(stddev_samp(observed_demand), 0e0) AS observed_demand_std,
 avg(CASE WHEN observed_demand=0 THEN 1e0 ELSE 0e0 END) AS zero_demand_rate,
 avg(CASE WHEN stockout_hours>0 THEN 1e0 ELSE 0e0 END) AS stockout_day_rate,
 avg(stockout_hours) AS mean_stockout_hours FROM daily GROUP BY 1"""


@query("series_summary", "series_id @start_date @end_date #history_days ~observed_demand_sum ~observed_demand_mean "
       "~observed_demand_std ~zero_demand_rate ~stockout_day_rate ~mean_stockout_hours", "A04 L02", "daily", _SERIES)
def _(spark, sf):
    return R.series_summary(daily_panel(spark, sf))


_NUM = ["observed_demand", "stockout_hours", "discount", "precpt", "avg_temperature", "avg_humidity"]


@query("numeric_summary", "column_name #count ~mean ~std ~min ~p25 ~median ~p75 ~max", "A05", "sales",
       " UNION ALL ".join(f"""SELECT '{c}' AS column_name, count({c}) AS "count", avg({c}) AS mean, stddev_samp({c}) AS std,
 min({c}) AS "min", quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS "median", quantile_cont({c}, 0.75) AS p75,
 max({c}) AS "max" FROM sales""" for c in _NUM))
def _(spark, sf):
    return R.numeric_summary(stored(supplier_sales(spark, sf).select(*_NUM)))


@query("temporal_summary", "@date_min @date_max #date_span_days #observed_rows #expected_rows_full_grid "
       "~coverage_rate_full_grid #duplicate_series_date_rows", "A06", "sales",
       """SELECT min(date) AS date_min, max(date) AS date_max, max(date)-min(date)+1 AS date_span_days, count(*) AS observed_rows,
 (max(date)-min(date)+1)*count(DISTINCT series_id) AS expected_rows_full_grid,
 count(*)/CAST((max(date)-min(date)+1)*count(DISTINCT series_id) AS DOUBLE) AS coverage_rate_full_grid,
 count(*)-(SELECT count(*) FROM (SELECT DISTINCT series_id, date FROM sales)) AS duplicate_series_date_rows FROM sales""")
def _(spark, sf):
    return R.temporal_summary(supplier_sales(spark, sf))


@query("weekday_summary", "#weekday weekday_name #observations ~observed_demand_mean ~observed_demand_median "
       "~stockout_day_rate ~mean_stockout_hours", "A07", "sales",
       """SELECT isodow(date)-1 AS weekday, dayname(date) AS weekday_name, count(*) AS observations,
 avg(observed_demand) AS observed_demand_mean, median(observed_demand) AS observed_demand_median,
 avg(CASE WHEN stockout_hours>0 THEN 1e0 ELSE 0e0 END) AS stockout_day_rate, avg(stockout_hours) AS mean_stockout_hours
 FROM sales GROUP BY 1, 2""")
def _(spark, sf):
    return R.weekday_summary(stored(supplier_sales(spark, sf).select("date", "observed_demand", "stockout_hours")))


@query("series_gap_summary", "series_id #history_days @start_date @end_date #max_gap_days #missing_days_within_span",
       "A08 L02", "sales",
       """SELECT series_id, count(DISTINCT date) AS history_days, min(date) AS start_date, max(date) AS end_date,
 coalesce(max(g),1) AS max_gap_days, coalesce(sum(greatest(g-1,0)),0) AS missing_days_within_span FROM
 (SELECT *, date - lag(date) OVER (PARTITION BY series_id ORDER BY date) AS g FROM sales) GROUP BY 1""")
def _(spark, sf):
    return R.series_gap_summary(supplier_sales(spark, sf))


@query("stockout_summary", "#stockout_rows ~stockout_row_rate ~mean_stockout_hours_all_rows "
       "~mean_stockout_hours_stockout_rows ~zero_demand_rate_stockout_rows ~zero_demand_rate_non_stockout_rows", "A09",
       "daily", """SELECT count(*) FILTER (stockout_hours>0) AS stockout_rows, avg(CASE WHEN stockout_hours>0 THEN 1e0 ELSE 0e0 END) AS stockout_row_rate,
 avg(stockout_hours) AS mean_stockout_hours_all_rows, coalesce(avg(stockout_hours) FILTER (stockout_hours>0),0e0) AS mean_stockout_hours_stockout_rows,
 coalesce(avg(CASE WHEN observed_demand=0 THEN 1e0 ELSE 0e0 END) FILTER (stockout_hours>0),0e0) AS zero_demand_rate_stockout_rows,
 coalesce(avg(CASE WHEN observed_demand=0 THEN 1e0 ELSE 0e0 END) FILTER (NOT stockout_hours>0),0e0) AS zero_demand_rate_non_stockout_rows FROM daily""")
def _(spark, sf):
    return R.stockout_summary(daily_panel(spark, sf))


@query("stockout_by_series", "series_id #observations #stockout_days ~stockout_day_rate ~mean_stockout_hours "
       "~max_stockout_hours ~observed_demand_mean", "A10", "sales",
       """SELECT series_id, count(*) AS observations, count(*) FILTER (stockout_hours>0) AS stockout_days,
 avg(CASE WHEN stockout_hours>0 THEN 1e0 ELSE 0e0 END) AS stockout_day_rate, avg(stockout_hours) AS mean_stockout_hours,
 max(stockout_hours) AS max_stockout_hours, avg(observed_demand) AS observed_demand_mean FROM sales GROUP BY 1""")
def _(spark, sf):
    return R.stockout_by_series(supplier_sales(spark, sf))


@query("stockout_bands", "stockout_band #observations ~observed_demand_mean ~observed_demand_median ~stockout_hours_mean",
       "A11", "sales", """SELECT b AS stockout_band, coalesce(observations,0) AS observations, observed_demand_mean, observed_demand_median,
 stockout_hours_mean FROM (VALUES ('0'),('0-2'),('3-6'),('7+')) v(b) LEFT JOIN (SELECT CASE WHEN stockout_hours<=0 THEN '0'
 WHEN stockout_hours<=2 THEN '0-2' WHEN stockout_hours<=6 THEN '3-6' ELSE '7+' END AS k, count(*) AS observations,
 avg(observed_demand) AS observed_demand_mean, median(observed_demand) AS observed_demand_median,
 avg(stockout_hours) AS stockout_hours_mean FROM sales GROUP BY 1) ON b=k""")
def _(spark, sf):
    return R.stockout_bands(stored(supplier_sales(spark, sf).select("observed_demand", "stockout_hours")))


@query("correlation_summary", "feature_name ~correlation_with_observed_demand ~absolute_correlation", "A12", "sales",
       " UNION ALL ".join(f"""SELECT '{c}' AS feature_name, corr({c}, observed_demand) AS correlation_with_observed_demand,
 abs(corr({c}, observed_demand)) AS absolute_correlation FROM sales""" for c in _NUM[1:]))
def _(spark, sf):
    return R.correlation_summary(supplier_sales(spark, sf).select(*_NUM))


_PAIRS = ["observed_demand", "stockout_hours", "discount", "precpt"]


@query("correlation_matrix", "feature_a feature_b ~correlation", "A12", "sales",
       " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, " + ("1e0" if a == b else
                          f"corr({min(a, b)}, {max(a, b)})") + " AS correlation FROM sales"
                          for a in _PAIRS for b in _PAIRS if a != b)
       + " UNION ALL SELECT c, c, 1e0 FROM (VALUES " + ",".join(f"('{c}')" for c in _PAIRS) + ") v(c)")
def _(spark, sf):
    return R.correlation_matrix(supplier_sales(spark, sf), _PAIRS)


@query("config_alignment", "#configured_top_n_series #actual_unique_series #top_n_series_matches_config "
       "#configured_min_history_days #actual_min_history_days #min_history_matches_config", "A13", "sales",
       """SELECT 100 AS configured_top_n_series, count(*) AS actual_unique_series, count(*)<=100 AS top_n_series_matches_config,
 70 AS configured_min_history_days, min(n) AS actual_min_history_days, min(n)>=70 AS min_history_matches_config
 FROM (SELECT count(DISTINCT date) AS n FROM sales GROUP BY series_id)""")
def _(spark, sf):
    return Q.config_alignment(supplier_sales(spark, sf), DatasetConfig(top_n_series=100))


@query("demand_acf", "#lag ~acf ~band", "A14", "daily",
       """SELECT a.lag AS lag, a.num/v.var AS acf, 196e-2/sqrt(CAST(v.n AS DOUBLE)) AS band FROM (SELECT lag, sum(x.x*y.x) AS num
 FROM range(29) r(lag) JOIN d x ON TRUE JOIN d y ON y.i=x.i+lag GROUP BY lag) a, (SELECT sum(x*x) AS var, count(*) AS n FROM d) v""".replace(
           " d x", " (D) x").replace(" d y", " (D) y").replace("FROM d)", "FROM (D))").replace(
           "(D)", """(SELECT row_number() OVER (ORDER BY date)-1 AS i, m-avg(m) OVER () AS x FROM
 (SELECT date, avg(observed_demand) AS m FROM daily GROUP BY 1))"""))
def _(spark, sf):
    return R.acf(daily_panel(spark, sf))


_DOW = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
_ZSQL = f"""SELECT third_category_id, m, {", ".join(f"list_extract(list_transform(a, lambda x: (x-mu)/sd), {i+1}) AS {d}" for i, d in enumerate(_DOW))}
 FROM (SELECT *, list_avg(a) AS mu, list_stddev_samp(a) AS sd FROM (SELECT third_category_id, avg(observed_demand) AS m,
 [{", ".join(f"avg(observed_demand) FILTER (isodow(date)={i+1})" for i in range(7))}] AS a FROM sales GROUP BY 1 HAVING count(observed_demand)>=500))"""


@query("category_weekday_profile", "#third_category_id " + " ".join(f"~{d}" for d in _DOW) + " tier ~deviation",
       "A15", "sales",
       f"""SELECT z.*, CASE WHEN z.m>=t2 THEN 'High' WHEN z.m>=t1 THEN 'Medium' ELSE 'Low' END AS tier,
 {"+".join(f"(z.{d}-p.{d})*(z.{d}-p.{d})" for d in _DOW)} AS deviation FROM ({_ZSQL}) z,
 (SELECT {", ".join(f"avg({d}) AS {d}" for d in _DOW)}, quantile_cont(m, 1e0/3e0) AS t1, quantile_cont(m, 2e0/3e0) AS t2 FROM ({_ZSQL})) p""")
def _(spark, sf):
    return R.category_weekday_profile(supplier_sales(spark, sf))


@query("unusual_categories", "#third_category_id tier #rank_in_tier ~deviation", "L06 A15", "sales",
       f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY deviation DESC, third_category_id) AS rank_in_tier
 FROM (SELECT z.third_category_id, CASE WHEN z.m>=t2 THEN 'High' WHEN z.m>=t1 THEN 'Medium' ELSE 'Low' END AS tier,
 {"+".join(f"(z.{d}-p.{d})*(z.{d}-p.{d})" for d in _DOW)} AS deviation FROM ({_ZSQL}) z,
 (SELECT {", ".join(f"avg({d}) AS {d}" for d in _DOW)}, quantile_cont(m, 1e0/3e0) AS t1, quantile_cont(m, 2e0/3e0) AS t2
 FROM ({_ZSQL})) p)) WHERE rank_in_tier<=2""")
def _(spark, sf):
    return R.top_per_tier(R.category_weekday_profile(supplier_sales(spark, sf)), 2)


def _bins(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, bin, count(*) AS n, min(lo)+(min(hi)-min(lo))/20e0*(bin-5e-1) AS x_mid,
 avg(y) AS mean, avg(y)-196e-2*stddev_samp(y)/sqrt(CAST(count(*) AS DOUBLE)) AS low,
 avg(y)+196e-2*stddev_samp(y)/sqrt(CAST(count(*) AS DOUBLE)) AS high FROM (SELECT *,
 least(greatest(CAST(ceil((v-lo)/((hi-lo)/20e0)) AS INTEGER),1),20) AS bin FROM (SELECT *, min(v) OVER () AS lo, max(v) OVER () AS hi
 FROM (SELECT * FROM m WHERE v<(SELECT quantile_cont(v,0.99) FROM m)))) WHERE lo<hi GROUP BY bin""".replace(
        " FROM m", f" FROM (SELECT * FROM b WHERE v>(SELECT quantile_cont(v,0.01) FROM b))").replace(
        " FROM b", f" FROM (SELECT {c} AS v, observed_demand AS y FROM sales WHERE {c} IS NOT NULL)")


@query("covariate_bins", "column_name #bin #n ~x_mid ~mean ~low ~high", "A16", "sales",
       " UNION ALL ".join(_bins(c) for c in ("discount", "precpt", "avg_humidity")))
def _(spark, sf):
    return R.covariate_bins(stored(supplier_sales(spark, sf)), ["discount", "precpt", "avg_humidity"])


@query("demand_histogram", "#bin ~center #count ~log_count", "A17", "daily",
       """SELECT b AS bin, lo+(hi-lo)/5e1*(b+5e-1) AS center, coalesce(n,0) AS "count", CASE WHEN n>0 THEN log10(n) ELSE 0e0 END AS log_count
 FROM range(50) r(b) CROSS JOIN (SELECT min(observed_demand) AS lo, max(observed_demand) AS hi FROM daily) LEFT JOIN
 (SELECT least(CAST(floor((observed_demand-(SELECT min(observed_demand) FROM daily))/((SELECT max(observed_demand)-min(observed_demand) FROM daily)/5e1)) AS INTEGER),49) AS k,
 count(*) AS n FROM daily GROUP BY 1) ON k=b""")
def _(spark, sf):
    return R.histogram(stored(daily_panel(spark, sf).select("observed_demand")), "observed_demand", 50)


@query("stockout_hour_histogram", "#hour #count", "A17", "sales",
       """SELECT CAST(least(floor(stockout_hours+0.5), (SELECT floor(max(stockout_hours)) FROM sales)) AS BIGINT) AS hour,
 count(*) AS "count" FROM sales WHERE stockout_hours>0 GROUP BY 1 HAVING hour>=1""")
def _(spark, sf):
    return R.hour_histogram(supplier_sales(spark, sf), True)


@query("demand_by_stockout_hour", "~stockout_hours ~observed_demand_mean", "A18", "sales",
       "SELECT stockout_hours, avg(observed_demand) AS observed_demand_mean FROM sales GROUP BY 1")
def _(spark, sf):
    return R.demand_by_stockout_hour(supplier_sales(spark, sf))


@query("zero_rate_stats", "~pct_above_50 #series ~median", "A19", "daily",
       f"""SELECT avg(CASE WHEN zero_demand_rate>0.5 THEN 1e0 ELSE 0e0 END)*1e2 AS pct_above_50, count(*) AS series,
 median(zero_demand_rate) AS "median" FROM ({_SERIES})""")
def _(spark, sf):
    return R.zero_rate_stats(stored(R.series_summary(daily_panel(spark, sf))))


@query("sigma_boxes", "series_id ~min ~q1 ~median ~q3 ~max", "A20 L05", "daily",
       f"""SELECT series_id, greatest(0e0, m-2*s) AS "min", greatest(0e0, m-s) AS q1, m AS "median", m+s AS q3, m+2*s AS "max" FROM
 (SELECT series_id, observed_demand_mean AS m, observed_demand_std AS s FROM ({_SERIES}) ORDER BY observed_demand_sum DESC, series_id LIMIT 20)""")
def _(spark, sf):
    return R.sigma_boxes(R.series_summary(daily_panel(spark, sf)))


def md5_52(*parts: str) -> str:
    text = "||'|'||".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x'||substr(md5({text}),1,13)) AS BIGINT)"


@query("quartile_boxes", "band series_id ~min ~q1 ~median ~q3 ~max", "A20", "daily",
       f"""SELECT band, d.series_id AS series_id, min(observed_demand) AS "min", quantile_cont(observed_demand,0.25) AS q1,
 quantile_cont(observed_demand,0.5) AS "median", quantile_cont(observed_demand,0.75) AS q3, max(observed_demand) AS "max" FROM daily d
 JOIN (SELECT series_id, CASE WHEN p<5 THEN 'top' WHEN p>=n//2 AND p<n//2+5 THEN 'middle' WHEN p>=n-5 THEN 'bottom' END AS band FROM
 (SELECT series_id, row_number() OVER (ORDER BY t DESC, h)-1 AS p, count(*) OVER () AS n FROM (SELECT series_id, sum(observed_demand) AS t,
 {md5_52('series_id')} AS h FROM daily GROUP BY 1))) b ON d.series_id=b.series_id WHERE band IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return R.quartile_boxes(stored(daily_panel(spark, sf)))


@query("coverage_grid", "series_id @date #present", "A21", "sales",
       """SELECT s.series_id AS series_id, d.date AS date, CASE WHEN x.date IS NULL THEN 0 ELSE 1 END AS present FROM (T) s
 CROSS JOIN (SELECT DISTINCT date FROM sales WHERE series_id IN (SELECT series_id FROM (T))) d
 LEFT JOIN sales x ON x.series_id=s.series_id AND x.date=d.date""".replace("(T)", """(SELECT series_id, sum(observed_demand) AS t FROM sales
 GROUP BY 1 ORDER BY t DESC, series_id LIMIT 20)"""))
def _(spark, sf):
    return R.coverage_grid(stored(supplier_sales(spark, sf).select("series_id", "date", "observed_demand")))


@query("series_by_demand", "series_id ~observed_demand_sum ~observed_demand_mean", "L05 L02", "daily",
       f"SELECT * FROM ({_SERIES}) ORDER BY observed_demand_sum DESC, series_id LIMIT 12")
def _(spark, sf):
    return R.top_rows(R.series_summary(daily_panel(spark, sf)), 12)


@query("sampled_rows", "series_id @date ~observed_demand", "L07", "sales",
       f"SELECT * FROM sales ORDER BY {md5_52('series_id', 'date', '42')}, series_id, date LIMIT 500")
def _(spark, sf):
    return R.sample_rows(supplier_sales(spark, sf), 500)


@query("diverse_series_overlay", "series_id @date ~observed_demand ~stockout_hours ~stockout_scaled", "L08")
def _(spark, sf):
    p = stored(supplier_sales(spark, sf))
    return R.series_overlay(p, R.diverse_series(p))


_EDGE_Q = """SELECT series_id, CAST(date AS VARCHAR) AS date, observed_demand, stockout_hours, precpt, avg_temperature FROM sales
 UNION ALL SELECT series_id, CAST(date AS VARCHAR), observed_demand, stockout_hours, precpt, avg_temperature FROM sales WHERE day(date)=3
 UNION ALL SELECT series_id, 'not a date', NULL, 17e0, precpt, avg_temperature FROM sales WHERE day(date)=4 AND month(date)=5"""


@query("data_quality_report", "severity code column_name ~amount", "A30 U03", "sales",
       f"""SELECT * FROM (SELECT 'blocking' AS severity, 'duplicate_series_date_rows' AS code, CAST(NULL AS VARCHAR) AS column_name,
 CAST((SELECT sum(n-1) FROM (SELECT count(*) AS n FROM ({_EDGE_Q}) GROUP BY series_id, date)) AS DOUBLE) AS amount
 UNION ALL SELECT 'blocking', 'null_key_columns', 'observed_demand', CAST(count(*)-count(observed_demand) AS DOUBLE) FROM ({_EDGE_Q})
 UNION ALL SELECT 'blocking', 'invalid_date_format', NULL, CAST(count(*)-count(try_cast(date AS DATE)) AS DOUBLE) FROM ({_EDGE_Q})
 UNION ALL SELECT 'blocking', 'invalid_stockout_hours', NULL, CAST(count(*) FILTER (stockout_hours<0 OR stockout_hours>16) AS DOUBLE) FROM ({_EDGE_Q})
 UNION ALL SELECT 'warning', 'high_missingness', 'precpt', (count(*)-count(precpt))/CAST(count(*) AS DOUBLE) FROM ({_EDGE_Q})
 UNION ALL SELECT 'warning', 'high_missingness', 'avg_temperature', (count(*)-count(avg_temperature))/CAST(count(*) AS DOUBLE) FROM ({_EDGE_Q}))
 WHERE amount > CASE WHEN severity='warning' THEN 5e-2 ELSE 0e0 END""")
def _(spark, sf):
    s = supplier_sales(spark, sf).select("series_id", F.col("date").cast("string").alias("date"), "observed_demand",
                                         "stockout_hours", "precpt", "avg_temperature")
    twice = s.where(F.dayofmonth(F.to_date("date")) == 3)
    bad = s.where((F.dayofmonth(F.to_date("date")) == 4) & (F.month(F.to_date("date")) == 5)).withColumns(
        {"date": F.lit("not a date"), "observed_demand": F.lit(None).cast("double"), "stockout_hours": F.lit(17.0)})
    return Q.data_quality_report(P.union_all(s, twice, bad), QualityConfig())


@query("quality_header", "#checked_rows #checked_series @date_min @date_max #warning_count #blocking_error_count #passed",
       "A30", "sales", """SELECT count(*) AS checked_rows, count(DISTINCT series_id) AS checked_series, min(date) AS date_min,
 max(date) AS date_max, CASE WHEN (count(*)-count(precpt))/CAST(count(*) AS DOUBLE)>0.05 THEN 1 ELSE 0 END +
 CASE WHEN (count(*)-count(avg_temperature))/CAST(count(*) AS DOUBLE)>0.05 THEN 1 ELSE 0 END AS warning_count, 0 AS blocking_error_count,
 TRUE AS passed FROM sales""")
def _(spark, sf):
    s = stored(supplier_sales(spark, sf))
    return Q.report_header(s, Q.data_quality_report(s))


@query("run_description", "#rows #series #unique_dates @date_min @date_max", "A42", "sales",
       """SELECT count(*) AS rows, count(DISTINCT series_id) AS series, count(DISTINCT date) AS unique_dates, min(date) AS date_min,
 max(date) AS date_max FROM sales""")
def _(spark, sf):
    return run_description(supplier_sales(spark, sf))


@query("profile_tables", "table_name #n", "A44 S06", "sales",
       """SELECT 'series_summary' AS table_name, count(DISTINCT series_id) AS n FROM sales UNION ALL
 SELECT 'series_gap_summary', count(DISTINCT series_id) FROM sales UNION ALL SELECT 'stockout_by_series_summary', count(DISTINCT series_id) FROM sales
 UNION ALL SELECT 'weekday_summary', count(DISTINCT isodow(date)) FROM sales UNION ALL SELECT 'stockout_demand_bands', 4
 UNION ALL SELECT 'dataset_summary', 1 UNION ALL SELECT 'temporal_summary', 1 UNION ALL SELECT 'stockout_summary', 1
 UNION ALL SELECT 'config_alignment_summary', 1 UNION ALL SELECT 'missingness_summary', 18
 UNION ALL SELECT 'numeric_summary', 16 UNION ALL SELECT 'correlation_summary', 15""")
def _(spark, sf):
    tables = R.profile_panel(stored(supplier_sales(spark, sf)))
    return P.union_all(*[df.agg(F.count(F.lit(1)).alias("n")).withColumn("table_name", F.lit(name))
                         for name, df in tables.items()])


