"""SQL building blocks: the same input frames as ``frames``, written as common table expressions."""

from .base import cte

cte("lines", """SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS ship, l_quantity AS q, l_linenumber AS ln,
 CAST(round(l_discount*100) AS BIGINT) AS dc, CAST(round(l_tax*100) AS BIGINT) AS tc,
 CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS r, CASE WHEN o_orderpriority='1-URGENT' THEN 1 ELSE 0 END AS u
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey""")


def _raw(cells: str, free: int) -> str:
    return f"""SELECT CAST(n_regionkey AS BIGINT) AS city_id, CAST(s_nationkey AS BIGINT) AS store_id,
 CAST(n_regionkey AS BIGINT) AS management_group_id, k % 3 AS first_category_id, k % 6 AS second_category_id,
 k % 12 AS third_category_id, k AS product_id, dt AS date, qty AS observed_demand,
 CAST(least(16, 4*greatest(nr-{free},0)) AS DOUBLE) AS stockout_hours,
 1e0 - CAST(dc AS DOUBLE)/(1e2*n) AS discount,
 CASE WHEN isodow(dt)-1>=6 THEN 1 ELSE 0 END AS holiday_flag, u AS activity_flag,
 CASE WHEN tc>=n THEN CAST(tc AS DOUBLE)/n END AS precpt,
 CASE WHEN day(dt) NOT IN (1,2) THEN 15e0+month(dt) END AS avg_temperature,
 5e1+CAST(ln AS DOUBLE)/n AS avg_humidity, 3e0+CAST(tc AS DOUBLE)/(1e2*n) AS avg_wind_level,
 CAST(s_nationkey AS VARCHAR)||'_'||CAST(k AS VARCHAR) AS series_id
 FROM {cells} JOIN supplier ON k=s_suppkey JOIN nation ON s_nationkey=n_nationkey"""


_AGG = """sum(q) AS qty, count(*) AS n, sum(dc) AS dc, sum(tc) AS tc, sum(ln) AS ln, sum(r) AS nr, max(u) AS u
 FROM lines GROUP BY 1, 2"""
cte("cells", f"SELECT k, ship AS dt, {_AGG}", "lines")
cte("folded_cells", f"""SELECT k, CAST(DATE '1998-01-01' + CAST((ship - DATE '1995-01-02') % 180 AS INTEGER) AS DATE) AS dt,
 {_AGG}""", "lines")
cte("sales", _raw("cells", 0), "cells")
cte("folded_sales", _raw("folded_cells", 1), "folded_cells")

_PAST = "OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_NEXT = "OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _fill(c: str) -> str:
    return f"coalesce(last_value({c} IGNORE NULLS) {_PAST}, first_value({c} IGNORE NULLS) {_NEXT}) AS {c}"


cte("kept", """SELECT * FROM sales WHERE observed_demand>=0 AND series_id IN
 (SELECT series_id FROM sales WHERE observed_demand>=0 GROUP BY 1 HAVING count(date)>=70)""", "sales")
cte("filled", f"""SELECT * EXCLUDE (avg_temperature, avg_humidity, avg_wind_level, precpt),
 coalesce(precpt, CAST(0 AS DOUBLE)) AS precpt, {_fill('avg_temperature')}, {_fill('avg_humidity')}, {_fill('avg_wind_level')}
 FROM kept""", "kept")
cte("panel", """SELECT * REPLACE (coalesce(avg_temperature, (SELECT quantile_cont(avg_temperature, 0.5) FROM filled)) AS avg_temperature)
 FROM filled""", "filled")
cte("calendar", "SELECT CAST(DATE '1998-01-01' + CAST(i AS INTEGER) AS DATE) AS date FROM range(180) t(i)")
cte("daily", """SELECT s.*, c.date, coalesce(f.observed_demand, CAST(0 AS DOUBLE)) AS observed_demand,
 coalesce(f.stockout_hours, CAST(0 AS DOUBLE)) AS stockout_hours, coalesce(f.discount, CAST(1 AS DOUBLE)) AS discount,
 CASE WHEN isodow(c.date)-1>=6 THEN 1e0 ELSE 0e0 END AS holiday_flag, coalesce(CAST(f.activity_flag AS DOUBLE), 0e0) AS activity_flag
 FROM (SELECT DISTINCT city_id, store_id, management_group_id, first_category_id, second_category_id, third_category_id,
 product_id, series_id FROM folded_sales) s CROSS JOIN calendar c
 LEFT JOIN folded_sales f ON f.series_id=s.series_id AND f.date=c.date""", "folded_sales", "calendar")

_MEAN = """coalesce(avg(CASE WHEN stockout_hours=0 THEN observed_demand END) OVER (PARTITION BY series_id),
 (SELECT avg(observed_demand) FROM daily WHERE stockout_hours=0))"""
cte("latent", f"""SELECT * REPLACE (CASE WHEN stockout_hours=0 THEN observed_demand
 ELSE greatest(observed_demand, {_MEAN}) END AS observed_demand) FROM daily""", "daily")
cte("strategies", """SELECT *, 'Observed' AS data_strategy FROM daily UNION ALL BY NAME
 SELECT *, 'Latent_historical_mean' AS data_strategy FROM latent""", "daily", "latent")
_W = "PARTITION BY data_strategy, series_id ORDER BY date"
cte("origins", f"""SELECT *, CASE WHEN count(observed_demand) OVER p=28 THEN avg(observed_demand) OVER p END AS m28,
 CASE WHEN count(observed_demand) OVER p=28 THEN stddev_samp(observed_demand) OVER p END AS s28,
 CASE WHEN count(observed_demand) OVER n=7 THEN sum(observed_demand) OVER n END AS y_true,
 CASE WHEN count(observed_demand) OVER w=7 THEN greatest(sum(observed_demand) OVER w, 0e0) END AS naive
 FROM strategies WINDOW p AS ({_W} ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING),
 n AS ({_W} ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING),
 w AS ({_W} RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)""", "strategies")
cte("validation", """SELECT *, CAST(((date - DATE '1998-01-01') - 56)//7 AS INTEGER) AS fold_id FROM origins
 WHERE y_true IS NOT NULL AND (date - DATE '1998-01-01') BETWEEN 56 AND 76""", "origins")
_SPREAD = "s28*(sqrt(7e0)*1.2815515655446008e0)"
cte("forecasts", f"""SELECT *, 'seasonal_naive' AS model_name, 'heuristic' AS backend_name, naive AS y_pred,
 CAST(NULL AS DOUBLE) AS q_0_1, CAST(NULL AS DOUBLE) AS q_0_5, CAST(NULL AS DOUBLE) AS q_0_9 FROM validation
 UNION ALL BY NAME SELECT *, 'rolling_normal' AS model_name, 'rolling' AS backend_name, m28*7e0 AS y_pred,
 greatest(m28*7e0-{_SPREAD}, 0e0) AS q_0_1, m28*7e0 AS q_0_5, m28*7e0+{_SPREAD} AS q_0_9 FROM validation""", "validation")


def level(target: str) -> str:
    """Interpolated quantile at ``target`` for levels 0.1, 0.5, 0.9; the point forecast without quantiles."""
    return f"""coalesce(CASE WHEN {target}<=1e-1 THEN q_0_1
 WHEN {target}<5e-1 THEN (q_0_5-q_0_1)/4e-1*({target}-1e-1)+q_0_1
 WHEN {target}<9e-1 THEN (q_0_9-q_0_5)/4e-1*({target}-5e-1)+q_0_5 ELSE q_0_9 END, y_pred)"""


cte("orders_placed", f"""SELECT *, 1e0 AS c_over, 4e0 AS c_under, 8e-1 AS critical_fractile,
 greatest({level('8e-1')}, 0e0) AS order_quantity FROM forecasts""", "forecasts")


def costed(source: str) -> str:
    return f"""SELECT *, c_over*overstock_units AS overstock_cost, c_under*stockout_units AS stockout_cost,
 c_over*overstock_units+c_under*stockout_units AS total_cost FROM (SELECT *,
 greatest(order_quantity-y_true, 0e0) AS overstock_units, greatest(y_true-order_quantity, 0e0) AS stockout_units FROM {source})"""


cte("costed", costed("orders_placed"), "orders_placed")
