"""Queries on the daily stream: batches of days with late rows and an empty batch, scored from running state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import floor0
from ..operators.features import feature_frame, lead_time_target
from ..session import materialise, scratch_path
from ..streaming.daily import stream_scoring
from .base import cte, query
from .frames import H, Z90, supplier_sales
from .q_backtest import SIM
from .sqlparts import level

CUTS = ("1996-06-01", "1997-06-01")
RESENT = "1996-05-01"


class ScaledRolling:
    """28-day mean and spread, scaled; the demand that followed the mean so far sets the scale."""

    model_name, backend_name = "scaled_rolling", "rolling"

    def __init__(self, scale: float = 1.0):
        self.scale = scale

    @classmethod
    def fit(cls, panel: DataFrame) -> "ScaledRolling":
        frame, _ = feature_frame(panel, SIM.features)
        m = F.col("demand_roll_mean_28") * float(H)
        pairs = frame.select(lead_time_target("observed_demand", H).alias("y"), m.alias("m")).where("y is not null and m is not null")
        return cls(pairs.agg(F.sum("y") / F.sum("m")).first()[0])

    def predict(self, rows: DataFrame) -> DataFrame:
        mid = F.col("demand_roll_mean_28") * F.lit(float(H) * self.scale)
        spread = F.col("demand_roll_std_28") * F.lit(H ** 0.5 * Z90)
        return rows.withColumns({"y_pred": mid, "q_0_1": floor0(mid - spread), "q_0_5": mid, "q_0_9": mid + spread})


# Suppliers as stores that share twenty products; some products and categories have no known demand, some stores a short history.
cte("streamed", """SELECT * REPLACE (product_id AS store_id, product_id % 20 AS product_id, product_id % 5 AS third_category_id,
 CAST(product_id AS VARCHAR)||'_'||CAST(product_id % 20 AS VARCHAR) AS series_id,
 CASE WHEN product_id % 2 = 0 OR product_id % 20 IN (7, 9) OR product_id % 5 = 1 THEN NULL ELSE observed_demand END AS observed_demand)
 FROM sales WHERE product_id % 3 > 0 OR date < DATE '1995-02-20'""", "sales")


def streamed(spark, sf) -> DataFrame:
    k = F.col("product_id")
    gone = (k % 2 == 0) | (k % 20).isin(7, 9) | (k % 5 == 1)
    s = supplier_sales(spark, sf).drop("series_id").where((k % 3 > 0) | (F.col("date") < "1995-02-20"))
    return s.withColumns({"observed_demand": F.when(~gone, F.col("observed_demand")), "store_id": k, "product_id": k % 20, "third_category_id": k % 5})


def day_parts(spark, sf) -> list[DataFrame]:
    """First days, then the next ones with a month sent again, then nothing, then the rest."""
    sales, day = materialise(streamed(spark, sf), "streamed"), F.col("date")
    again = sales.where((day >= RESENT) & (day < CUTS[0])).withColumn("observed_demand", F.col("observed_demand") + 1.0)
    return [sales.where(day < CUTS[0]), sales.where((day >= CUTS[0]) & (day < CUTS[1])).unionByName(again), sales.limit(0), sales.where(day >= CUTS[1])]


def scored_stream(spark, sf) -> str:
    """Each part arrives while the stream is down, and is taken in after a restart."""
    days, root, state = (scratch_path(spark, n) for n in ("days", "daily", "daily-state"))
    for part in day_parts(spark, sf):
        part.write.mode("append").parquet(days)
        source = spark.readStream.schema(part.schema).parquet(days)
        stream_scoring(source, root, ScaledRolling(), SIM, state, retrain=ScaledRolling.fit, every=2, buckets=8).awaitTermination()
    return root


def _scale(cut: str) -> str:
    return f"""(SELECT sum(y)/sum(m) FROM (SELECT CASE WHEN count(observed_demand) OVER n=7 THEN sum(observed_demand) OVER n END AS y,
 CASE WHEN count(observed_demand) OVER p=28 THEN avg(observed_demand) OVER p END*7e0 AS m FROM streamed WHERE date<DATE '{cut}'
 WINDOW p AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING),
 n AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)) WHERE y IS NOT NULL AND m IS NOT NULL)"""


cte("day_batches", f"""SELECT 0 AS batch_id, DATE '1900-01-01' AS lo, DATE '{CUTS[0]}' AS hi, 1e0 AS r, CAST(NULL AS BIGINT) AS history_rows, 0 AS late_rows
 UNION ALL SELECT 1, DATE '{CUTS[0]}', DATE '{CUTS[1]}', {_scale(CUTS[0])}, (SELECT count(*) FROM streamed WHERE date<DATE '{CUTS[0]}'),
 (SELECT count(*) FROM streamed WHERE date>=DATE '{RESENT}' AND date<DATE '{CUTS[0]}')
 UNION ALL SELECT 3, DATE '{CUTS[1]}', DATE '2100-01-01', {_scale(CUTS[1])}, (SELECT count(*) FROM streamed WHERE date<DATE '{CUTS[1]}'), 0""", "streamed")
cte("day_features", """SELECT *, lag(observed_demand, 1) OVER w AS l1, lag(observed_demand, 7) OVER w AS l7,
 CASE WHEN count(observed_demand) OVER p=28 THEN avg(observed_demand) OVER p END AS m28, CASE WHEN count(observed_demand) OVER p=28 THEN stddev_samp(observed_demand) OVER p END AS s28
 FROM streamed WINDOW w AS (PARTITION BY series_id ORDER BY date), p AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)""", "streamed")


def _mean(name: str, key: str = "") -> str:
    by = f", {key}" if key else ""
    return f"(SELECT batch_id{by}, avg(observed_demand) AS {name} FROM day_batches JOIN streamed ON date<hi GROUP BY ALL)"


_ROUTED = f"""SELECT *, CASE WHEN ok THEN 'model' ELSE 'cold_start_fallback' END AS prediction_source,
 CASE WHEN NOT ok THEN CASE WHEN ms IS NOT NULL THEN 'series' WHEN mp IS NOT NULL THEN 'product' WHEN mt IS NOT NULL THEN 'third_category' ELSE 'global' END END AS fallback_level,
 CASE WHEN ok THEN m28*(7e0*r) ELSE coalesce(ms, mp, mt, mg)*7e0 END AS y_pred, CASE WHEN ok THEN greatest(m28*(7e0*r)-s28*(sqrt(7e0)*1.2815515655446008e0), 0e0) END AS q_0_1,
 CASE WHEN ok THEN m28*(7e0*r) END AS q_0_5, CASE WHEN ok THEN m28*(7e0*r)+s28*(sqrt(7e0)*1.2815515655446008e0) END AS q_0_9,
 CASE WHEN stockout_hours>1 THEN 'high_stockout' ELSE 'low_stockout' END AS stockout_regime, CASE WHEN ms>=1 THEN 'fast_moving' ELSE 'slow_moving' END AS velocity_regime,
 CASE WHEN coalesce(discount, 0)>0 THEN 'on_promotion' ELSE 'baseline_price' END AS promo_regime,
 CASE WHEN holiday_flag>0 THEN 'peak_holiday' ELSE 'standard_season' END AS seasonal_regime FROM
 (SELECT *, l1 IS NOT NULL AND l7 IS NOT NULL AND m28 IS NOT NULL AND s28 IS NOT NULL AS ok FROM (SELECT b.*, f.*, row_number() OVER (PARTITION BY batch_id, series_id ORDER BY date DESC) AS rn
 FROM day_batches b JOIN day_features f ON f.date>=lo AND f.date<hi) WHERE rn=1)
 LEFT JOIN {_mean('ms', 'series_id')} USING (batch_id, series_id) LEFT JOIN {_mean('mp', 'product_id')} USING (batch_id, product_id)
 LEFT JOIN {_mean('mt', 'third_category_id')} USING (batch_id, third_category_id) LEFT JOIN {_mean('mg')} USING (batch_id)"""


@query("stream_daily_scoring", "#batch_id series_id @date prediction_source fallback_level ~y_pred ~order_quantity stockout_regime velocity_regime promo_regime "
       "seasonal_regime #history_rows #late_rows", "T03 T05 T06", "day_batches day_features",
       f"SELECT *, greatest({level('8e-1')}, 0e0) AS order_quantity FROM ({_ROUTED})", digits=5)
def _(spark, sf):
    root = scored_stream(spark, sf)
    scored = spark.read.parquet(f"{root}/predictions")
    events = spark.read.parquet(f"{root}/retrain_events").select(F.col("day_index").alias("batch_id"), "history_rows")
    late = spark.read.parquet(f"{root}/days").groupBy("batch_id").agg(F.sum("late").alias("late_rows"))
    return scored.join(events, "batch_id", "left").join(late, "batch_id")
