"""Raw daily sales derived from the order tables: a series is a supplier, a day is a ship date.

Money and rates are summed as whole cents, so every run and every engine gets the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMA = T.StructType([
    *[T.StructField(n, T.LongType()) for n in
      ("city_id", "store_id", "management_group_id", "first_category_id", "second_category_id",
       "third_category_id", "product_id")],
    T.StructField("dt", T.DateType()),
    T.StructField("sale_amount", T.DoubleType()),
    T.StructField("stock_hour6_22_cnt", T.DoubleType()),
    T.StructField("discount", T.DoubleType()),
    T.StructField("holiday_flag", T.IntegerType()),
    T.StructField("activity_flag", T.IntegerType()),
    *[T.StructField(n, T.DoubleType()) for n in ("precpt", "avg_temperature", "avg_humidity", "avg_wind_level")],
])

FOLD_START, FOLD_END, FOLD_DAYS = "1998-01-01", "1998-06-29", 180


# Declared, so that a read opens no file before the query runs.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                 "l_shipdate timestamp_ntz"),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def raw_split(spark: SparkSession, sf_dir: str, folded: bool = False) -> DataFrame:
    """The raw split in ``RAW_SCHEMA`` columns.

    ``folded`` maps all ship dates onto one 180-day calendar, which gives several lines per
    supplier and day and so a dense panel at any table size. Lines are aggregated to
    (supplier, day) before the supplier and nation columns are joined on.
    """
    items = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_suppkey AS k", "l_quantity", "cast(l_linenumber AS bigint) AS ln",
        "cast(round(l_discount * 100) AS bigint) AS dc", "cast(round(l_tax * 100) AS bigint) AS tc",
        "cast(l_returnflag = 'R' AS bigint) AS r", (
            f"date_add(date'{FOLD_START}', pmod(datediff(l_shipdate, date'1995-01-02'), {FOLD_DAYS})) AS dt"
            if folded else "to_date(l_shipdate) AS dt"))
    urgent = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "cast(o_orderpriority = '1-URGENT' AS int) AS urgent")
    cells = items.join(urgent, F.expr("l_orderkey = o_orderkey")).groupBy("k", "dt").agg(
        F.expr("sum(l_quantity) AS qty"), F.expr("count(1) AS n"), F.expr("sum(dc) AS dc"), F.expr("sum(tc) AS tc"),
        F.expr("sum(ln) AS ln"), F.expr("sum(r) AS nr"), F.expr("max(urgent) AS urgent"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    free = 1 if folded else 0
    return cells.join(supplier.join(nation, F.expr("s_nationkey = n_nationkey")), F.expr("k = s_suppkey")).selectExpr(
        "cast(n_regionkey AS bigint) AS city_id", "cast(s_nationkey AS bigint) AS store_id",
        "cast(n_regionkey AS bigint) AS management_group_id", "k % 3 AS first_category_id",
        "k % 6 AS second_category_id", "k % 12 AS third_category_id", "k AS product_id", "dt", "qty AS sale_amount",
        f"least(16D, 4D * greatest(nr - {free}, 0)) AS stock_hour6_22_cnt", "1D - dc / (100D * n) AS discount",
        "cast(weekday(dt) >= 6 AS int) AS holiday_flag", "urgent AS activity_flag",
        "CASE WHEN tc >= n THEN tc / cast(n AS double) END AS precpt",
        "CASE WHEN day(dt) NOT IN (1, 2) THEN 15D + month(dt) END AS avg_temperature",
        "50D + ln / cast(n AS double) AS avg_humidity", "3D + tc / (100D * n) AS avg_wind_level")
