"""Steps of queries over large tables: what one task gets does not grow with the table."""

import datetime

import pytest
from pyspark.sql import functions as F

from shelfcast.catalog.frames import origin_features
from shelfcast.models.naive import seasonal_naive
from shelfcast.operators import panel as P
from shelfcast.operators import profile as R
from shelfcast.operators.impute import impute_latent
from shelfcast.streaming.versions import VersionedTable

DAY = datetime.date(2024, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def unmeasured(spark):
    """No table is small enough for the planner to broadcast it by itself."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_covariate_bins_deal_no_rows_by_covariate(spark, unmeasured):
    rows = spark.range(400).select((F.col("id") % 7).cast("double").alias("observed_demand"), (F.col("id") % 100).cast("double").alias("discount"),
                                   F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("precpt"))
    got = R.covariate_bins(rows, ["discount", "precpt"])
    plan = plan_of(got)
    assert "SortMergeJoin [column_name#" not in plan and plan.count("BroadcastHashJoin [column_name#") >= 3
    n = {r["column_name"]: r["n"] for r in got.groupBy("column_name").agg(F.sum("n").alias("n")).collect()}
    # discount: 4 rows of each value, of 0 to 99; 0 goes (1 % quantile 0.99), and 99 of what is left. precpt: 320 values, 4 and 4 go.
    assert n == {"discount": 4 * 98, "precpt": 312}


def series_rows(spark, series, days):
    rows = [(f"s{i:03d}", DAY + datetime.timedelta(d), float(i * days + d)) for i in range(series) for d in range(days)]
    return spark.createDataFrame(rows, "series_id string, date date, observed_demand double")


def test_a_large_panel_is_dealt_by_series_over_enough_tasks(spark, monkeypatch):
    monkeypatch.setattr(P, "SERIES_ROWS", 40)
    rows = series_rows(spark, 60, 20)
    dealt = P.dealt_by_series(rows)
    placed = dealt.withColumn("task", F.spark_partition_id()).collect()
    tasks = [r["task"] for r in placed]
    assert dealt.rdd.getNumPartitions() == 30 and max(map(tasks.count, tasks)) <= 40 * 5
    assert len({(r["series_id"], r["task"]) for r in placed}) == 60
    assert sorted(r[:3] for r in placed) == sorted(map(tuple, rows.collect()))


def test_series_windows_of_a_forecast_share_one_sort(spark):
    rows = series_rows(spark, 3, 40).withColumn("stockout_hours", F.lit(0.0))
    plan = plan_of(origin_features(impute_latent(P.dealt_by_series(rows), "historical_mean")))
    assert plan.count("Sort [series_id") == 1 and plan.count("Exchange hashpartitioning(series_id") == 1, plan


def test_naive_forecast_goes_by_calendar_days(spark):
    days = [d for d in range(30) if d != 20]
    rows = [("a", DAY + datetime.timedelta(d), float(d)) for d in days] + [("a", None, 5.0)]
    got = {r["date"]: r["naive"] for r in seasonal_naive(spark.createDataFrame(rows, "series_id string, date date, observed_demand double"), 10, 7).collect()}
    for d in days:
        back = range(d - 7, d)
        want = sum(back) + sum(list(back)[:3]) if all(x in days for x in back) else None
        assert got[DAY + datetime.timedelta(d)] == want


def test_stream_parts_and_buckets_are_written_by_many_tasks(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k bigint, v string", ["k"], buckets=2)
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")).repartition(8)
    was = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        table.write(0, rows, [0, 1])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", was)
    assert all(len(list((tmp_path / "t/data/version=0" / f"bucket={b}").glob("*.parquet"))) > 2 for b in (0, 1))
    assert sorted(table.read(1).collect()) == sorted(rows.collect())
