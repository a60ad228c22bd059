from datetime import date

import pytest
from conftest import raw_of
from pyspark.sql import functions as F

from shelfcast.config import DatasetConfig, ModelConfig, PreprocessingConfig, QualityConfig, Settings, SimulationConfig
from shelfcast.functions.columns import require_columns
from shelfcast.operators import panel as P
from shelfcast.operators import profile as R
from shelfcast.operators import quality as Q
from shelfcast.operators import regimes as G
from shelfcast.sources import store


def test_prepare_keeps_long_series_and_fills(panel):
    raw = raw_of(panel).where((F.col("store_id") != 3) | (F.col("dt") < date(2025, 2, 1)))
    raw = raw.withColumns({"precpt": F.when(F.col("precpt") > 0, F.col("precpt")),
                           "avg_temperature": F.when(F.dayofmonth("dt") > 5, F.col("avg_temperature"))})
    out = P.prepare_panel(raw, DatasetConfig(min_history_days=70, top_n_series=1))
    assert [r[0] for r in out.select("series_id").distinct().collect()] == ["2_102"]
    assert out.count() == 70 and out.where("precpt is null or avg_temperature is null").count() == 0
    assert out.where(F.col("date") == date(2025, 1, 1)).first()["avg_temperature"] == 17.0


def test_duplicates_and_negative_sales(panel):
    one = panel.where("series_id = '1_101'")
    twice = P.union_all(one, one.withColumn("observed_demand", F.col("observed_demand") + 5),
                        one.withColumn("observed_demand", F.lit(-1.0)))
    kept = P.dedupe_key(P.drop_negative_sales(twice))
    assert kept.count() == 70
    assert kept.agg(F.sum("observed_demand")).first()[0] == pytest.approx(one.agg(F.sum("observed_demand")).first()[0])


def test_row_cap_takes_a_prefix_in_key_order(panel):
    raw = P.canonicalise(raw_of(panel))
    got = P.row_cap(raw, 100).select("store_id", "date").collect()
    want = sorted((r["store_id"], r["date"]) for r in raw.collect())[:100]
    assert sorted(map(tuple, got)) == want


def test_missing_columns_are_named(panel):
    with pytest.raises(ValueError, match="nope"):
        require_columns(panel, ["date", "nope"])


def test_weather_median_for_a_series_without_readings(panel):
    df = panel.withColumn("avg_temperature", F.when(F.col("store_id") != 1, F.col("avg_temperature")))
    out = P.weather_fill(df, ["avg_temperature"])
    assert out.where("store_id = 1").select("avg_temperature").distinct().first()[0] == 17.5


def test_densify_fills_both_ends_and_gaps(panel):
    few = panel.where(F.col("date").isin(date(2025, 1, 3), date(2025, 1, 6)) & (F.col("store_id") == 1))
    got = P.densify(few, "2025-01-01", "2025-01-08", carry=("store_id",)).orderBy("date").collect()
    assert len(got) == 8 and [r["observed_demand"] > 0 for r in got] == [False, False, True, False, False, True, False, False]
    assert {r["store_id"] for r in got} == {1}
    twice = P.densify(few.unionByName(few), "2025-01-01", "2025-01-08", carry=("store_id",)).groupBy("date").count().orderBy("date").collect()
    assert [r["count"] for r in twice] == [1, 1, 2, 1, 1, 2, 1, 1]
    assert P.densify(few, "2026-01-01", "2026-01-08").isEmpty()


def test_eval_split_inherits_train_series(spark, panel, tmp_path):
    raw = raw_of(panel)
    root = str(tmp_path)
    raw.where(F.col("dt") < date(2025, 3, 5)).write.parquet(f"{root}/raw/train.parquet")
    raw.where(F.col("dt") >= date(2025, 3, 5)).write.parquet(f"{root}/raw/eval.parquet")
    cfg = DatasetConfig(min_history_days=50, top_n_series=2)
    ev = store.load_prepared_panel(spark, f"{root}/raw", f"{root}/panels", cfg, split="eval")
    assert sorted(r[0] for r in ev.select("series_id").distinct().collect()) == ["2_102", "3_103"]
    raw.where("store_id = 1").where(F.col("dt") >= date(2025, 3, 5)).write.mode("overwrite").parquet(f"{root}/raw/eval.parquet")
    with pytest.raises(ValueError, match="empty"):
        store.load_prepared_panel(spark, f"{root}/raw", f"{root}/panels2", cfg, split="eval")


def test_panel_key_covers_preprocessing():
    a, b = DatasetConfig(), PreprocessingConfig()
    assert store.panel_key(a, b, "train") != store.panel_key(a, PreprocessingConfig(drop_negative_sales=False), "train")
    assert store.panel_key(a, b, "train") != store.panel_key(DatasetConfig(top_n_series=5), b, "train")


def test_carve(panel):
    a, b = P.carve_split(panel, 2, 60)
    assert a.count() == 120 and b.count() == 20
    with pytest.raises(ValueError):
        P.carve_split(panel, 2, 70)


def test_regimes(panel):
    out = G.label_all_regimes(panel, velocity_threshold=13.5)
    by = {r["series_id"]: r["velocity_regime"] for r in out.select("series_id", "velocity_regime").distinct().collect()}
    assert by == {"1_101": "slow_moving", "2_102": "slow_moving", "3_103": "fast_moving"}
    assert out.where("stockout_regime = 'high_stockout'").count() == out.where("stockout_hours > 1").count()


def test_quality_report(panel):
    assert Q.data_quality_report(panel).isEmpty()
    bad = P.union_all(panel, panel.where("store_id = 1").withColumn("stockout_hours", F.lit(17.0)))
    codes = {r["code"]: r["amount"] for r in Q.data_quality_report(bad).collect()}
    assert codes == {"duplicate_series_date_rows": 70.0, "invalid_stockout_hours": 70.0}
    with pytest.raises(Q.DataQualityError):
        Q.raise_on_blocking(Q.data_quality_report(bad))
    stale = Q.data_quality_report(panel, QualityConfig(max_data_age_days=10), "score_daily", date(2025, 6, 1))
    assert [r["code"] for r in stale.collect()] == ["stale_data"]
    assert Q.data_quality_report(panel.drop("stockout_hours")).first()["code"] == "missing_required_columns"


def test_alignment_failure(panel):
    Q.raise_on_misalignment(Q.config_alignment(panel, DatasetConfig()))
    with pytest.raises(RuntimeError, match="3 series"):
        Q.raise_on_misalignment(Q.config_alignment(panel, DatasetConfig(top_n_series=2)))


def test_profiles_use_whole_panel(spark, panel, tmp_path):
    tables = R.profile_panel(panel)
    store.write_tables(str(tmp_path), {k: tables[k] for k in ("dataset_summary", "weekday_summary")})
    assert spark.read.parquet(f"{tmp_path}/weekday_summary").count() == 7
    assert len(tables) == 12
    s = tables["dataset_summary"].first()
    assert (s["rows"], s["unique_series"], s["median_history_days"]) == (210, 3, 70.0)
    bands = {r["stockout_band"]: r["observations"] for r in tables["stockout_demand_bands"].collect()}
    assert bands == {"0": 72, "0-2": 138, "3-6": 0, "7+": 0}
    gaps = R.series_gap_summary(panel.where("dayofmonth(date) != 10")).first()
    assert gaps["max_gap_days"] == 2 and gaps["missing_days_within_span"] == 3


def test_result_does_not_depend_on_partitioning(panel):
    a = R.weekday_summary(panel.repartition(1)).collect()
    b = R.weekday_summary(panel.repartition(7, "date")).collect()
    assert [(r["weekday"], r["observations"], r["observed_demand_median"]) for r in a] == \
           [(r["weekday"], r["observations"], r["observed_demand_median"]) for r in b]


def test_config_checks():
    for bad in (lambda: DatasetConfig(min_history_days=3, horizon=7), lambda: ModelConfig(quantiles=(0.9, 0.1)),
                lambda: ModelConfig(quantiles=(0.0, 0.5)), lambda: SimulationConfig(retrain_cadences=(None, None)),
                lambda: SimulationConfig(retrain_cadences=(0,)), lambda: PreprocessingConfig(imputation_strategy="x")):
        with pytest.raises(ValueError):
            bad()
    Settings()
