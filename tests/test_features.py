from datetime import date, timedelta

import pytest
from conftest import demand
from pyspark.sql import Observation
from pyspark.sql import functions as F

from shelfcast.config import FeatureConfig, ValidationConfig
from shelfcast.models.naive import seasonal_naive
from shelfcast.operators import features as X
from shelfcast.operators import folds as D
from shelfcast.operators.panel import union_all

CFG = FeatureConfig(lags=(1, 2), rolling_windows=(3,))


def test_lags_targets_and_drop_counts(panel):
    one = panel.where("series_id = '1_101'")
    watch = Observation("drops")
    frame, names = X.supervised_frame(one, CFG, 7, watch)
    rows = {r["date"]: r for r in frame.collect()}
    d = date(2025, 1, 11)
    assert rows[d]["demand_lag_1"] == pytest.approx(demand(1, 9))
    assert rows[d]["demand_roll_mean_3"] == pytest.approx(sum(demand(1, i) for i in (7, 8, 9)) / 3)
    assert rows[d]["target_lead_time_demand"] == pytest.approx(sum(demand(1, i) for i in range(10, 17)))
    assert watch.get["dropped_rows_missing_target"] == 6 and watch.get["dropped_rows_missing_features"] == 3
    assert len(names) == len(set(names))
    assert X.large_drops({"input_rows": 10, "dropped_rows_missing_target": 6, "dropped_rows_missing_features": 0})


def test_later_rows_never_change_earlier_features(panel):
    cut = date(2025, 2, 20)
    names = X.feature_frame(panel, CFG)[1]
    early = X.feature_frame(panel.where(F.col("date") <= cut), CFG)[0]
    spoiled = panel.withColumn("observed_demand", F.when(F.col("date") > cut, F.lit(1e6)).otherwise(F.col("observed_demand")))
    late = X.feature_frame(spoiled, CFG)[0].where(F.col("date") <= cut)
    a = sorted(map(tuple, early.select("series_id", "date", *names).collect()), key=repr)
    b = sorted(map(tuple, late.select("series_id", "date", *names).collect()), key=repr)
    assert a == b


def test_features_take_one_exchange(panel, spark):
    frame, _ = X.supervised_frame(panel, CFG, 7)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


FALL = "series_id string, product_id bigint, third_category_id bigint, date date, observed_demand double"


@pytest.mark.parametrize("donor, level, value", [
    ((5, 1), "product", 8.0), ((6, 1), "third_category", 12.0), ((6, 2), "global", 16.0)])
def test_fallback_levels(spark, donor, level, value):
    mean = value / 2
    rows = [("a_1", donor[0], donor[1], date(2025, 1, i), mean) for i in (1, 2, 3)]
    rows.append(("b_5", 5, 1, date(2025, 1, 3), None))
    p = spark.createDataFrame(rows, FALL)
    got = X.fallback_lookup(p.where("series_id = 'b_5'"), p, 2).first()
    assert (got["fallback_level"], got["fallback_target_lead_time_demand"]) == (level, value)


def test_holdout_is_loud(panel):
    assert X.holdout_frame(panel, None, CFG, 7) is None
    late = panel.where(F.col("date") > date(2025, 3, 8))
    with pytest.raises(ValueError):
        X.holdout_frame(panel.where(F.col("date") <= date(2025, 3, 8)), late, CFG, 7)


def test_folds():
    days = [date(2025, 1, 1) + timedelta(days=i) for i in range(70)]
    folds = D.walk_forward_folds(days, ValidationConfig(initial_train_days=40, n_folds=2, fold_size_days=7), 7)
    assert [f.validation_start_date for f in folds] == [days[40], days[47]]
    assert all((f.validation_start_date - f.train_end_date).days == 7 for f in folds)
    with pytest.raises(ValueError, match="at least"):
        D.walk_forward_folds(days[:50], ValidationConfig(initial_train_days=40, n_folds=2, fold_size_days=7), 7)


def test_calibration_gap(panel):
    sub, cal = D.calibration_split(panel, 21, 7)
    gap = cal.agg(F.min("date")).first()[0] - sub.agg(F.max("date")).first()[0]
    assert gap.days == 8
    whole, none = D.calibration_split(panel, 69, 7)
    assert none is None and whole.count() == 210


def test_temporal_masks_cover_and_do_not_overlap(panel):
    m = D.temporal_masks(panel)
    late = m.where("is_validation").select("date").distinct().count()
    assert late == 23 and m.count() == 210


def test_naive_against_a_loop(panel):
    import math
    for h, p in ((7, 7), (3, 7), (10, 4)):
        got = {r["date"]: r["naive"] for r in seasonal_naive(panel.where("store_id = 2"), h, p).collect()}
        for i in (3, 20, 50):
            lags = [math.ceil((j + 1) / p) * p - j for j in range(h)]
            want = None if any(i - lag < 0 for lag in lags) else sum(demand(2, i - lag) for lag in lags)
            assert got[date(2025, 1, 1) + timedelta(days=i)] == (None if want is None else pytest.approx(want))


def test_as_of_rows_match_slicing(panel):
    gappy = panel.where("pmod(hash(date, store_id), 3) > 0")
    days = [date(2025, 2, 1), date(2025, 2, 2), date(2025, 3, 1)]
    got = {(r["decision_date"], r["series_id"]): r["date"] for r in X.rows_as_of(gappy, days).collect()}
    for d in days:
        want = {r["series_id"]: r[1] for r in gappy.where(F.col("date") <= d).groupBy("series_id").agg(F.max("date")).collect()}
        assert {s: got[(d, s)] for s in want} == want
    assert len(got) == 9


def test_union_fills_missing_columns(panel):
    assert union_all(panel, panel.drop("discount")).where("discount is null").count() == 210
