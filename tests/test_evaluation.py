import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.config import REPORT_COSTS, REPORT_COVERAGE, BusinessConfig, DriftConfig, InventoryConfig
from shelfcast.models import tuning as U
from shelfcast.operators import backtest as B
from shelfcast.operators import conformal as N
from shelfcast.operators import drift as V
from shelfcast.operators import impute as I
from shelfcast.operators import report as P
from shelfcast.operators.orders import critical_fractile


def test_group_radius(spark):
    rows = [("A", 10.0, 10.0, 8.0, 12.0)] * 5 + [("B", 20.0, 10.0, 8.0, 12.0)] * 5
    df = spark.createDataFrame(rows, "third_category_id string, y_true double, y_pred double, q_0_1 double, q_0_9 double")
    cal = N.calibrate(df, 0.2)
    got = {(r["scope"], r["third_category_id"]): r["q_hat"] for r in cal.collect()}
    assert got[("group", "A")] == 0.0 and got[("group", "B")] == 8.0
    new = df.limit(1).withColumn("third_category_id", F.lit("unseen"))
    assert N.attach_radius(new, cal).first()["q_hat"] == got[("global", None)]
    wide = N.apply_radius(N.attach_radius(df.where("third_category_id = 'B'"), cal)).first()
    assert (wide["q_0_1"], wide["q_0_9"]) == (0.0, 20.0)


def test_radius_is_the_largest_score_for_few_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(3)], "s double")
    assert N.conformal_radius(df, [], "s", 0.2).first()["q_hat"] == 2.0
    low = spark.createDataFrame([(-1.0,)] * 9, "s double")
    assert N.conformal_radius(low, [], "s", 0.2).first()["q_hat"] == 0.0


def test_crossed_quantiles_are_sorted(spark):
    df = spark.createDataFrame([(9.0, 5.0, 7.0)], "q_0_1 double, q_0_5 double, q_0_9 double")
    assert tuple(N.monotone_quantiles(df).first()) == (5.0, 7.0, 9.0)


def loop_psi(ref, cur, bins=10):
    e = np.unique(np.quantile(ref, np.linspace(0, 1, bins + 1)))[1:-1]
    a = np.bincount(np.searchsorted(e, ref, "right"), minlength=len(e) + 1) / len(ref)
    b = np.bincount(np.searchsorted(e, cur, "right"), minlength=len(e) + 1) / len(cur)
    a, b = np.clip(a, 1e-4, None), np.clip(b, 1e-4, None)
    return float(np.sum((b - a) * np.log(b / a)))


def test_psi(spark):
    rng = np.random.default_rng(0)
    ref = rng.normal(0, 1, 500)
    cases = {"same": rng.normal(0, 1, 500), "shifted": rng.normal(2, 1, 500)}
    rows = [(k, float(v), False) for k in cases for v in ref] + [(k, float(v), True) for k, x in cases.items() for v in x]
    rows += [("constant", 1.0, False)] * 20 + [("constant", 5.0, True)] * 20 + [("alone", 1.0, False)]
    df = spark.createDataFrame(rows, "k string, v double, c boolean")
    got = {r["k"]: r for r in V.psi(df, ["k"], "v", "c").collect()}
    for k, x in cases.items():
        assert got[k]["psi"] == pytest.approx(loop_psi(ref, x))
    assert got["same"]["psi"] < 0.2 <= got["shifted"]["psi"]
    assert got["constant"]["psi"] == 0.0 and got["alone"]["psi"] == 0.0
    assert sum(got["same"]["pre"]) == pytest.approx(1.0, abs=1e-3) and len(got["alone"]["pre"]) == 10


def test_feature_drift_ranks_and_types(spark):
    rows = [(date(2025, 1, 1) + timedelta(days=i), float(i), float(i % 2), float((i * 7) % 10)) for i in range(100)]
    df = spark.createDataFrame(rows, "date date, rising double, flag double, still double")
    imp = spark.createDataFrame([("rising", 3.0), ("flag", 1.0), ("still", 2.0), ("absent", 9.0)], "feature string, importance double")
    got = V.feature_drift_report(df, imp, top_n=3).collect()
    assert got[0]["name"] == "rising" and got[0]["status"] == "critical"
    assert {r["name"]: r["type"] for r in got} == {"rising": "numeric", "flag": "binary", "still": "numeric"}


def test_two_valued_feature_is_measured_by_value(spark):
    rows = [(date(2025, 1, 1) + timedelta(days=i), float(i >= 90 or i % 10 == 0)) for i in range(100)]
    df = spark.createDataFrame(rows, "date date, flag double")
    imp = spark.createDataFrame([("flag", 1.0)], "feature string, importance double")
    got = V.feature_drift_report(df, imp).first()
    old, new = 5 / 50, 14 / 50
    want = (new - old) * math.log(new / old) + (old - new) * math.log((1 - new) / (1 - old))
    assert got["type"] == "binary" and got["psi"] == pytest.approx(want, abs=1e-4) and got["status"] == "critical"


def test_page_hinkley_alarm(spark):
    df = spark.createDataFrame([("a", i, i // 7, 1.0 if i < 20 else 10.0) for i in range(40)], "k string, i int, b int, e double")
    cfg = DriftConfig(threshold=5.0, min_instances=10)
    for bucket in (None, "b"):
        out = V.page_hinkley(df, ["k"], ["i"], "e", cfg, bucket).where("is_drift").agg(F.min("ph_n")).first()[0]
        assert 21 <= out <= 30


def test_known_imputations(spark):
    rows = [("s", date(2025, 1, 1), 10.0, 0.0), ("s", date(2025, 1, 2), 9.5, 1.6), ("s", date(2025, 1, 3), 3.0, 12.8)]
    df = spark.createDataFrame(rows, "series_id string, date date, observed_demand double, stockout_hours double")
    teach = lambda d: d.withColumn("teacher_prediction", F.lit(10.0))
    got = [r["latent_demand_est"] for r in I.impute_latent(df, "supervised", teach).orderBy("date").collect()]
    assert got == pytest.approx([10.0, 10.5, 11.0])
    mean = [r["latent_demand_est"] for r in I.impute_latent(df, "historical_mean").orderBy("date").collect()]
    assert mean == [10.0, 10.0, 10.0]
    kept = I.impute_latent(df.where("stockout_hours = 0"), "clipped_scaling").first()
    assert kept["observed_demand"] == 10.0 and not kept["is_imputed"]
    with pytest.raises(ValueError):
        I.impute_latent(df, "supervised")


def test_synthetic_draws(panel):
    draws = I.synthetic_censor(panel, [1, 2]).collect()
    clean = panel.where("stockout_hours = 0").count()
    assert len([d for d in draws if d["seed"] == 1]) == int(clean * 0.3)
    assert {d["severity_hours"] for d in draws} <= {1.0, 2.0}
    assert all(d["censored_demand"] == pytest.approx(d["true_demand"] * (1 - d["severity_hours"] / 16)) for d in draws)
    again = I.synthetic_censor(panel.repartition(7), [1, 2]).collect()
    assert sorted(map(repr, draws)) == sorted(map(repr, again))


def test_draws_need_both_pools(panel):
    with pytest.raises(ValueError, match="clean days"):
        I.synthetic_censor(panel.where("stockout_hours > 0"), [1])


def test_fair_cost_charges_one_truth(panel):
    got = {r["strategy"]: r for r in I.fair_cost(panel, InventoryConfig()).collect()}
    assert set(got) == {"Observed", "Latent_historical_mean", "Latent_clipped_scaling"}
    assert got["Observed"]["n_eval"] == got["Latent_historical_mean"]["n_eval"]


REC = ("series_id string, date date, y_pred double, order_quantity double, prediction_source string, fold_id int, q_0_1 double, "
       "q_0_5 double, q_0_9 double")


def test_first_flag_wins(spark):
    d = date(2025, 1, 1)
    rows = [("1_101_x", d, 5.0, 1.0, "cold_start_fallback", 1, None, None, None), ("2_9", d, 5.0, 2.0, "model", 1, 1.0, 2.0, 3.0),
            ("3_9", d, 5.0, 2.0, "model", 0, 1.0, 2.0, 30.0), ("4_9", d, 5.0, 90.0, "model", 0, 1.0, 2.0, 3.0), ("5_9", d, 5.0, 2.0, "model", 0, 1.0, 2.0, 3.0)]
    rec = P.reorder_recommendations(spark.createDataFrame(rows, REC), BusinessConfig(), [1])
    got = {r["series_id"]: r for r in rec.collect()}
    assert [got[k]["risk_flag"] for k in ("1_101_x", "2_9", "3_9", "4_9", "5_9")] == [
        "cold_start", "drift_watch", "high_uncertainty", "extreme_order_quantity", None]
    assert got["1_101_x"]["product_id"] == "101_x" and got["5_9"]["notes"] is None
    assert P.exceptions(rec).count() == 4
    assert {r["severity"] for r in P.alert_rows(P.exceptions(rec), 9).collect()} == {"critical", "warning"}


def test_report_defaults():
    assert (REPORT_COVERAGE, REPORT_COSTS.stockout_cost, REPORT_COSTS.global_capacity_units) == (0.95, 18.0, 12000.0)
    assert critical_fractile(REPORT_COSTS) == 18.0 / 22.0


def test_sku_table_and_kpis(spark):
    rng = np.random.default_rng(2)
    rows = [(f"{s}", date(2025, 1, 1) + timedelta(days=i), float(v), float(v + e)) for s in "ab"
            for i, (v, e) in enumerate(zip(rng.integers(1, 20, 64), rng.normal(0, 2, 64)))]
    df = spark.createDataFrame(rows, "series_id string, date date, y_true double, y_pred double")
    got = P.sku_table(df).collect()
    for r in got:
        mine = [x for x in rows if x[0] == r["series_id"]]
        resid = np.array([x[2] - x[3] for x in mine])
        width = np.quantile(np.abs(resid), 0.95)
        assert r["coverage_pct"] == pytest.approx(100 * np.mean(np.abs(resid) <= width))
        assert r["trend"] == [x[2] for x in mine[-14:]] and r["drift_psi"] is not None
        assert r["q_star"] == round(min(max(0.0, mine[-1][3] + np.quantile(resid, 18 / 22)), 12000))
    k = P.sku_kpis(df).where("series_id = 'a'").first()
    e = np.abs([x[2] - x[3] for x in rows if x[0] == "a"])
    assert k["mae_delta"] == pytest.approx(e[32:].mean() - e[:32].mean())
    assert P.sku_table(df.where("date < '2025-02-01'")).first()["drift_psi"] is None


def test_status_order(spark):
    df = spark.createDataFrame([(99.0, 0.3), (80.0, None), (99.0, 0.1), (95.0, None)], "c double, p double")
    assert [r[0] for r in df.select(P.sku_status("c", "p", 95.0)).collect()] == ["drift", "shortage", "overstock", "ok"]


def test_origins_and_underpowered(spark):
    rows = []
    for i in range(21):
        for cad, extra in (("never", 10.0), ("every_7d", 8.0 if i % 2 else 9.0)):
            rows.append((cad, date(2025, 1, 1) + timedelta(days=i), i, "a", i < 15, extra, 5.0, 1.0, 0.0))
    df = spark.createDataFrame(rows, "cadence string, decision_date date, day_index int, series_id string, actuals_complete boolean, "
                                     "total_cost double, y_true double, stockout_units double, overstock_units double")
    assert B.independent_origins(df, 7).select("day_index").distinct().count() == 3
    cmp = B.compare_cadences(df, 7, ["never", "every_7d"]).first()
    assert cmp["underpowered"] and not cmp["conclusive"] and cmp["n_origins"] == 3
    assert cmp["cost_change_pct"] == pytest.approx(100 * ((9 - 10) + (8 - 10) + (9 - 10)) / 30)
    assert B.comparison_verdict(B.compare_cadences(df, 7, ["never", "every_7d"])).first()["verdict"] == "underpowered"


def test_t_interval_and_front(spark):
    assert U.t_quantile(0.975, 24) == pytest.approx(2.0639, abs=1e-4)
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 3.0), (3.0, 3.0), (2.0, 4.0), (4.0, 1.0)], "a double, b double")
    front = {(r["a"], r["b"]) for r in U.pareto_front(df, ["a", "b"]).where("is_on_front").collect()}
    assert front == {(1.0, 5.0), (2.0, 3.0), (4.0, 1.0)}
    with pytest.raises(ValueError):
        U.paired_ci(df.limit(1), "a", "b")
