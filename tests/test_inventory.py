import random

import pytest
from pyspark.sql import functions as F

from shelfcast.config import BusinessConfig, InventoryConfig
from shelfcast.operators import capacity as K
from shelfcast.operators import costs as C
from shelfcast.operators import ledger as L
from shelfcast.operators import metrics as M
from shelfcast.operators import orders as O
from shelfcast.operators import promote as T


def test_order_interpolates_at_the_fractile(spark):
    df = spark.createDataFrame([(8.0, 10.0, 12.0, 10.0)], "q_0_1 double, q_0_5 double, q_0_9 double, y_pred double")
    assert O.critical_fractile(InventoryConfig()) == 0.8
    assert O.order_quantity(df).first()["order_quantity"] == pytest.approx(11.5)
    none = df.withColumns({q: F.lit(None).cast("double") for q in ("q_0_1", "q_0_5", "q_0_9")})
    assert O.order_quantity(none).first()["order_quantity"] == 10.0


def test_inventory_position_and_clip(spark):
    df = spark.createDataFrame([(10.0, 4.0, 1.0), (10.0, 30.0, None)], "y_pred double, st double, oo double")
    got = [r["order_quantity"] for r in O.order_quantity(df, stock="st", on_order="oo").orderBy("st").collect()]
    assert got == [5.0, 0.0]
    free = O.order_quantity(df, InventoryConfig(clip_negative_orders=False), stock="st").orderBy("st").collect()
    assert free[1]["order_quantity"] == -20.0


def test_profile_must_cover_every_series(spark):
    cfg = InventoryConfig(use_series_costs=True)
    preds = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "series_id string, y_pred double")
    prof = spark.createDataFrame([("a", 1.0, 4.0, 0.8)], "series_id string, c_over double, c_under double, critical_fractile double")
    with pytest.raises(Exception, match="missing or repeats"):
        C.attach_series_costs(preds, cfg, prof).collect()
    with pytest.raises(ValueError):
        C.attach_series_costs(preds, cfg)
    assert C.attach_series_costs(preds).first()["critical_fractile"] == 0.8


CAP = "series_id string, order_quantity double, q_0_1 double, q_0_5 double, q_0_9 double, c_under double, c_over double"
Q = ["q_0_1", "q_0_5", "q_0_9"]


def test_capacity_fixtures(spark):
    same = spark.createDataFrame([("a", 10.0, 2.0, 6.0, 10.0, 4.0, 1.0), ("b", 10.0, 2.0, 6.0, 10.0, 4.0, 1.0)], CAP)
    got = [r["allocated"] for r in K.capacity_allocate(same, 10.0, [], Q).collect()]
    assert sum(got) == pytest.approx(10) and min(got) >= 2
    uneven = spark.createDataFrame([("a", 10.0, 2.0, 6.0, 10.0, 2.0, 1.0), ("b", 10.0, 2.0, 6.0, 10.0, 20.0, 1.0)], CAP)
    got = {r["series_id"]: r["allocated"] for r in K.capacity_allocate(uneven, 10.0, [], Q).collect()}
    assert got["b"] > got["a"] and sum(got.values()) == pytest.approx(10)
    assert [r["allocated"] for r in K.capacity_allocate(same, 50.0, [], Q).collect()] == [10.0, 10.0]


def segments(cap, quantiles, under, over):
    out, left, level0, prev = [], max(0.0, cap), 0.0, 0.0
    for level, value in quantiles:
        w = min(max(0.0, value - prev), left)
        out.append((w, under - (under + over) * (level0 + level) / 2))
        left, level0, prev = left - w, level, value
    return [*out, (left, under - (under + over) * level0)]


def test_capacity_reaches_the_best_value(spark):
    """Total value equals a unit-by-unit greedy fill, on random small cases."""
    rng = random.Random(7)
    rows, best, cap = [], {}, 9.0
    for g in range(8):
        units = []
        for s in range(3):
            q = sorted(float(rng.randint(0, 6)) for _ in range(3))
            want, cu, co = float(rng.randint(1, 8)), float(rng.randint(1, 9)), float(rng.randint(1, 4))
            rows.append((g, f"s{s}", want, *q, cu, co))
            for w, v in segments(want, list(zip((0.1, 0.5, 0.9), q)), cu, co):
                units += [v] * int(w)
        total = sum(r[2] for r in rows if r[0] == g)
        best[g] = None if total <= cap else sum(sorted((v for v in units if v > 0), reverse=True)[:int(cap)])
    df = spark.createDataFrame(rows, "g int, " + CAP)
    got = K.capacity_allocate(df, cap, ["g"], Q).collect()
    for g in best:
        mine = [r for r in got if r["g"] == g]
        if best[g] is None:
            assert all(r["allocated"] == r["order_quantity"] for r in mine)
            continue
        worth = 0.0
        for r in mine:
            left = r["allocated"]
            for w, v in sorted(segments(r["order_quantity"], list(zip((0.1, 0.5, 0.9), (r["q_0_1"], r["q_0_5"], r["q_0_9"]))),
                                        r["c_under"], r["c_over"]), key=lambda x: -x[1]):
                worth += min(w, left) * v
                left -= min(w, left)
        assert worth == pytest.approx(best[g])
        assert sum(r["allocated"] for r in mine) <= cap + 1e-9


LED = ("model_name string, backend_name string, data_strategy string, series_id string, fold_id int, date date, y_true double, "
       "y_pred double, c_over double, c_under double, critical_fractile double")


def test_ledger_worked_example(spark):
    """Demand 55, 60, 50 with arrivals 0, 72, 125 costs 220 + 172 + 32."""
    rows = [("m", "b", "s", "x", 0, "2025-01-01", 55.0, 72.0, 1.0, 4.0, 0.8), ("m", "b", "s", "x", 1, "2025-01-08", 60.0, 70.0, 1.0, 4.0, 0.8),
            ("m", "b", "s", "x", 2, "2025-01-15", 50.0, 60.0, 1.0, 4.0, 0.8), ("m", "b", "s", "x", 0, "2024-12-30", 1.0, 1.0, 1.0, 4.0, 0.8)]
    df = spark.createDataFrame(rows, LED.replace("date date", "date string")).withColumn("date", F.to_date("date"))
    got = L.simulate_ledger(df, InventoryConfig()).orderBy("fold_id").collect()
    assert [r["sim_arrivals"] for r in got] == [0.0, 72.0, 125.0]
    assert [r["sim_total_cost"] for r in got] == [220.0, 172.0, 32.0]


def loop(rows, clip=True):
    """Plain loop over one series: (fold, level, demand, c_over, c_under)."""
    on_hand = backlog = 0.0
    pending, out = [], []
    for f, s, y, co, cu in rows:
        arrivals = sum(q for due, q in pending if due == f)
        pending = [(due, q) for due, q in pending if due != f]
        order = s - (on_hand - backlog + sum(q for _, q in pending))
        order = max(order, 0.0) if clip else order
        on_hand += arrivals
        filled = min(on_hand, backlog)
        on_hand, backlog = on_hand - filled, backlog - filled
        served = min(on_hand, y)
        on_hand, backlog = on_hand - served, backlog + y - served
        pending.append((f + 1, order))
        out.append((f, order, on_hand, backlog, on_hand * co + backlog * cu))
    return out


def test_ledger_against_a_loop(spark):
    rng = random.Random(5)
    data, want = [], {}
    for s in range(12):
        folds = [f for f in range(6) if rng.random() < 0.8] + [999]
        rows = [(f, float(rng.randint(0, 90)), float(rng.randint(0, 90)), 1.0, 4.0) for f in folds]
        want[f"s{s}"] = loop(rows)
        data += [("m", "b", "s", f"s{s}", f, f"2025-01-{(i % 27) + 1:02d}", y, lv, co, cu, 0.8) for i, (f, lv, y, co, cu) in enumerate(rows)]
    df = spark.createDataFrame(data, LED.replace("date date", "date string")).withColumn("date", F.to_date("date"))
    free = L.simulate_ledger(df, InventoryConfig())
    loose = L.simulate_ledger(df, InventoryConfig(global_capacity_units=1e9))
    for out in (free, loose):
        got = {}
        for r in out.orderBy("series_id", "fold_id").collect():
            got.setdefault(r["series_id"], []).append((r["fold_id"], r["order_quantity"], r["sim_on_hand"], r["sim_backlog"], r["sim_total_cost"]))
        assert got == want
    tight = L.simulate_ledger(df, InventoryConfig(global_capacity_units=100.0))
    assert tight.groupBy("fold_id").agg(F.sum("order_quantity").alias("t")).agg(F.max("t")).first()[0] <= 100 + 1e-6


def test_sensitivity_scales_costs_and_skips_holdout(spark):
    df = spark.createDataFrame([("m", 0, 10.0, 8.0, 4.0, 8.0, 12.0), ("m", 999, 10.0, 0.0, 4.0, 8.0, 12.0)],
                               "model_name string, fold_id int, y_true double, y_pred double, q_0_1 double, q_0_5 double, q_0_9 double")
    got = {r["ratio"]: r["stockout_cost"] for r in O.cost_sensitivity(df, ratios=[1.0, 4.0]).collect()}
    assert got[1.0] == pytest.approx(2.0) and got[4.0] == 0.0
    assert O.cost_sensitivity(df, ratios=[1.0], include_holdout=True).first()["stockout_cost"] == pytest.approx(4.0)


SUM = "data_strategy string, model_name string, backend_name string, total_cost double, service_level double"


def test_promotion_and_registry(spark):
    cfg = BusinessConfig(champion_model_name="a", champion_backend_name="a", champion_data_strategy="Observed")
    s = spark.createDataFrame([("Observed", "a", "a", 100.0, 0.9), ("Observed", "b", "b", 80.0, 0.89), ("Observed", "c", "c", 70.0, 0.5)], SUM)
    d = T.promotion_decision(s, cfg)
    r = d.first()
    assert r["promote"] and r["challenger_model_name"] == "b" and r["cost_improvement_pct"] == pytest.approx(20.0)
    reg = T.registry_update(s, d, cfg)
    assert reg.first()["model_name"] == "b"
    reg = spark.createDataFrame(reg.collect(), reg.schema)
    again = T.promotion_decision(s, cfg, reg)
    assert again.first()["champion_source"] == "registry" and not again.first()["promote"]
    assert T.registry_update(s, again, cfg, reg).isEmpty()
    none = T.promotion_decision(s.where("model_name = 'a'"), cfg)
    assert none.isEmpty() and T.registry_update(s, none, cfg).first()["reason"].startswith("Registry bootstrapped")


def test_metrics(spark):
    df = spark.createDataFrame([(10.0, 11.0, 8.0, 12.0), (20.0, 19.0, 18.0, 22.0), (30.0, 31.0, 28.0, 32.0)],
                               "y_true double, y_pred double, q_0_1 double, q_0_9 double")
    df = df.withColumns({"model_name": F.lit("m"), "backend_name": F.lit("b"), "fold_id": F.lit(0)})
    r = M.summarize_predictions(df).where("fold_id is null").first()
    assert (r["interval_coverage"], r["interval_width"], r["mae"]) == (1.0, 4.0, 1.0)
    assert r["winkler_score"] == pytest.approx(4.0)
    for y in (15.0, 5.0):
        out = df.limit(1).withColumns({"y_true": F.lit(y), "q_0_1": F.lit(8.0), "q_0_9": F.lit(12.0)})
        assert M.summarize_predictions(out).first()["winkler_score"] == pytest.approx(34.0)
    held = M.summarize_predictions(df.withColumn("fold_id", F.lit(999))).collect()
    assert [x["fold_id"] for x in held] == [999]


