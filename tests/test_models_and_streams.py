from datetime import date, timedelta

import pytest
from conftest import PANEL
from pyspark.sql import functions as F

from shelfcast.config import DatasetConfig, DriftConfig, FeatureConfig, PreprocessingConfig, Settings, SimulationConfig, ValidationConfig
from shelfcast.functions.columns import pinball
from shelfcast.models import tuning as U
from shelfcast.models.boost import train_boost
from shelfcast.models.conformal import ConformalModel, boost_trainer, fit_and_calibrate, forest_trainer
from shelfcast.models.forest import train_forest
from shelfcast.models.teacher import train_teacher
from shelfcast.operators import backtest as B
from shelfcast.operators import impute as I
from shelfcast.operators.drift import page_hinkley
from shelfcast.operators.features import supervised_frame
from shelfcast.plans.experiment import run_experiment
from shelfcast.plans.rolling import champion_trainer, run_rolling_origin
from shelfcast.plans.scoring import score_latest, train_champion
from shelfcast.session import materialise
from shelfcast.sources import store
from shelfcast.streaming.daily import score_batch, stored_days, stream_scoring, sums_table
from shelfcast.streaming.detector import scan_page_hinkley, stream_page_hinkley
from shelfcast.streaming.windows import event_time, lead_time_sums

CFG = Settings(
    dataset=DatasetConfig(top_n_series=None, min_history_days=20), features=FeatureConfig(lags=(1, 7), rolling_windows=(7,)),
    validation=ValidationConfig(initial_train_days=42, n_folds=2, calibration_days=10),
    preprocessing=PreprocessingConfig(imputation_strategy="historical_mean"),
    simulation=SimulationConfig(retrain_cadences=(None, 7), simulation_days=10))


@pytest.fixture(scope="module")
def frame(panel):
    f, names = supervised_frame(panel, CFG.features, 7)
    return f.cache(), names


def test_boosting_lowers_pinball_loss(frame):
    f, names = frame
    y = F.col("target_lead_time_demand")

    def loss(stages):
        m = train_boost(f, names, quantiles=(0.5,), point_level=0.5, stages=stages, depth=3, rate=0.5)
        return m.predict(f).agg(F.avg(pinball(y, "q_0_5", 0.5))).first()[0]

    assert loss(4) < loss(1)


def test_forest_quantiles_are_ordered_and_persist(spark, frame, tmp_path):
    f, names = frame
    model = fit_and_calibrate(f, names, CFG, forest_trainer(5, 3))
    out = model.predict(f)
    assert out.where("q_0_1 > q_0_5 or q_0_5 > q_0_9 or q_0_1 < 0").isEmpty()
    path = str(tmp_path / "m")
    model.save(path)
    back = ConformalModel.load(spark, path).predict(f)
    a = out.orderBy("series_id", "date").select("y_pred", "q_0_9").collect()
    assert a == back.orderBy("series_id", "date").select("y_pred", "q_0_9").collect()
    with pytest.raises(FileNotFoundError):
        ConformalModel.load(spark, path + "-absent")
    share = train_forest(f, names, trees=3, depth=3).importance(spark).agg(F.sum("importance")).first()[0]
    assert share == pytest.approx(1.0)


def test_boost_persists(spark, frame, tmp_path):
    f, names = frame
    m = fit_and_calibrate(f, names, CFG, boost_trainer(2, 2, 0.5))
    m.save(str(tmp_path / "b"))
    want = m.predict(f).agg(F.sum("q_0_9")).first()[0]
    assert ConformalModel.load(spark, str(tmp_path / "b")).predict(f).agg(F.sum("q_0_9")).first()[0] == pytest.approx(want)


def test_teacher_never_sees_stockout_hours(panel):
    t = train_teacher(panel, iterations=2, depth=2)
    a = t(panel).agg(F.sum("teacher_prediction")).first()[0]
    b = t(panel.withColumn("stockout_hours", F.lit(9.0))).agg(F.sum("teacher_prediction")).first()[0]
    assert a == pytest.approx(b)
    got = I.impute_latent(panel, "supervised", t)
    assert got.where("not is_imputed and observed_demand != original_observed_demand").isEmpty()
    assert got.where("is_imputed and observed_demand < original_observed_demand").isEmpty()


def test_experiment_has_both_grains(panel):
    out = run_experiment(panel.where(F.col("date") < date(2025, 3, 5)), CFG, {"forest": forest_trainer(3, 3)})
    v, d = out["validation_predictions"], out["predictions"]
    assert v.groupBy("series_id", "date", "data_strategy", "model_name").count().where("count > 1").isEmpty()
    assert d.groupBy("series_id", "fold_id", "data_strategy", "model_name").count().where("count > 1").isEmpty()
    assert d.count() == v.select("series_id", "fold_id", "data_strategy", "model_name").distinct().count()
    assert {r["data_strategy"] for r in out["cost_summary"].collect()} == {"Observed", "Latent_historical_mean"}


def test_scoring_routes_short_series_to_a_fallback(spark, panel):
    short = [(1, 9, 1, 1, 1, 1, 900, "9_900", date(2025, 3, 11), 4.0, 0.0, 1.0, 0, 0, 0.0, 15.0, 50.0, 3.0)]
    p = panel.unionByName(spark.createDataFrame(short, PANEL))
    out = score_latest(p, train_champion(panel, CFG, forest_trainer(3, 3)), CFG)
    cold = out["reorder_recommendations"].where("series_id = '9_900'").first()
    assert cold["risk_flag"] == "cold_start" and cold["fallback_level"] == "series"
    assert cold["predicted_lead_time_demand"] == 28.0 and cold["order_quantity"] == 28.0
    assert out["predictions"].count() == 4


def test_rolling_origin_uses_the_row_of_the_day(spark, panel, tmp_path):
    seen = []

    def trainer(history):
        seen.append(history.agg(F.max("date")).first()[0])
        return lambda df: df.withColumns({"y_pred": F.col("demand_lag_1"), "q_0_1": F.lit(0.0), "q_0_5": F.lit(1.0), "q_0_9": F.lit(2.0)})

    cut = date(2025, 2, 25)
    run = run_rolling_origin(panel.where(F.col("date") < cut), panel.where(F.col("date") >= cut), CFG, trainer)
    out = run.predictions_by_day
    assert out.where("date != decision_date").isEmpty() and out.count() == 2 * 10 * 3
    assert sorted(seen) == [cut - timedelta(days=1), cut + timedelta(days=6)]
    assert run.retrain_events.count() == 1
    done = {r["day_index"]: r["actuals_complete"] for r in out.select("day_index", "actuals_complete").distinct().collect()}
    assert done[0] and done[8] and not done[9]
    root = str(tmp_path / "sim")
    store.write_origin_backtest(root, out, run.cadence_summary, run.cadence_comparison, run.retrain_events)
    assert spark.read.parquet(f"{root}/predictions_by_day").count() == out.count()
    assert spark.read.json(f"{root}/retrain_events").first()["cadence"] == "every_7d"


def test_versions_meet_origins_in_one_scan(spark, panel):
    """One scorer for all versions reads the origins once; scorers by version open the days that they serve only."""
    days = [date(2025, 2, 20) + timedelta(days=i) for i in range(12)]
    origins = panel.where(F.col("date").isin(days)).withColumn("day_index", F.datediff("date", F.lit(days[0])))
    origins = materialise(origins, "origins", partition_by="day_index")
    serving = B.serving_table(spark, 12, [None, 1, 5])
    assert serving.count() == 36 and serving.where("cadence = 'every_5d' and model_version = 9").count() == 3
    one = B.score_versions(origins, serving, lambda df: df.withColumn("y_pred", F.col("model_version") * 1.0))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "NestedLoop" not in plan
    read = []

    def scorer(v):
        def score(df):
            read.append((v, sorted(r[0] for r in df.select("day_index").distinct().collect()), df._jdf.queryExecution().executedPlan().toString()))
            return df.withColumn("y_pred", F.lit(float(v)))
        return score

    each = B.score_versions(origins, serving, {v: scorer(v) for v in range(-1, 12)})
    key = ["cadence", "day_index", "series_id", "y_pred", "model_version", "retrained_this_step"]
    assert sorted(map(tuple, one.select(*key).collect())) == sorted(map(tuple, each.select(*key).collect())) and one.count() == 36 * 3
    assert all("PartitionFilters: [" in plan and "PartitionFilters: []" not in plan for _, _, plan in read)
    assert {v: d for v, d, _ in read}[4] == [4, 5, 6, 7, 8] and {v: d for v, d, _ in read}[3] == [3]


def test_rolling_champion_and_causal_regimes(panel):
    cut = date(2025, 2, 25)
    slow = panel.withColumn("observed_demand", F.when((F.col("store_id") == 2) & (F.col("date") < cut), 0.0).otherwise(F.col("observed_demand")))
    run = run_rolling_origin(slow.where(F.col("date") < cut), slow.where(F.col("date") >= cut), CFG, champion_trainer(CFG, forest_trainer(2, 2)))
    out = run.predictions_by_day
    assert out.where("y_pred is null or q_0_1 > q_0_5 or q_0_5 > q_0_9").isEmpty() and out.count() == 2 * 10 * 3
    assert {(r["cadence"], r["model_version"]) for r in out.select("cadence", "model_version").distinct().collect()} == {("never", -1), ("every_7d", -1), ("every_7d", 6)}
    labels = {(r["day_index"], r["velocity_regime"]) for r in out.where("series_id = '2_102'").collect()}
    assert (0, "slow_moving") in labels and (9, "fast_moving") in labels


def test_listed_dates_between():
    from shelfcast.operators.features import listed_between
    from pyspark.sql import SparkSession
    spark, days = SparkSession.getActiveSession(), [date(2025, 1, 1), date(2025, 1, 2), date(2025, 1, 9), date(2025, 2, 1)]
    around = [date(2024, 12, 25) + timedelta(days=i) for i in range(50)]
    df = spark.createDataFrame([(a, b) for a in around for b in around[::3]], "a date, b date")
    for r in df.withColumn("got", listed_between(days[::-1], F.col("a"), F.col("b"))).collect():
        assert (r["got"] or []) == [d for d in days if r["a"] <= d < r["b"]]


def stream_of(spark, df, path):
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, out):
    q = (df.writeStream.format("parquet").option("path", f"{out}/r").option("checkpointLocation", f"{out}/c").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{out}/r")


def test_stream_windows_equal_batch(spark, panel, tmp_path):
    src = panel.select("series_id", F.col("date").cast("timestamp").alias("ts"), "observed_demand").coalesce(1)
    got = drain(lead_time_sums(event_time(stream_of(spark, src, str(tmp_path / "in")), "ts", "0 seconds"), "ts", ["series_id"],
                               "observed_demand", 7), str(tmp_path / "out"))
    rows = {(r["series_id"], r["decision_date"]): r["y_true"] for r in got.where("rows_observed = 7").collect()}
    want = supervised_frame(panel, CFG.features, 7)[0].collect()
    shared = [r for r in want if (r["series_id"], r["date"]) in rows]
    assert len(shared) > 100
    assert all(rows[(r["series_id"], r["date"])] == pytest.approx(r["target_lead_time_demand"]) for r in shared)


def test_stream_detector_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(k, i, 1.0 + (i % 3) if i < 30 else 9.0) for k in "ab" for i in range(60)], "k string, i int, e double")
    cfg = DriftConfig(threshold=5.0, min_instances=10)
    path = str(tmp_path / "in")
    for part in range(3):
        df.where(f"i >= {part * 20} and i < {part * 20 + 20}").coalesce(1).write.mode("append").parquet(path)
        import time
        time.sleep(1.1)
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r["k"], r["i"]): r["ph_score"] for r in drain(stream_page_hinkley(s, "k", ["i"], "e", cfg), str(tmp_path / "out")).collect()}
    want = {(r["k"], r["i"]): r["ph_score"] for r in page_hinkley(df, ["k"], ["i"], "e", cfg).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_scanned_detector_goes_on_from_its_state(spark, tmp_path):
    """Batches with a key of any length, run again after a failure, equal one pass; the scan reads its input once."""
    rows = [(k, i, i // 13, float((i * 7919 + ord(k)) % 23) + (9.0 if i > 400 else 0.0)) for k in "ab" for i in range(600)] + [("c", 700, 60, 5.0)]
    df = spark.createDataFrame(rows, "k string, i int, b int, e double")
    cfg = DriftConfig(threshold=50.0, min_instances=10)
    want = {(r["k"], r["i"]): (r["ph_n"], r["ph_score"], r["is_drift"]) for r in page_hinkley(df, ["k"], ["i"], "e", cfg).collect()}
    whole = page_hinkley(df, ["k"], ["i"], "e", cfg, bucket="b")
    root = str(tmp_path)
    for part in (df.where("i < 220"), df.where("i >= 220 and i < 221"), df.limit(0), df.where("i >= 221")):
        part.write.mode("append").parquet(f"{root}/in")
        scan_page_hinkley(spark.readStream.schema(df.schema).parquet(f"{root}/in"), ["k"], ["i"], "e", "b", root, f"{root}/c", cfg, buckets=2).awaitTermination()
    for got in (whole, spark.read.parquet(f"{root}/scores")):
        got = {(r["k"], r["i"]): (r["ph_n"], r["ph_score"], r["is_drift"]) for r in got.collect()}
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
    assert any(d for _, _, d in want.values())
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "LocalTableScan" not in plan


def test_daily_stream_scores_touched_series(spark, panel, tmp_path):
    model = train_champion(panel, CFG, forest_trainer(2, 2))
    days, root = str(tmp_path / "days"), str(tmp_path / "root")
    one = panel.where("store_id = 1").drop("series_id")
    import time
    one.where(F.col("date") < date(2025, 2, 1)).coalesce(1).write.parquet(days)
    time.sleep(1.1)
    one.where(F.col("date") == date(2025, 2, 1)).coalesce(1).write.mode("append").parquet(days)
    s = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(days)
    stream_scoring(s, root, model, CFG, str(tmp_path / "ckpt"), retrain=lambda h: model, every=2).awaitTermination()
    rec = spark.read.parquet(f"{root}/recommendations")
    last = rec.where("batch_id = 1").first()
    assert last["decision_date"] == date(2025, 2, 1) and last["prediction_source"] == "model"
    assert spark.read.parquet(f"{root}/retrain_events").count() == 1


class Lag:
    """A model without learning: yesterday's demand."""

    model_name, backend_name = "lag", "none"

    def predict(self, rows):
        return rows.withColumns({"y_pred": F.col("demand_lag_1"), "q_0_1": F.lit(0.0), "q_0_5": F.col("demand_lag_1"), "q_0_9": F.col("demand_lag_1") * 2})


def test_daily_state_equals_the_whole_panel(spark, panel, tmp_path):
    """Batch by batch, run again after a failure, with late rows: each batch scores as ``score_latest`` does on all days so far."""
    root, cuts = str(tmp_path), [date(2025, 2, 10), date(2025, 3, 1), date(2025, 3, 12)]
    lo = date(2024, 1, 1)
    rows = panel.withColumn("observed_demand", F.when(F.col("store_id") != 2, F.col("observed_demand")))
    for n, hi in enumerate(cuts):
        batch = rows.where((F.col("date") >= lo) & (F.col("date") < hi) & ((F.col("store_id") != 3) | (F.lit(n) != 1))).drop("series_id")
        late = rows.where((F.col("store_id") < 3) & (F.col("date") < lo) & (F.col("date") >= lo - timedelta(days=2))).drop("series_id").withColumn("observed_demand", F.lit(99.0))
        for _ in range(2):  # the second time as after a failure
            score_batch(batch.unionByName(late), root, Lag(), CFG, 2 * n, buckets=4)
        so_far = rows.where((F.col("date") < hi) & ((F.col("store_id") != 3) | (F.col("date") < cuts[0]) | (F.lit(n) == 2) & (F.col("date") >= cuts[1])))
        want = score_latest(so_far, Lag(), CFG, check=False)["predictions"]
        cols = ["series_id", "date", "prediction_source", "fallback_level", "velocity_regime", "stockout_regime"]
        got = spark.read.parquet(f"{root}/predictions/batch_id={2 * n}")
        touched = {r["series_id"] for r in got.collect()}
        assert touched == ({"1_101", "2_102", "3_103"} if n != 1 else {"1_101", "2_102"})
        want = want.where(F.col("series_id").isin(list(touched)))
        assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(tuple(r) for r in want.select(*cols).collect())
        y = {r["series_id"]: (r["y_pred"], r["order_quantity"]) for r in want.collect()}
        assert all((r["y_pred"], r["order_quantity"]) == pytest.approx(y[r["series_id"]]) for r in got.collect())
        lo = hi
    stored = stored_days(spark, root, 99)
    assert stored.count() == stored.select("series_id", "date").distinct().count() and stored.where("observed_demand = 99").isEmpty()
    assert stored_days(spark, root, 99, late=True).where("observed_demand = 99").count() == 8
    sums = sums_table(spark, root, 4)
    assert sums.versions() == [2, 4]
    assert sums.read(5).where("scope = 'global'").first()["demand_n"] == stored.where("observed_demand is not null").count()


def test_runs_round_trip(spark, panel, tmp_path):
    root = str(tmp_path / "runs")
    df = spark.createDataFrame([("Observed", "m", "b", 1.0)], "data_strategy string, model_name string, backend_name string, y_pred double")
    store.write_run(root, "a_20240101_000000", {"predictions": df}, CFG)
    store.write_run(root, "a_20240102_000000", {"predictions": df.withColumn("y_pred", F.lit(2.0))}, CFG)
    assert store.latest_run(spark, root, ["predictions"]) == "a_20240102_000000"
    assert store.latest_run(spark, root, ["predictions", "absent"]) is None
    assert store.read_champion_predictions(spark, root, "Observed", "m", "b").first()["y_pred"] == 2.0
    assert store.read_csv_artifact(spark, root + "/none.csv", "a int").isEmpty()
