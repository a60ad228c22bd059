"""The imputer search: draws beside the panel against censored copies of it, the race, and the gates."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from shelfcast.models import imputer_search as S
from shelfcast.models.teacher import SERIES_MEAN, assembled, boosted, calendar_inputs, train_teacher
from shelfcast.operators import impute as I

SMALL = {"iterations": 3, "depth": 2, "step": 0.3}
SEEDS = [5, 6]


@pytest.fixture(scope="module")
def draws(panel):
    return I.materialise(I.synthetic_censor(panel, SEEDS), "draws")


def test_means_are_those_of_the_censored_panel(panel, draws):
    copies = I.censored_panel(panel, draws).where(I.is_clean()).groupBy("seed", "series_id").agg(F.avg("observed_demand").alias("m"))
    want = {(r["seed"], r["series_id"]): r["m"] for r in copies.collect()}
    got = {(r["seed"], r["series_id"]): r["clean_mean"] for r in I.draw_means(panel, draws).collect()}
    assert got and got == pytest.approx({k: want[k] for k in got})


def test_a_series_without_a_clean_day_left_takes_the_mean_of_the_others(panel):
    one = panel.where(I.is_clean() & (F.col("series_id") == "1_101"))
    all_out = one.select(F.lit(1).alias("seed"), "series_id", "date", F.col("observed_demand").alias("true_demand"), F.lit(4.0).alias("severity_hours"),
                         F.lit(1.0).alias("censored_demand"))
    others = panel.where(I.is_clean() & (F.col("series_id") != "1_101")).agg(F.avg("observed_demand")).first()[0]
    assert [r["clean_mean"] for r in I.draw_means(panel, all_out).collect()] == [pytest.approx(others)]


def test_a_fit_on_the_matrix_equals_one_on_the_censored_panel(panel, draws):
    matrix = S.draw_matrix(panel, draws, SEEDS)
    for i, seed in enumerate(SEEDS):
        one = draws.where(F.col("seed") == seed)
        copy = I.censored_panel(panel, one, [seed]).drop("seed")
        teacher = train_teacher(copy.drop("true_demand"), **SMALL, seed=42)
        est = I.estimates(copy, ["supervised"], teacher).where("true_demand is not null")
        want = est.agg(F.avg(F.abs(F.col("latent_supervised") - F.col("true_demand"))), F.count(F.lit(1))).first()
        assert matrix.error(i, boosted(matrix.training(i), **SMALL, seed=42)) == (pytest.approx(want[0]), want[1])
        errors = I.draw_errors(panel, one, ["supervised", "none"], teacher).where("strategy = 'supervised'").first()
        assert errors["mae"] == pytest.approx(want[0])


def test_the_matrix_holds_each_clean_day_once(panel, draws):
    assert S.draw_matrix(panel, draws, SEEDS).clean.count() == panel.where(I.is_clean()).count()


def test_a_hopeless_setting_leaves_the_race():
    asked = []

    def run(jobs):
        asked.extend(jobs)
        return {(t, d): (10.0 * t + 0.1 * ((d * 7 + t) % 3), 4) for t, d in jobs}

    scores, seen = S.race(run, 3, range(9), after=3)
    assert seen == {0: 9, 1: 3, 2: 3}
    assert len(asked) == len(set(asked)) == len(scores) == 9 + 3 + 3
    _, all_seen = S.race(run, 3, range(9), after=None)
    assert all_seen == {0: 9, 1: 9, 2: 9}


def test_equal_settings_stay_to_the_end():
    _, seen = S.race(lambda jobs: {(t, d): (1.0 + d, 1) for t, d in jobs}, 2, range(6), after=2)
    assert seen == {0: 6, 1: 6}


def test_imputer_gates(panel):
    weak = {"iterations": 1, "depth": 1, "step": 0.1}
    found = S.tune_imputer(panel, [SMALL], incumbent=weak, n_selection=3, n_validation=2, default=weak, race_after=2)
    trials = found.trials.orderBy("trial_number").collect()
    assert [r["trial_number"] for r in trials] == [0, 1, 2] and sum(r["is_selected"] for r in trials) == 1
    best = [r["best_so_far"] for r in trials if r["best_so_far"] is not None]
    assert best == sorted(best, reverse=True)
    d = found.decision.first()
    assert d["persisted"] == (d["beats_default"] and d["beats_incumbent"] is not False)
    assert d["incumbent_removed"] == (not d["beats_default"])
    per = {r["phase"]: r["n"] for r in found.errors.where(F.col("trial_number") == d["trial_number"]).groupBy("phase").agg(F.count("mae").alias("n")).collect()}
    assert per == {"selection": 3, "validation": 2}


def test_too_few_draws_are_refused(panel):
    with pytest.raises(ValueError, match="two validation draws"):
        S.tune_imputer(panel, [SMALL], n_validation=1)


@pytest.fixture(scope="module")
def wide_panel(spark):
    """Sixty series of 120 days, with more distinct discounts and series means than a tree has bins, a day that comes twice and demand that is missing."""
    days = spark.range(60 * 120).selectExpr(
        "concat('s', id % 60) AS series_id", "date_add(date'2025-01-01', cast(id div 60 AS int)) AS date", "id % 60 AS k", "id * 7919 % 104729 / 104729.0D AS u", "id AS id")
    rows = days.selectExpr("series_id", "date", "if(id = 1234, null, 5D + k % 17 + 8D * u + weekday(date)) AS observed_demand", "cast(id % 5 = 0 AS double) * (4D + id % 3) AS stockout_hours",
                           "1D - round(u * 0.3D, 3) AS discount", "cast(weekday(date) = 6 AS double) AS holiday_flag")
    return I.materialise(rows.unionByName(rows.where("series_id = 's7' AND date < '2025-01-20'").withColumn("discount", F.lit(0.5))), "wide-panel")


def test_nested_draws_are_those_of_the_table(wide_panel, monkeypatch):
    late = F.col("date") >= "2025-03-01"
    one = I.synthetic_censor(wide_panel, SEEDS, mask=~late).unionByName(I.synthetic_censor(wide_panel, [7], mask=late)).cache()
    asked = lambda: I.long_draws(I.synthetic_censor(I.synthetic_censor(wide_panel, SEEDS, mask=~late, nested=True), [7], mask=late, nested=True))
    want = sorted(map(str, (tuple(r[n] for n in one.columns) for r in one.collect())))
    assert sorted(map(str, (tuple(r[n] for n in one.columns) for r in asked().collect()))) == want
    monkeypatch.setattr(I, "SURE", 0.0)  # the span misses, so all hashes are ranked
    assert sorted(map(str, (tuple(r[n] for n in one.columns) for r in asked().collect()))) == want
    monkeypatch.setattr(I, "LISTED", 1)  # severities by a join
    got = asked().distinct().collect()
    assert sorted({str(tuple(r[n] for n in one.columns)) for r in got}) == sorted(set(want))


def test_fits_learn_from_cells_what_they_learn_from_the_days(wide_panel):
    draws = I.materialise(I.synthetic_censor(wide_panel, SEEDS), "draws")
    matrix = S.draw_matrix(wide_panel, draws, SEEDS)
    clean = wide_panel.where(I.is_clean() & F.col("observed_demand").isNotNull())
    for i, seed in enumerate(SEEDS):
        cells = matrix.training(i)
        left = clean.join(draws.where(F.col("seed") == seed), ["series_id", "date"], "left_anti")
        want = left.agg(F.count(F.lit(1)), F.sum("observed_demand")).first()
        got = cells.agg(F.sum("__w"), F.sum(F.col("__w") * F.col("__y"))).first()
        assert got[0] == want[0] and got[1] == pytest.approx(want[1])
        means = I.draw_means(wide_panel, draws).where(F.col("seed") == seed).select("series_id", F.col("clean_mean").alias(SERIES_MEAN))
        rows = assembled(calendar_inputs(left.join(means, "series_id")), matrix.inputs).select("__x", F.col("observed_demand").alias("__y"))
        model = boosted(rows, **SMALL, seed=42)
        drawn = draws.where(F.col("seed") == seed).join(means, "series_id").join(calendar_inputs(wide_panel).drop("observed_demand", "stockout_hours"), ["series_id", "date"])
        off = F.col("censored_demand") + I.stockout_share(F.col("severity_hours")) * F.greatest(F.col("teacher_prediction"), F.lit(0.0)) - F.col("true_demand")
        r = model.transform(assembled(drawn, matrix.inputs)).agg(F.avg(F.abs(off)), F.count(F.lit(1))).first()
        assert matrix.error(i, boosted(cells, **SMALL, seed=42)) == (pytest.approx(r[0]), r[1])


def test_a_search_builds_the_panel_once_and_fits_cells(wide_panel, monkeypatch):
    built, bins = wide_panel.sparkSession.sparkContext.accumulator(0), []
    seen = F.udf(lambda v: (built.add(1), v)[1], "string").asNondeterministic()
    fit = S.boosted

    def run(rows, **settings):
        bins.append(rows.agg(F.max(F.array_max(vector_to_array("__x")))).first()[0])
        return fit(rows, **settings)

    monkeypatch.setattr(S, "boosted", run)
    many = wide_panel.withColumn("discount", F.round("discount", 1)).withColumn("series_id", seen("series_id"))
    found = S.tune_imputer(many, [], n_selection=1, n_validation=2, default={"iterations": 1, "depth": 1, "step": 0.1}, race_after=None)
    assert found.errors.count() == 3 and built.value == wide_panel.count()
    assert len(bins) == 3 and max(bins) < 32
