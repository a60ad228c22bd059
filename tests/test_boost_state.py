"""Boosting: heads side by side, early stopping, and a fit that goes on after its driver was lost."""

import random

import pytest
from pyspark.sql import functions as F

from shelfcast.models import boost as M

NAMES = ["a", "b"]
ARGS = {"target": "y", "quantiles": (0.5,), "point_level": 0.8, "depth": 2, "rate": 0.5, "write_every": 2}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(a := rng.uniform(0, 1), b := rng.uniform(0, 1), 10 * a + 2 * (b > 0.5) + rng.gauss(0, 1)) for _ in range(300)]
    return M.materialise(spark.createDataFrame(data, "a double, b double, y double").repartition(2), "boost-rows")


def total(model, rows):
    return model.predict(rows).agg(F.sum("q_0_5"), F.sum("y_pred")).first()


def counted(monkeypatch, most=None):
    """Count the trees that are fitted; the fit after ``most`` fails as if the driver were lost."""
    fits, fit = [], M.DecisionTreeRegressor.fit

    def run(self, data, params=None):
        if most is not None and len(fits) >= most:
            raise RuntimeError("lost")
        fits.append(self.getSeed())
        return fit(self, data, params)

    monkeypatch.setattr(M.DecisionTreeRegressor, "fit", run)
    return fits


def test_heads_side_by_side_equal_one_after_another(rows):
    one, four = (M.train_boost(rows, NAMES, stages=2, parallel=n, **ARGS) for n in (1, 4))
    assert [h.steps for h in one.heads] == [h.steps for h in four.heads]


def test_a_head_stops_at_its_best_held_out_loss(rows):
    model = M.train_boost(rows, NAMES, stages=40, patience=2, **ARGS)
    assert all(2 <= len(h.trees) < 40 and len(h.trees) == len(h.steps) for h in model.heads)


def test_a_lost_fit_goes_on_from_its_last_block(rows, tmp_path, monkeypatch):
    args = ARGS | {"quantiles": (0.8,)}  # one head
    whole = M.train_boost(rows, NAMES, stages=6, patience=5, **args)
    state = str(tmp_path / "state")
    with monkeypatch.context() as m:
        counted(m, 3)
        with pytest.raises(RuntimeError, match="lost"):
            M.train_boost(rows, NAMES, stages=6, patience=5, state=state, **args)
    with monkeypatch.context() as m:
        fits = counted(m)
        model = M.train_boost(rows, NAMES, stages=6, patience=5, state=state, **args)
        assert fits == [44, 45, 46, 47]  # the first block of two was kept, the third tree was not
    assert [h.steps for h in model.heads] == [h.steps for h in whole.heads]
    want, got = (x.predict(rows).agg(F.sum("y_pred")).first()[0] for x in (whole, model))
    assert got == pytest.approx(want)
    with monkeypatch.context() as m:
        fits = counted(m)
        M.train_boost(rows, NAMES, stages=6, patience=5, state=state, **args)
        assert fits == []
    with pytest.raises(ValueError, match="other settings"):
        M.train_boost(rows, NAMES, stages=6, patience=5, state=state, **args | {"depth": 3})


def test_trees_read_a_cached_matrix_that_is_given_back(spark, rows, monkeypatch):
    plans, fit = [], M.DecisionTreeRegressor.fit

    def run(self, data, params=None):
        plans.append(data._jdf.queryExecution().executedPlan().toString())
        return fit(self, data, params)

    monkeypatch.setattr(M.DecisionTreeRegressor, "fit", run)
    kept = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    M.train_boost(rows, NAMES, stages=2, **ARGS)
    assert len(plans) == 4 and all("InMemoryTableScan" in p for p in plans)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == kept


def test_fits_run_side_by_side_only_to_fill_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    parts = spark.range(1000).repartition(8 * cores)
    assert [M.side_by_side(df, 4) for df in (parts, parts.coalesce(cores), parts.coalesce(1))] == [1, 2, 4]
