import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import skyline as S


def plain(x):
    return np.array([not any((y <= r).all() and (y < r).any() for y in x) for r in x], bool)


def test_front_equals_all_pairs():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 5):
        x = rng.integers(0, 12, (700, d)).astype(float)
        assert (S.front(x) == plain(x)).all()
    line = np.stack([np.arange(600.0), -np.arange(600.0)], axis=1)
    assert S.front(line).all() and S.front(np.concatenate([line, line])).all()
    huge = np.array([[1e16, 1.0], [1e16, 0.0], [1e16, 1.0]])  # sums that rounding makes equal
    assert (S.front(huge) == plain(huge)).all()


def test_a_million_rows_of_three_losses(spark):
    df = spark.range(1_000_000).select("id", *[(F.abs(F.xxhash64(F.lit(i), "id")) % 1_000_003 / 1_000_003.0).alias(c) for i, c in enumerate("abc")])
    got = S.pareto_front(df, ["a", "b", "c"])
    assert got.columns == ["id", "a", "b", "c", "is_on_front"] and got.count() == 1_000_000
    best = np.array([[r[c] for c in "abc"] for r in got.where("is_on_front").collect()])
    assert plain(best).all()
    sample = got.where("id % 500 = 0").collect()
    x = np.array([[r[c] for c in "abc"] for r in sample])
    assert [r["is_on_front"] for r in sample] == list(~S.dominated(x, best))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("block", [20_000, 7])
def test_blocks_nulls_ties_and_keys(spark, monkeypatch, block):
    """Fronts larger than a block, equal rows, missing losses, null keys and a clashing column give the same as all pairs."""
    monkeypatch.setattr(S, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(k, int(v), float(a), float(b), float(a + b) if v % 9 else None) for k in ("x", None, "y") for v, (a, b) in enumerate(rng.integers(0, 9, (60, 2)))]
    rows += [("wide", i, float(i), float(-i), 0.0) for i in range(90)] + [("nan", 1, float("nan"), 0.0, 0.0), ("nan", 2, 5.0, 0.0, -0.0), ("nan", 3, 5.0, 0.0, 0.0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "k string, v int, a double, b double, c double, is_on_front string").repartition(3)
    for losses in (["a", "b"], ["a", "b", "c"]):
        at = [2 + "abc".index(n) for n in losses]
        got = {(r["k"], r["v"]): r["is_on_front"] for r in S.pareto_front(df, losses, ["k"]).collect()}
        assert len(got) == len(rows)
        for k in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == k and all(r[i] is not None and r[i] == r[i] for i in at)]
            on = plain(np.array([[r[i] for i in at] for r in own]))
            want = {(r[0], r[1]): bool(o) for r, o in zip(own, on)}
            assert all(got[x] == want.get(x, False) for x in got if x[0] == k)
    assert S.pareto_front(df.limit(0), ["a"]).count() == 0
