"""Bucketed ranks against plain loops, on skewed groups and heavy ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.functions import ranks
from shelfcast.functions.columns import hash52


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, half of its values are equal, and the rest spans nine decades."""
    rng = np.random.default_rng(3)
    rows = [("hot", 7.0)] * 400 + [("hot", float(v)) for v in 10 ** rng.uniform(-4, 5, 400)]
    rows += [("b", float(v)) for v in rng.normal(0, 1, 60)] + [("c", 1.0), (None, 2.0), (None, 5.0), ("c", None)]
    return spark.createDataFrame(rows, "g string, v double").repartition(5)


def key(rows):
    return sorted((repr(r) for r in rows))


@pytest.mark.parametrize("descending", [False, True])
def test_value_classes_match_a_loop(skewed, descending):
    want = []
    groups = {}
    for r in skewed.where("v is not null").collect():
        groups.setdefault(r["g"], []).append(r["v"])
    for g, values in groups.items():
        for v in set(values):
            before = sum(x > v if descending else x < v for x in values)
            want.append((g, v, values.count(v), before, len(values)))
    got = ranks.value_classes(skewed, ["g"], "v", descending=descending).collect()
    assert sorted(map(repr, want)) == sorted(repr((r["g"], r["v"], r["mass"], r["before"], r["total"])) for r in got)


def test_buckets_follow_the_input(skewed, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 10)
    assert len(ranks.value_edges(skewed.where("v is not null"), "v")) > ranks.FEWEST_BUCKETS


def test_quantiles_match_numpy(skewed):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.995, 1.0]
    got = {r["g"]: r["quantiles"] for r in ranks.quantiles(skewed, ["g"], "v", probs).collect()}
    for g in ("hot", "b"):
        v = [r["v"] for r in skewed.where(F.col("g") == g).collect()]
        assert np.allclose(got[g], np.quantile(v, probs))
    v = [r["v"] for r in skewed.where("v is not null").collect()]
    assert np.allclose(ranks.scalar_quantiles(skewed, "v", probs), np.quantile(v, probs))


def test_kth_smallest(skewed):
    got = {r["g"]: r["x"] for r in ranks.kth_smallest(skewed, ["g"], "v", F.ceil(F.col("total") * 0.8), "x").collect()}
    for g in ("hot", "b"):
        v = sorted(r["v"] for r in skewed.where(F.col("g") == g).collect())
        assert got[g] == v[int(np.ceil(len(v) * 0.8)) - 1]


def test_percentile_ranks_average_ties(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (2.0, 5.0), (4.0, 5.0), (None, 5.0)], "a double, b double")
    got = sorted(((r["a"], r["ra"], r["rb"]) for r in ranks.percentile_ranks(
        df, {"ra": "a", "rb": "b"}).collect()), key=repr)
    assert [g[1] for g in got if g[0] is not None] == pytest.approx([0.0, 0.5, 0.5, 1.0])
    assert all(g[2] == 0.5 for g in got)
    assert [g[1] for g in got if g[0] is None] == [None]


def test_positions_are_a_permutation(skewed):
    df = skewed.where("v is not null").withColumn("id", F.monotonically_increasing_id())
    df = df.sparkSession.createDataFrame(df.collect(), df.schema)
    got = {r["id"]: r["position"] for r in ranks.positions(df, "v", hash52("id")).collect()}
    order = df.select("id", "v", hash52("id").alias("h")).collect()
    assert got == {r["id"]: i for i, r in enumerate(sorted(order, key=lambda r: (-r["v"], r["h"])))}


def test_running_across_buckets(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 300)
    df = spark.createDataFrame([("k", i, i // 37, float(v)) for i, v in enumerate(x)], "k string, i int, b int, x double")
    got = ranks.running(df.repartition(6), ["k"], "b", ["i"], {"s": ("sum", "x"), "lo": ("min", "x")}).orderBy("i").collect()
    assert np.allclose([r["s"] for r in got], np.cumsum(x))
    assert np.allclose([r["lo"] for r in got], np.minimum.accumulate(x))
