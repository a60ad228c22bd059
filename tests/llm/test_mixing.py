"""The mix against a plain computation of its targets, and what every draw must keep to."""

import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from shelfcast.llm import mixing  # noqa: E402
from shelfcast.llm.rows import numbered  # noqa: E402
from shelfcast.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return build_session("llm-tests", master="local[4]", shuffle_partitions=4, driver_memory="4g")


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Source to target: pour by weight, stop what is full, pour the rest again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        give = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s, g in give.items():
            target[s] += g
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def check(docs, got):
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += size_of(text)
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=repr) == sorted(((i, size_of(t)) for i, t, _ in docs), key=repr)
    want = plain_targets(dict(sizes))
    by_target = defaultdict(list)
    for s, t in want.items():
        by_target[(round(t, 6), sizes[s])].append(s)
    taken = Counter()
    for r in got:
        key = (round(r["target"], 6), r["source_size"])
        assert key in by_target
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[key] += r["taken"]
    for key, sources in by_target.items():
        block = max(1, min(mixing.BLOCK_WORDS, key[1] // mixing.LEAST_BLOCKS))
        assert abs(taken[key] - key[0] * len(sources)) <= 1.5 * block * len(sources)


def test_query_keeps_targets_and_agrees_with_itself(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = mixing.op12_source_mix(spark, SF).collect()
    check(docs, got)
    shuffled = spark.createDataFrame(docs[::-1], "doc_id long, text string, source string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        again = mixing.mix_sources(shuffled).taken().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mix_is_disjoint_and_shards_are_even(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mix = mixing.mix_sources(docs, shard_words=4000)
    draws = [tuple(r) for r in mix.draws.select("source_no", "pass", "block", "shard").collect()]
    assert len({d[:3] for d in draws}) == len(draws)
    quota = {r["source_no"]: (r["quota"], r["n_blocks"]) for r in mix.plan.collect()}
    assert Counter(d[0] for d in draws) == {k: q for k, (q, _) in quota.items() if q}
    assert all(Counter(d[0] for d in draws if d[1] == 0)[k] == min(q, n) for k, (q, n) in quota.items() if q)
    per_shard = Counter(d[3] for d in draws)
    assert max(per_shard.values()) - min(per_shard.values()) <= 1 and len(per_shard) > 10
    rows = mix.rows().collect()
    assert all(sorted(r["place"] for r in rows if r["shard"] == s) == list(range(1, 1 + sum(r["shard"] == s for r in rows))) for s in (0, 3))
    seen = Counter()
    for r in rows:
        seen.update((r["doc_id"], w) for w in range(r["first_word"], r["first_word"] + r["n_words"]))
    assert max(seen.values()) <= 2
    taken = Counter(d for (d, _), n in seen.items() for _ in range(n))
    assert taken == Counter({r["doc_id"]: r["taken"] for r in mix.taken().collect() if r["taken"]})
    other = {tuple(r) for r in mixing.mix_sources(docs, shard_words=4000, seed=7).draws.select("source_no", "pass", "block", "shard").collect()}
    assert other != set(draws)


@pytest.mark.parametrize("inline", [100_000, 0])
def test_nulls_repeats_ties_and_clashing_names(spark, monkeypatch, inline):
    monkeypatch.setattr(mixing, "INLINE_SOURCES", inline)
    docs = [(i, "w " * (i % 90), "big") for i in range(600)] + [(None, None, None), (None, "a b", None), (None, "a b", None), (1, "", "empty"), (1, None, "empty"),
            (7, "x" * 9, "Z"), (7, "x" * 9, "Z"), (8, "é \x0b\x1c y", "é"), (9, "w " * 30_000, "𝔘"), (10, " ", None), (10, " ", None)]
    df = spark.createDataFrame([(*d, 1, 2.0) for d in docs], "doc_id long, text string, source string, size int, target double")
    check(docs, mixing.mix_sources(df).taken().collect())


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    mix = mixing.mix_sources(df)
    assert mix.taken().collect() == [] and mix.rows().collect() == []
    blank = mixing.mix_sources(spark.createDataFrame([(1, " ", "a"), (2, None, "b")], df.schema))
    assert [(r["size"], r["target"], r["taken"]) for r in blank.taken().collect()] == [(0, 0.0, 0)] * 2 and blank.rows().collect() == []


def test_permutation_and_tree():
    for n in (1, 2, 3, 7, 64, 65, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5)) == list(range(n))
    assert list(mixing.permuted(np.arange(1000), 1000, 5)) != list(mixing.permuted(np.arange(1000), 1000, 6))
    node = pd.DataFrame({"source_no": [0, 1, 2], "n_blocks": 1, "quota": [500, 30, 0], "first": 0, "lo": 0, "hi": 100})
    step = mixing.splits(node, 1, divmod(530, 100))
    leaves = pd.concat([mixing.splits(g, 1, divmod(530, 100)) for _, g in step.groupby("lo")])
    assert (leaves.hi - leaves.lo == 1).all() and sorted(leaves.groupby("lo").quota.sum()) == [5] * 70 + [6] * 30
    for _, g in leaves[leaves.quota > 0].sort_values("lo").groupby("source_no"):
        assert list(g["first"]) == [0, *g.quota.cumsum()[:-1]]
    # the law: the share of a rare source in a half is hypergeometric, not a fixed half
    halves = [mixing.splits(node.assign(hi=2), s, divmod(530, 2)).query("lo == 0 and source_no == 1").quota.sum() for s in range(400)]
    assert abs(np.mean(halves) - 15) < 0.5 and 5 < np.var(halves) < 9.5  # 15 and 30/4 * 500/529


def test_numbered(spark):
    rows = [(i * 7919 % 1000,) for i in range(1000)]
    got = numbered(spark.createDataFrame(rows, "v long"), [F.col("v")], "place").collect()
    assert all(r["v"] == r["place"] for r in got) and len(got) == 1000
    assert numbered(spark.createDataFrame([], "v long"), [F.col("v")], "place").collect() == []
