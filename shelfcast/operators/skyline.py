"""Pareto fronts of tables of any size and any number of losses.

Only distinct loss vectors matter. Three steps leave fewer and fewer of them:

1. every task keeps the front of what it reads, handing on what it has when that grows beyond ``BLOCK``;
2. the front of a bounded sample of the survivors (``SAMPLE`` per key) goes to every task and drops what it dominates;
3. the candidates that are left are dealt into blocks of about ``BLOCK`` by a hash, and each pair of blocks is
   compared in a task of its own, so a front larger than a task is still exact.

No row meets another in a join; memory is bounded by the block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

BLOCK, SAMPLE, STEP = 20_000, 500, 256


def dominated(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` some row of ``by`` beats: nowhere greater, somewhere less."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), STEP):
        part = x[at:at + STEP]
        for k in range(0, len(by), 4096):
            other = by[k:k + 4096]
            no_worse, better = np.ones((len(part), len(other)), bool), np.zeros((len(part), len(other)), bool)
            for d in range(x.shape[1]):
                no_worse &= other[None, :, d] <= part[:, None, d]
                better |= other[None, :, d] < part[:, None, d]
            out[at:at + STEP] |= (no_worse & better).any(axis=1)
    return out


def front(x: np.ndarray) -> np.ndarray:
    """Which rows no other row beats. In order of their sums a row can only be beaten by one before it; sums that rounding makes
    equal are compared as well, because a block is compared with itself and the order breaks ties by each loss in turn."""
    order = np.lexsort((*x.T[::-1], x.sum(axis=1)))
    keep = np.zeros(len(x), bool)
    best = np.zeros((0, x.shape[1]))
    for at in range(0, len(x), STEP):
        rows = order[at:at + STEP]
        rows = rows[~dominated(x[rows], best)]
        rows = rows[~dominated(x[rows], x[rows])]
        keep[rows] = True
        best = np.concatenate([best, x[rows]])
    found = np.flatnonzero(keep)
    keep[found] = ~dominated(x[found], best)
    return keep


def pareto_front(df: DataFrame, losses: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """All rows with ``is_on_front``: whether no other row of the same keys is nowhere worse and somewhere better.

    Equal rows are on the front together. A row with a null or NaN loss is not on it and beats none. Null keys are a key.
    """
    losses, keys = list(losses), list(keys)
    rows = materialise(df, "skyline-rows")
    names = [f"l{i}" for i in range(len(losses))]
    known = [F.col(f"`{c}`").cast("double").alias(n) for n, c in zip(names, losses)]
    group = F.to_json(F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("all")), {"ignoreNullFields": "false"})
    usable = " and ".join(f"{n} is not null and not isnan({n})" for n in names)
    plus_zero = [(F.col(n) + F.lit(0.0)).alias(n) for n in names]  # -0.0 is 0.0
    tagged = rows.withColumns(dict(zip([f"__{n}" for n in names], known))).withColumn("__k", group)
    vectors = rows.select(group.alias("k"), *known).where(usable).select("k", *plus_zero)
    schema = "k string, " + ", ".join(f"{n} double" for n in names)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for k, part in batch.groupby("k", sort=False):
                x = np.unique(part[names].to_numpy(float), axis=0)
                x = np.concatenate([held[k], x]) if k in held else x
                held[k] = np.unique(x[front(x)], axis=0)
            if sum(map(len, held.values())) > BLOCK:
                yield pd.concat([pd.DataFrame(x, columns=names).assign(k=k) for k, x in held.items()])[["k", *names]]
                held = {}
        if held:
            yield pd.concat([pd.DataFrame(x, columns=names).assign(k=k) for k, x in held.items()])[["k", *names]]

    first = materialise(vectors.mapInPandas(local, schema).distinct(), "skyline-local")
    sizes = first.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    if not sizes.where(F.col("n") > BLOCK).isEmpty():
        first = materialise(_pruned(first, sizes, names, schema), "skyline-pruned")
        sizes = first.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    blocks = first.join(sizes, "k").withColumn("m", F.ceil(F.col("n") / BLOCK).cast("int"))
    blocks = blocks.withColumn("own", F.pmod(F.xxhash64(*names), F.col("m")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = blocks.select("k", *names, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def beaten(pair: pd.DataFrame) -> pd.DataFrame:
        return pair[~front(pair[names].to_numpy(float))][["k", *names]]

    lost = dealt.groupBy("k", "lo", "hi").applyInPandas(beaten, schema).distinct()
    best = first.join(lost, ["k", *names], "left_anti").select(F.col("k").alias("__k"), *[F.col(n).alias(f"__{n}") for n in names], F.lit(True).alias("__on"))
    out = tagged.join(best, ["__k", *[f"__{n}" for n in names]], "left").withColumn("is_on_front", F.col("__on").isNotNull())
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c != "is_on_front"], "is_on_front")


def _pruned(first: DataFrame, sizes: DataFrame, names: list[str], schema: str) -> DataFrame:
    """``first`` without what the front of a sample dominates: the ``SAMPLE`` least sums of each key that is large, of which there are few."""
    large = sizes.where(F.col("n") > BLOCK).select("k")
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    best = first.join(large, "k").groupBy("k").agg(F.min_by(F.struct(*names), F.struct(total, *names)).alias("least"),
                                                   F.slice(F.sort_array(F.collect_set(F.when(F.pmod(F.xxhash64(*names), F.lit(997)) == 0, F.struct(*names)))), 1, SAMPLE).alias("drawn"))
    probes = best.select("k", F.explode(F.array_append("drawn", F.col("least"))).alias("v")).select("k", "v.*").limit(64 * SAMPLE).toPandas()
    by = {k: part[names].to_numpy(float) for k, part in probes.groupby("k")}

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for k, at in batch.groupby("k", sort=False).indices.items():
                if k in by:
                    keep[at] = ~dominated(batch.iloc[at][names].to_numpy(float), by[k])
            yield batch[keep]

    return first.mapInPandas(prune, schema)
