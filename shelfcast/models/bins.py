"""Rows reduced to cells of binned inputs, from which a tree on squared error learns what it learns from the rows.

A tree of Spark ML compares its inputs with at most 31 cut points each, so rows between the same cut points are one row to it. The gain of a split
needs counts and sums only: the squares inside a cell fall out of the difference. A cell's number of rows as weight and mean as label
thus give the trees of its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import value_classes, with_bucket

BINS = 32
LISTED = 10_000  # distinct values of an input that are told apart when cut points are set; more are ranked into so many runs
FEW = 32  # cuts that are compared one by one
UNSAMPLED = 1 << 15  # bins of a fit on cells: Spark sets cut points by a sample of the square of it, so by all cells; each input uses what it has


def cut_points(values: DataFrame, keys: Sequence[str], bins: int = BINS) -> DataFrame:
    """``keys, cuts``: the cut points that Spark ML's trees set for an input whose ``value`` comes ``n`` times.

    Midpoints between all values if there are no more than bins; otherwise walk over the values and cut before the one that would take the rows so far
    further from the next multiple of an equal share. Spark does so on a sample of 10,000 rows, this on all of them.
    """
    keys = list(keys)
    classes = value_classes(values.withColumn("n", F.col("n").cast("double")), keys, "value", weight="n")
    sizes = classes.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    run = F.when(F.col("__size") <= LISTED, F.col("value")).otherwise(F.floor(F.col("before") * LISTED / F.col("total")).cast("double"))
    runs = classes.join(sizes, keys).groupBy(*keys, run.alias("__run")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("mass").alias("n"))
    lists = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "n"))).alias("__r"), F.sum("n").alias("__n"))
    most = F.least(F.lit(float(bins)), F.col("__n"))  # as few bins as rows
    lists = lists.select(*keys, "__r", (F.size("__r") <= most).alias("__all"), (F.col("__n") / most).alias("__share"))
    none = F.array().cast("array<double>")
    start = F.struct(F.get("__r", F.lit(0))["n"].alias("seen"), F.col("__share").alias("goal"), F.get("__r", F.lit(0))["hi"].alias("hi"), none.alias("cuts"))

    def step(a: Column, r: Column) -> Column:
        cut = F.col("__all") | (F.abs(a["seen"] - a["goal"]) < F.abs(a["seen"] + r["n"] - a["goal"]))
        return F.struct((a["seen"] + r["n"]).alias("seen"), F.when(cut, a["goal"] + F.col("__share")).otherwise(a["goal"]).alias("goal"), r["hi"].alias("hi"),
                        F.when(cut, F.concat(a["cuts"], F.array((a["hi"] + r["lo"]) / 2.0))).otherwise(a["cuts"]).alias("cuts"))

    rest = F.slice("__r", F.lit(2), F.size("__r"))
    return lists.select(*keys, F.aggregate(rest, start, step, lambda a: a["cuts"]).alias("cuts"))


def below(x: Column, cuts: Sequence[float]) -> Column:
    """How many ``cuts`` are below ``x``: a tree sends to the left at a cut what has at most the number of cuts before it."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < x)) if cuts else F.lit(0)


def with_bin(df: DataFrame, value: str, cuts: Sequence[float], out: str) -> DataFrame:
    """``below`` for many rows of a value that is never null: some comparisons, or a binary search."""
    if len(cuts) <= FEW:
        return df.withColumn(out, sum(((F.col(value) > F.lit(c)).cast("int") for c in cuts), F.lit(0)))
    found = with_bucket(df.withColumn("__neg", -F.col(value)), "__neg", [-c for c in reversed(cuts)], out)
    return found.withColumn(out, F.lit(len(cuts)) - F.col(out)).drop("__neg")


def packing(sizes: dict[str, int], most: int = 1 << 62) -> dict[str, tuple[int, int, int]]:
    """For each name the number of the whole number that holds it, its place value there and its size: in one number as many as go."""
    out, at, place = {}, 0, 1
    for n, size in sizes.items():
        if place * size > most:
            at, place = at + 1, 1
        out[n] = (at, place, size)
        place *= size
    return out


def packed(places: dict[str, tuple[int, int, int]]) -> list[Column]:
    """The columns named as in ``places``, from 0 to below their sizes, as few whole numbers ``code_<i>``."""
    groups = [[(n, p) for n, (i, p, _) in places.items() if i == at] for at in range(1 + max((i for i, *_ in places.values()), default=-1))]
    return [sum((F.col(n).cast("bigint") * F.lit(p) for n, p in g), F.lit(0).cast("bigint")).alias(f"code_{i}") for i, g in enumerate(groups)]


def unpacked(places: dict[str, tuple[int, int, int]]) -> dict[str, Column]:
    return {n: (F.expr(f"code_{i} div {p}") % F.lit(size)).cast("int") for n, (i, p, size) in places.items()}
