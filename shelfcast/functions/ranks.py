"""Exact ranks, quantiles and running totals over groups of any size.

A window or an exact ``percentile`` over one group runs in one task. That is fine for a
series (at most one row per calendar day) but not for a category or the whole table. The
functions here first reduce rows to distinct values with counts, which combines map-side,
and then cut the value range into buckets of near-equal mass. Ranks inside a bucket come
from a window on (group, bucket); ranks of a bucket come from a window over one row per
bucket. The distinct values are stored, so the input is read once; there is a bucket for each ``BUCKET_ROWS /
FEWEST_BUCKETS`` of them, so no group is held by one task, and the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .columns import c, join_same

BUCKET_ROWS = 800_000
FEWEST_BUCKETS = 16  # so many for ``BUCKET_ROWS`` distinct values, and in proportion for more or fewer
FINEST = 256  # cut points that the first pass takes, enough for some millions of values
INLINE_CLASSES = 100_000  # distinct values, of 16 bytes, up to which ranks are looked up rather than joined by a shuffle of tied values


def value_edges(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Near-equal-mass cut points from a sketch, taken in the same pass as the count that says how many: none for a table of few rows."""
    x = F.col(value).cast("double")

    def sketch(n: int):
        return F.percentile_approx(x, F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(max(10_000, 20 * n))).alias("e")

    row = df.agg(F.count(F.lit(1)).alias("n"), sketch(buckets or FINEST)).first()
    wanted = buckets or -(-row["n"] * FEWEST_BUCKETS // BUCKET_ROWS)
    if wanted <= 1:
        return []
    found = row["e"] or []
    if buckets is None and wanted > FINEST:
        found = df.agg(sketch(wanted)).first()["e"] or []
    elif buckets is None:
        found = [found[min(len(found), round(i * FINEST / wanted)) - 1] for i in range(1, wanted)] if found else []
    return sorted({e for e in found if e == e and abs(e) != float("inf")})


def with_bucket(df: DataFrame, value: str, edges: Sequence[float], out: str) -> DataFrame:
    """Number of edges at or below the value, by binary search over any number of edges."""
    if not edges:
        return df.withColumn(out, F.lit(0))
    cut = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="__cut", outputCol=out, handleInvalid="keep")
    found = cut.transform(df.withColumn("__cut", F.col(value).cast("double"))).drop("__cut")
    return found.withColumn(out, F.col(out).cast("int"))


def value_classes(df: DataFrame, keys: Sequence[str], value: str, weight: str | Column | None = None,
                  descending: bool = False) -> DataFrame:
    """One row per distinct (keys, value): its ``mass``, the mass ``before`` it, and the group ``total``."""
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    mass = F.count(F.lit(1)) if weight is None else F.sum(c(weight))
    classes = materialise(rows.groupBy(*keys, value).agg(mass.alias("mass")), "value-classes")  # the input is read once
    order = F.col(value).desc() if descending else F.col(value).asc()
    zero = F.lit(0) if weight is None else F.lit(0.0)
    classes = with_bucket(classes, value, value_edges(classes, value), "__b")
    if descending:
        classes = classes.withColumn("__b", -F.col("__b"))
    inner = Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = classes.withColumn("__in", F.coalesce(F.sum("mass").over(inner), zero))
    per_bucket = classes.groupBy(*keys, "__b").agg(F.sum("mass").alias("__m"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = per_bucket.select(
        *keys, "__b",
        F.coalesce(F.sum("__m").over(part.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), zero)
        .alias("__off"),
        F.sum("__m").over(part).alias("total"),
    )
    joined = join_same(local, offsets, [*keys, "__b"])
    return joined.select(*keys, value, "mass", (F.col("__off") + F.col("__in")).alias("before"), "total")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str = "quantiles") -> DataFrame:
    """Exact linear-interpolated quantiles per group as one array column."""
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    cls = value_classes(rows, keys, value)
    picks = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("total") - 1)
        for tag, r in (("l", F.floor(pos)), ("h", F.ceil(pos))):
            hit = (F.col("before") <= r) & (r < F.col("before") + F.col("mass"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"__{tag}{i}"))
    g = cls.groupBy(*keys).agg(F.max("total").alias("__n"), *picks)
    vals = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("__n") - 1)
        vals.append(F.col(f"__l{i}") + (pos - F.floor(pos)) * (F.col(f"__h{i}") - F.col(f"__l{i}")))
    return g.select(*keys, F.array(*vals).alias(out))


def scalar_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> list[float | None]:
    """Whole-table quantiles as driver scalars."""
    row = quantiles(df, [], value, probs).first()
    got = row["quantiles"] if row is not None else None
    return list(got) if got is not None else [None] * len(probs)


def kth_smallest(df: DataFrame, keys: Sequence[str], value: str, k: Column, out: str) -> DataFrame:
    """The k-th smallest value per group, ``k`` an expression of ``total``; the largest when k exceeds it."""
    cls = value_classes(df, keys, value)
    k = F.least(k, F.col("total"))
    hit = (F.col("before") < k) & (k <= F.col("before") + F.col("mass"))
    return cls.groupBy(*keys).agg(F.max(F.when(hit, F.col(value))).alias(out),
                                  F.max("total").alias("n_scores"))


def percentile_ranks(df: DataFrame, ranks: dict[str, str]) -> DataFrame:
    """(average rank - 1)/(n - 1) over the whole table for each ``out: value``.

    0.5 when a column has at most one distinct value; a null stays null (or 0.5 in that case).
    """
    columns = sorted(set(ranks.values()))
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(v).alias("__of"), F.col(v).cast("double").alias("__v")) for v in columns])).alias("s")).select("s.*")
    mean = (F.col("before") + (F.col("mass") - 1) / 2.0) / (F.col("total") - 1.0)
    classes = materialise(value_classes(stacked, ["__of"], "__v").select("__of", "__v", F.when(F.col("mass") == F.col("total"), F.lit(0.5)).otherwise(mean).alias("__rank")), "rank-classes")
    sizes = {r["__of"]: r["n"] for r in classes.groupBy("__of").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per ranked column
    for name, v in ranks.items():
        cls = classes.where(F.col("__of") == v).select("__v", F.col("__rank").alias(name))
        cls = F.broadcast(cls) if sizes.get(v, 0) <= INLINE_CLASSES else cls
        df = df.join(cls, F.col(v).cast("double") == F.col("__v"), "left").drop("__v")
    return df


def positions(df: DataFrame, value: str, tie: Column, out: str = "position", descending: bool = True) -> DataFrame:
    """Row position from 0 in ``value`` order; equal values are ordered by the numeric ``tie``."""
    tagged = df.withColumn("__tie", tie)
    outer = value_classes(tagged, [], value, descending=descending).select(
        value, F.col("before").alias("__outer"))
    inner = value_classes(tagged, [value], "__tie").select(
        value, "__tie", F.col("before").alias("__inner"))
    placed = join_same(join_same(tagged, inner, [value, "__tie"]), outer, [value])
    return placed.withColumn(out, F.col("__outer") + F.col("__inner")).drop("__tie", "__outer", "__inner")


def running(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str | Column],
            measures: dict[str, tuple[str, str | Column]]) -> DataFrame:
    """Running sum/min/max per key over rows cut into ordered buckets.

    ``measures`` maps an output name to (``sum``|``min``|``max``, input). A window covers one
    (key, bucket); a second window covers one row per bucket. ``bucket`` must follow ``order``.
    """
    fns = {"sum": F.sum, "min": F.min, "max": F.max}
    merge = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + b, "min": F.least, "max": F.greatest}
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumns({f"__loc_{n}": fns[f](c(x)).over(inner) for n, (f, x) in measures.items()})
    per_bucket = df.groupBy(*keys, bucket).agg(*[fns[f](c(x)).alias(f"__tot_{n}") for n, (f, x) in measures.items()])
    offsets = per_bucket.select(
        *keys, bucket, *[fns[f](f"__tot_{n}").over(outer).alias(f"__off_{n}") for n, (f, _) in measures.items()])
    joined = join_same(local, offsets, [*keys, bucket])
    out = {n: merge[f](F.col(f"__off_{n}"), F.col(f"__loc_{n}")) for n, (f, _) in measures.items()}
    return joined.withColumns(out).drop(*[f"__loc_{n}" for n in measures], *[f"__off_{n}" for n in measures])
