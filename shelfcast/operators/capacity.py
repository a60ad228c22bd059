"""Sharing one capacity among many series.

With a single capacity the linear programme is a continuous knapsack, whose optimum fills
value segments from the most valuable down. That needs the units worth more than each
value (a running total over distinct values, done in buckets by ``value_classes``) and no
solver. Segments of equal value are interchangeable for the objective; the class that
straddles the limit is cut in proportion, so the result depends on no row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c, floor0, join_same, quantile_level, sum0
from ..functions.ranks import value_classes


def value_segments(cap: Column, q_cols: Sequence[str], under: Column, over: Column) -> Column:
    """Array of (width, value): successive units of one series and what each is worth."""
    cap = F.coalesce(floor0(cap), F.lit(0.0))
    if not q_cols:
        return F.array(F.struct(cap.alias("width"), under.alias("value")))
    parts, left, level0, prev = [], cap, 0.0, F.lit(0.0)
    total = under + over
    for q in sorted(q_cols, key=quantile_level):
        level = quantile_level(q)
        width = F.least(F.greatest(F.col(q) - prev, F.lit(0.0)), left)
        parts.append(F.struct(width.alias("width"), (under - total * F.lit((level0 + level) / 2.0)).alias("value")))
        left, level0, prev = left - width, level, F.col(q)
    parts.append(F.struct(left.alias("width"), (under - total * F.lit(level0)).alias("value")))
    return F.filter(F.array(*parts), lambda s: s["width"] > 0)


def capacity_allocate(df: DataFrame, capacity: float | str | Column, keys: Sequence[str], q_cols: Sequence[str] = (),
                      order: str = "order_quantity", out: str = "allocated", row_id: Sequence[str] = ("series_id",)) -> DataFrame:
    """Allocation per row such that each group of ``keys`` stays within its capacity.

    A group whose requests already fit keeps them unchanged. Without ``q_cols`` every unit of
    a series is worth ``c_under``.
    """
    keys, ids = list(keys), [*keys, *row_id]
    cap = F.lit(float(capacity)) if isinstance(capacity, (int, float)) else c(capacity)
    groups = (df.withColumn("__cap", cap).groupBy(*keys)
              .agg(sum0(floor0(order)).alias("__want"), F.max("__cap").alias("__cap")))
    segs = (df.select(*ids, F.explode(value_segments(F.col(order), q_cols, F.col("c_under"),
                                                     F.col("c_over"))).alias("s"))
            .select(*ids, "s.width", "s.value").where(F.col("value") > 0))
    cls = value_classes(segs, keys, "value", weight="width", descending=True)
    cls = join_same(cls, groups.select(*keys, "__cap"), keys) if keys else cls.withColumn(
        "__cap", groups.select("__cap").scalar())
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("__cap") - F.col("before")) / F.col("mass")))
    cls = cls.select(*keys, "value", share.alias("__share")).where(F.col("__share") > 0)
    filled = (join_same(segs, cls, [*keys, "value"]).groupBy(*ids)
              .agg(F.sum(F.col("width") * F.col("__share")).alias("__got")))
    base = join_same(df, groups, keys) if keys else df.withColumns(
        {"__want": groups.select("__want").scalar(), "__cap": groups.select("__cap").scalar()})
    base = join_same(base, filled, ids, "left")
    return base.withColumn(out, F.when(F.col("__want") <= F.col("__cap"), F.col(order))
                           .otherwise(F.coalesce(F.col("__got"), F.lit(0.0)))).drop("__want", "__cap", "__got")


def capacity_sweep(df: DataFrame, fractions: Sequence[float], q_cols: Sequence[str],
                   period: str = "fold_id") -> DataFrame:
    """Shortage penalty of piecewise, flat and proportional allocation at each fraction of the requested total."""
    base = df.withColumn("order_quantity", F.coalesce(floor0("order_quantity"), F.lit(0.0)))
    want = base.groupBy(period).agg(F.sum("order_quantity").alias("__req"))
    grid = (join_same(base, want, [period])
            .withColumn("capacity_fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
            .withColumn("__c", F.col("__req") * F.col("capacity_fraction")))
    keys = ["capacity_fraction", period]
    a = capacity_allocate(grid, "__c", keys, q_cols, out="piecewise")
    a = capacity_allocate(a, "__c", keys, (), out="flat")
    a = a.withColumn("proportional", F.col("order_quantity") * F.col("capacity_fraction"))

    def penalty(x: str) -> Column:
        return F.sum(F.greatest(F.col("y_true") - F.col(x), F.lit(0.0)) * F.col("c_under"))

    s = a.groupBy("capacity_fraction").agg(
        penalty("piecewise").alias("piecewise_penalty"), penalty("flat").alias("flat_penalty"),
        penalty("proportional").alias("proportional_penalty"),
        F.count_if(F.col("piecewise") < 1e-9).alias("piecewise_series_zeroed"),
        F.count_if(F.col("flat") < 1e-9).alias("flat_series_zeroed"))
    base_pen = F.col("proportional_penalty")

    def gain(x: str) -> Column:
        return F.when(base_pen != 0, (base_pen - F.col(x)) / base_pen * 100.0).otherwise(F.lit(0.0))

    return s.withColumns({"piecewise_vs_proportional_pct": gain("piecewise_penalty"),
                          "flat_vs_proportional_pct": gain("flat_penalty")})
