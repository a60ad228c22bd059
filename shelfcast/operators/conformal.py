"""Split-conformal calibration with one radius per group and a global fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import both, c, floor0, join_same, quantile_column, quantile_columns, quantile_level
from ..functions.ranks import kth_smallest


def conformity_score(df: DataFrame, alpha: float, y: str = "y_true", p: str = "y_pred") -> Column:
    """How far the truth lies outside the interval; the absolute error when the interval columns are missing."""
    lo, hi = quantile_column(round(alpha / 2, 10)), quantile_column(round(1 - alpha / 2, 10))
    if lo in df.columns and hi in df.columns:
        return both(F.greatest, c(lo) - c(y), c(y) - c(hi))
    return F.abs(c(y) - c(p))


def conformal_radius(df: DataFrame, keys: Sequence[str], score: str, alpha: float, out: str = "q_hat") -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest score per group, at most the largest, at least 0."""
    k = F.ceil((F.col("total") + 1) * F.lit(1.0 - alpha))
    found = kth_smallest(df, keys, score, k, out)
    return found.withColumn(out, F.greatest(F.coalesce(F.col(out), F.lit(0.0)), F.lit(0.0)))


def calibrate(df: DataFrame, alpha: float, keys: Sequence[str] = (), group: str | None = "third_category_id") -> DataFrame:
    """Radius table: per ``keys`` one row with ``scope`` global and one per group."""
    scored = df.withColumn("__score", conformity_score(df, alpha))
    whole = conformal_radius(scored, keys, "__score", alpha)
    whole = whole.withColumn("scope", F.lit("global"))
    if group is None or group not in df.columns:
        return whole
    own = conformal_radius(scored.where(F.col(group).isNotNull()), [*keys, group], "__score", alpha).withColumn("scope", F.lit("group"))
    return whole.unionByName(own, allowMissingColumns=True)


def attach_radius(df: DataFrame, table: DataFrame, keys: Sequence[str] = (),
                  group: str | None = "third_category_id") -> DataFrame:
    """Radius of the row's group, else the global one, as ``q_hat``."""
    whole = table.where(F.col("scope") == "global").select(*keys, F.col("q_hat").alias("__all"))
    if keys:
        out = join_same(df, whole, keys, "left")
    else:
        out = df.withColumn("__all", whole.select("__all").scalar())
    if group is not None and group in table.columns:
        own = table.where(F.col("scope") == "group").select(*keys, group, F.col("q_hat").alias("__own"))
        out = join_same(out, own, [*keys, group], "left")
        return out.withColumn("q_hat", F.coalesce("__own", "__all")).drop("__own", "__all")
    return out.withColumnRenamed("__all", "q_hat")


def apply_radius(df: DataFrame, alpha: float = 0.2) -> DataFrame:
    """Low quantiles down and high ones up by ``q_hat``, floored at 0; the median stays.

    A frame without quantiles gets a symmetric interval around ``y_pred``; one without
    ``q_hat`` passes through.
    """
    if "q_hat" not in df.columns:
        return df
    cols = quantile_columns(df)
    if not cols:
        lo, hi = quantile_column(round(alpha / 2, 10)), quantile_column(round(1 - alpha / 2, 10))
        return df.withColumns({lo: floor0(F.col("y_pred") - F.col("q_hat")), quantile_column(0.5): F.col("y_pred"),
                               hi: floor0(F.col("y_pred") + F.col("q_hat"))})
    out = {}
    for q in cols:
        level = quantile_level(q)
        if level != 0.5:
            out[q] = floor0(F.col(q) - F.col("q_hat") if level < 0.5 else F.col(q) + F.col("q_hat"))
    return df.withColumns(out)


def monotone_quantiles(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Each row's quantiles sorted, so that a higher level is never below a lower one."""
    cols = sorted(cols or quantile_columns(df), key=quantile_level)
    packed = F.array_sort(F.array(*[F.col(q) for q in cols]))
    return (df.withColumn("__q", packed).withColumns({q: F.col("__q")[i] for i, q in enumerate(cols)}).drop("__q"))
