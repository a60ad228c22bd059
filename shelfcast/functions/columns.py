"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def require_columns(df: DataFrame, needed: Sequence[str], what: str = "input") -> DataFrame:
    """Schema check on the driver; runs no job."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks required columns: {', '.join(missing)}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere, so turn it into null once at the source."""
    out = {n: F.when(~F.isnan(n), F.col(n)) for n, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(out) if out else df


def both(op, a: str | Column, b: str | Column) -> Column:
    """``greatest``/``least`` that is null when either side is null."""
    a, b = c(a), c(b)
    return F.when(a.isNotNull() & b.isNotNull(), op(a, b))


def floor0(x: str | Column) -> Column:
    x = c(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def rate(cond: Column) -> Column:
    """Mean of a condition in which a null comparison counts as false."""
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


def sum0(x: str | Column) -> Column:
    """Sum that is 0 rather than null when every value is null."""
    return F.coalesce(F.sum(c(x)), F.lit(0.0))


def ratio(a: str | Column, b: str | Column) -> Column:
    a, b = c(a), c(b)
    return F.when(b != 0, a / b)


def quantile_column(level: float) -> str:
    return "q_" + f"{level:g}".replace(".", "_")


def quantile_level(column: str) -> float:
    return float(column[2:].replace("_", "."))


def quantile_columns(df: DataFrame) -> list[str]:
    cols = [n for n in df.columns if n.startswith("q_") and n[2:].replace("_", "").isdigit()]
    return sorted(cols, key=quantile_level)


def interpolate(levels: Sequence[float], values: Sequence[str | Column], target: Column) -> Column:
    """Piecewise-linear quantile function at ``target``, clamped at both ends."""
    values = [c(v) for v in values]
    out = F.when(target <= F.lit(levels[0]), values[0])
    for (l0, l1), (v0, v1) in zip(zip(levels, levels[1:]), zip(values, values[1:])):
        line = (v1 - v0) / F.lit(l1 - l0) * (target - F.lit(l0)) + v0
        out = out.when(target < F.lit(l1), line)
    return out.when(target >= F.lit(levels[-1]), values[-1])


def pinball(y: str | Column, q: str | Column, level: float) -> Column:
    e = c(y) - c(q)
    return both(F.greatest, e * F.lit(level), e * F.lit(level - 1.0))


def winkler(y: str | Column, lo: str | Column, hi: str | Column, alpha: float) -> Column:
    y, lo, hi = c(y), c(lo), c(hi)
    miss = F.when(y < lo, lo - y).when(y > hi, y - hi).otherwise(F.lit(0.0))
    return F.when(y.isNotNull() & lo.isNotNull() & hi.isNotNull(), (hi - lo) + F.lit(2.0 / alpha) * miss)


HASH_SPAN = float(1 << 52)


def hash_hex(*parts: str | Column) -> Column:
    """``hash52`` as the 13 hexadecimal digits that it is read from: they sort the same and are cheaper to compare."""
    text = F.concat_ws("|", *[c(p).cast("string") if isinstance(p, str) else p for p in parts])
    return F.substring(F.md5(text), 1, 13)


def hash52(*parts: str | Column) -> Column:
    """52-bit integer from md5 of the joined parts: the same number in any engine, on any partitioning."""
    return F.conv(hash_hex(*parts), 16, 10).cast("bigint")


def count_edges(x: Column, edges: Column) -> Column:
    """How many of the sorted ``edges`` are at or below ``x``."""
    return F.size(F.filter(edges, lambda e: e <= x))


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which two null keys match; the right key columns are dropped."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = None
    for k in keys:
        e = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = e if cond is None else cond & e
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])
