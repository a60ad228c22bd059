"""Population stability and Page-Hinkley drift detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DriftConfig
from ..functions.columns import c, count_edges, join_same
from ..functions.ranks import positions, quantiles
from ..session import materialise

PSI_WARNING, PSI_CRITICAL = 0.10, 0.20
SHARE_FLOOR = 1e-4
MIN_PSI_ROWS = 60


def psi_status(x: str | Column) -> Column:
    x = c(x)
    return F.when(x >= PSI_CRITICAL, "critical").when(x >= PSI_WARNING, "warning").otherwise("ok")


def _inner_edges(q: Column) -> Column:
    """Unique quantiles without the first and last, which count as open ends."""
    u = F.array_distinct(q)
    return F.when(F.size(u) > 2, F.slice(u, F.lit(2), F.size(u) - 2)).otherwise(F.array().cast("array<double>"))


def _psi_from_counts(counts: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """PSI and both histograms from (keys, bin, ref, cur, n_bins) rows: at most ``bins`` rows per key."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    shares = counts.withColumns({"__rt": F.sum("ref").over(part), "__ct": F.sum("cur").over(part)})
    ok = (F.col("__rt") > 0) & (F.col("__ct") > 0)
    r = F.when(ok, F.col("ref") / F.col("__rt"))
    k = F.when(ok, F.col("cur") / F.col("__ct"))
    rs, ks = F.greatest(r, F.lit(SHARE_FLOOR)), F.greatest(k, F.lit(SHARE_FLOOR))
    shares = shares.select(*keys, "bin", "n_bins", ok.alias("ok"), F.coalesce(r, F.lit(0.0)).alias("__rp"),
                           F.coalesce(k, F.lit(0.0)).alias("__kp"),
                           F.when(ok, (ks - rs) * F.log(ks / rs)).otherwise(F.lit(0.0)).alias("term"))
    g = shares.groupBy(*keys).agg(
        F.sum("term").alias("psi"), F.max("n_bins").alias("__nb"), F.max("ok").alias("__ok"),
        F.map_from_entries(F.collect_list(F.struct("bin", "__rp"))).alias("__r"),
        F.map_from_entries(F.collect_list(F.struct("bin", "__kp"))).alias("__k"))
    idx = F.when(F.col("__ok"), F.sequence(F.lit(0), F.col("__nb") - 1)).otherwise(F.sequence(F.lit(0), F.lit(bins - 1)))

    def hist(m: str) -> Column:
        return F.transform(idx, lambda i: F.round(F.coalesce(F.try_element_at(F.col(m), i), F.lit(0.0)), 4))

    return g.select(*keys, "psi", hist("__r").alias("pre"), hist("__k").alias("post"))


def finite(x: str) -> Column:
    return F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(F.col(x)) != float("inf"))


def psi(df: DataFrame, keys: Sequence[str], value: str, is_current: str, bins: int = 10, bounded: bool = False) -> DataFrame:
    """Population stability index per key between rows with ``is_current`` false and true.

    ``bounded`` says every key holds few rows (a series); its deciles then need no size check.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"), F.col(is_current).alias("__c")).where(
        F.col("__v").isNotNull()).where(finite("__v") & F.col("__c").isNotNull())
    probs = [i / bins for i in range(bins + 1)]
    ref = rows.where(~F.col("__c"))
    if bounded:
        edges = ref.groupBy(*keys).agg(F.percentile("__v", F.array(*[F.lit(p) for p in probs])).alias("q"))
    else:
        edges = quantiles(ref, keys, "__v", probs, out="q")
    edges = edges.select(*keys, _inner_edges(F.col("q")).alias("__e"))
    if keys:
        tagged = join_same(rows, edges, keys, "left")
    else:
        tagged = rows.withColumn("__e", edges.select("__e").scalar())
    tagged = tagged.withColumns({"bin": F.coalesce(count_edges(F.col("__v"), F.col("__e")), F.lit(0)),
                                 "n_bins": F.coalesce(F.size("__e") + 1, F.lit(1))})
    counts = tagged.groupBy(*keys, "bin").agg(
        F.max("n_bins").alias("n_bins"), F.count_if(~F.col("__c")).alias("ref"), F.count_if(F.col("__c")).alias("cur"))
    return _psi_from_counts(counts, keys, bins)


def category_psi(df: DataFrame, keys: Sequence[str], value: str, is_current: str) -> DataFrame:
    """PSI with one bin per distinct value, for features with two values whose decile bins collapse."""
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull() & F.col(is_current).isNotNull())
    counts = rows.groupBy(*keys, value).agg(F.count_if(~F.col(is_current)).alias("ref"),
                                            F.count_if(F.col(is_current)).alias("cur"))
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    shares = counts.withColumns({"__rt": F.sum("ref").over(part), "__ct": F.sum("cur").over(part)}).where(
        (F.col("__rt") > 0) & (F.col("__ct") > 0))
    r = F.greatest(F.col("ref") / F.col("__rt"), F.lit(SHARE_FLOOR))
    k = F.greatest(F.col("cur") / F.col("__ct"), F.lit(SHARE_FLOOR))
    return shares.groupBy(*keys).agg(F.sum((k - r) * F.log(k / r)).alias("psi"))


def median_date(df: DataFrame, date: str = "date"):
    """Median day over rows, as (days since 1970, possibly a half); from counts per day."""
    per_day = df.where(F.col(date).isNotNull()).groupBy(date).agg(F.count(F.lit(1)).alias("n"))
    return per_day.agg(F.percentile(F.unix_date(date), 0.5, F.col("n"))).first()[0]


def halves_by_date(df: DataFrame, date: str = "date", out: str = "is_current") -> DataFrame:
    """False before the median date, true from it on; by row order when one half would be empty."""
    mid = median_date(df, date)
    if mid is not None:
        split = df.withColumn(out, F.unix_date(date) >= F.lit(mid))
        seen = split.agg(F.count_if(F.col(out)).alias("b"), F.count_if(~F.col(out)).alias("a")).first()
        if seen["a"] > 0 and seen["b"] > 0:
            return split
    n = df.count()
    h = F.xxhash64(*df.columns)
    placed = positions(df.withColumn("__z", F.lit(0.0)), "__z", h, out="__p", descending=False)
    return placed.withColumn(out, F.col("__p") >= n // 2).drop("__p", "__z")


def feature_drift_report(df: DataFrame, importance: DataFrame, top_n: int = 7, bins: int = 10,
                         date: str = "date") -> DataFrame:
    """PSI of the most important features between the older and newer half, worst first.

    ``importance`` has (feature, importance); it has one row per feature, so the pick is made
    on the driver. The features are stacked and measured in one grouped job. A feature of at most two
    values, whose deciles collapse into one bin, is measured with one bin per value.
    """
    ranked = [r for r in importance.orderBy(F.desc("importance"), "feature").collect() if r["feature"] in df.columns]
    total = sum(r["importance"] for r in importance.collect()) or 1.0
    top = ranked[:top_n]
    split = halves_by_date(df, date)
    long = split.select("is_current", F.explode(F.array(*[
        F.struct(F.lit(r["feature"]).alias("name"), F.col(r["feature"]).cast("double").alias("value"))
        for r in top])).alias("x")).select("is_current", "x.name", "x.value")
    scored = psi(long, ["name"], "value", "is_current", bins)
    few = (long.where(F.col("value").isNotNull()).groupBy("name").agg(F.approx_count_distinct("value", 0.01).alias("n"))
           .where("n <= 2").collect())  # one row per picked feature at most
    two_valued = [r["name"] for r in few]
    by_value = category_psi(long.where(F.col("name").isin(two_valued)), ["name"], "value", "is_current")
    scored = scored.join(by_value.withColumnRenamed("psi", "__by_value"), "name", "left")
    kind = F.when(F.col("name").isin(two_valued), "binary").otherwise("numeric")
    score = F.coalesce("__by_value", "psi")
    shares = F.create_map(*[x for r in top for x in (F.lit(r["feature"]), F.lit(r["importance"] / total))])
    out = scored.select(
        "name", kind.alias("type"), F.round(F.element_at(shares, F.col("name")), 4).alias("importance"),
        F.round(score, 4).alias("psi"), psi_status(score).alias("status"), "pre", "post")
    return out.orderBy(F.desc("psi"), "name")


def series_psi(df: DataFrame, key: str = "series_id", value: str = "y_true", order: str = "date",
               bins: int = 10) -> DataFrame:
    """PSI of each series' first half against its second; null below 60 rows."""
    w = Window.partitionBy(key)
    half = F.floor(F.count(F.lit(1)).over(w) / 2)
    rn = F.row_number().over(w.orderBy(order)) - 1
    split = df.select(key, value, (rn >= half).alias("is_current"), F.count(F.lit(1)).over(w).alias("n"))
    big = split.where(F.col("n") >= MIN_PSI_ROWS)
    scored = psi(big, [key], value, "is_current", bins, bounded=True).select(key, F.round("psi", 3).alias("psi"))
    return df.select(key).distinct().join(scored, key, "left")


def page_hinkley(df: DataFrame, keys: Sequence[str], order: Sequence[str], error: str,
                 cfg: DriftConfig = DriftConfig(), bucket: str | None = None) -> DataFrame:
    """One-sided Page-Hinkley score after every observation, as running sums and a running minimum.

    With ``bucket`` (an ordered coarse time such as the day) a key of any length is scanned in
    pieces; without it each key is one window, for short sequences such as fold errors.
    """
    keys = list(keys)
    if bucket is not None:
        return page_hinkley_scan(df, keys, order, error, bucket, cfg)[0]
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = df.withColumns({"ph_n": F.count(F.lit(1)).over(w), "ph_mean": F.avg(error).over(w)})
    out = out.withColumn("__dev", F.col(error) - F.col("ph_mean") - F.lit(cfg.delta))
    out = out.withColumn("ph_sum", F.sum("__dev").over(w))
    return _flagged(out.withColumn("ph_min", F.least(F.lit(0.0), F.min("ph_sum").over(w))).drop("__dev"), cfg)


def _flagged(df: DataFrame, cfg: DriftConfig) -> DataFrame:
    score = F.col("ph_sum") - F.col("ph_min")
    return df.withColumns({"ph_score": score, "is_drift": (F.col("ph_n") > cfg.min_instances) & (score > cfg.threshold)})


PH_STATE = "n bigint, total double, deviation double, lowest double"


def page_hinkley_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], error: str, bucket: str, cfg: DriftConfig = DriftConfig(),
                      state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The scored rows, and per key the four numbers (``PH_STATE``) from which the next rows go on; ``state`` is where these begin.

    The input is read once, into a stored table. A row per (key, bucket) has its count and sum; what lies before a bucket is a
    running total over those few rows. With it a window over one bucket gives the deviations, their running sum and its minimum
    from the bucket's start on, and a second small table says what to add. Rows are shuffled once, by (key, bucket).
    """
    keys = list(keys)
    own = [*keys, bucket]
    rows = materialise(df, "ph-rows")
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    start = {"n": F.lit(0), "total": F.lit(0.0), "deviation": F.lit(0.0), "lowest": F.lit(0.0)}

    def begun(table: DataFrame) -> DataFrame:
        """``table`` with the state its key starts from."""
        names = [f"__{n}" for n in start]
        if state is None:
            return table.withColumns(dict(zip(names, start.values())))
        if not keys:
            return table.join(state.select(*[F.col(n).alias(f"__{n}") for n in start]))
        joined = join_same(table, state.select(*keys, *[F.col(n).alias(f"__{n}") for n in start]), keys, "left")
        return joined.withColumns({f"__{n}": F.coalesce(f"__{n}", v) for n, v in start.items()})

    sizes = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("__c"), F.sum(error).alias("__s"))
    ahead = begun(sizes).select(*own, (F.col("__n") + F.coalesce(F.sum("__c").over(before), F.lit(0))).alias("__n0"),
                                (F.col("__total") + F.coalesce(F.sum("__s").over(before), F.lit(0.0))).alias("__t0"))
    w = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = join_same(rows, ahead, own)
    placed = placed.withColumns({"ph_n": F.col("__n0") + F.count(F.lit(1)).over(w), "__t": F.col("__t0") + F.sum(error).over(w)})
    placed = placed.withColumn("ph_mean", F.col("__t") / F.col("ph_n"))
    placed = placed.withColumn("__dev", F.col(error) - F.col("ph_mean") - F.lit(cfg.delta)).withColumn("__sum", F.sum("__dev").over(w))
    local = materialise(placed.withColumn("__min", F.min("__sum").over(w)).drop("__n0", "__t0"), "ph-local")

    parts = begun(local.groupBy(*own).agg(F.sum("__dev").alias("__d"), F.min("__min").alias("__m"), F.count(F.lit(1)).alias("__c"), F.sum(error).alias("__s")))
    parts = parts.withColumn("__s0", F.col("__deviation") + F.coalesce(F.sum("__d").over(before), F.lit(0.0)))
    low = F.least(F.col("__lowest"), F.min(F.col("__s0") + F.col("__m")).over(before))
    parts = materialise(parts.withColumn("__m0", low), "ph-parts")
    out = join_same(local, parts.select(*own, "__s0", "__m0"), own)
    out = out.withColumns({"ph_sum": F.col("__s0") + F.col("__sum"), "ph_min": F.least(F.col("__m0"), F.col("__s0") + F.col("__min"))})
    after = parts.groupBy(*keys).agg((F.max("__n") + F.sum("__c")).alias("n"), (F.max("__total") + F.sum("__s")).alias("total"),
                                     (F.max("__deviation") + F.sum("__d")).alias("deviation"), F.least(F.min("__lowest"), F.min(F.col("__s0") + F.col("__m"))).alias("lowest"))
    scored = _flagged(out.select(*df.columns, "ph_n", "ph_mean", "ph_sum", "ph_min"), cfg)
    return scored, after


def fold_drift_watch(fold_metrics: DataFrame, cfg: DriftConfig = DriftConfig(), holdout: int = 999) -> DataFrame:
    """Page-Hinkley over each model's fold errors; ``fold_metrics`` comes from ``summarize_predictions``."""
    keys = [k for k in ("data_strategy", "model_name", "backend_name") if k in fold_metrics.columns]
    rows = fold_metrics.where(F.col("fold_id").isNotNull() & (F.col("fold_id") != holdout))
    scored = page_hinkley(rows.select(*keys, "fold_id", "mae"), keys, ["fold_id"], "mae", cfg)
    return scored.withColumn("threshold", F.lit(cfg.threshold))
