"""Profile tables of a prepared panel.

Statistics over a whole panel, a weekday or a category can gather any number of rows in one
group, so their medians and quartiles go through ``ranks.quantiles``. Statistics of one
series are bounded by the calendar and use Spark's exact ``percentile`` directly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DatasetConfig
from ..functions.columns import c, hash52, join_same, rate
from ..functions.ranks import positions, quantiles, scalar_quantiles
from ..session import materialise
from .folds import distinct_dates
from .quality import config_alignment

NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint")
MEANINGFUL = ["observed_demand", "stockout_hours", "discount", "holiday_flag", "activity_flag", "precpt",
              "avg_temperature", "avg_humidity", "avg_wind_level"]
COVARIATES = ["discount", "avg_temperature", "precpt", "avg_humidity", "avg_wind_level"]
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
BANDS = ["0", "0-2", "3-6", "7+"]


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in NUMERIC]


def stacked(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form: one row per input row and column, as doubles."""
    each = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).cast("double").alias("value")) for n in cols])
    return df.select(*keep, F.explode(each).alias("x")).select(*keep, "x.column_name", "x.value")


def dataset_summary(panel: DataFrame) -> DataFrame:
    """One row. Per-series partial sums first, then totals, so no distinct count spans the table."""
    d, s = F.col("observed_demand"), F.col("stockout_hours")
    per = panel.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("a"), F.max("date").alias("b"),
        F.sum(d).alias("s1"), F.count(d).alias("k"),
        F.count_if(d == 0).alias("z"), F.count_if(s > 0).alias("o"), F.sum(s).alias("h"), F.count(s).alias("hk"),
        F.count_distinct("date").alias("days"))
    median = quantiles(per, [], "days", [0.5]).select(F.col("quantiles")[0]).scalar()
    spread = panel.agg(F.stddev_pop(d)).scalar()
    return per.agg(
        F.sum("n").alias("rows"), F.count("series_id").alias("unique_series"), F.min("a").alias("date_min"),
        F.max("b").alias("date_max"), F.sum("s1").alias("observed_demand_sum"),
        (F.sum("s1") / F.sum("k")).alias("observed_demand_mean"),
        spread.alias("observed_demand_std"),
        (F.sum("z") / F.sum("n")).alias("zero_demand_rate"), (F.sum("o") / F.sum("n")).alias("stockout_day_rate"),
        (F.sum("h") / F.sum("hk")).alias("mean_stockout_hours"), F.min("days").alias("min_history_days"),
        F.max("days").alias("max_history_days")).withColumn("median_history_days", median)


def missingness_summary(panel: DataFrame, approximate: bool = False) -> DataFrame:
    """Nulls and distinct values per column, most missing first.

    Exact distinct counts reduce (column, value) pairs map-side before they are counted;
    ``approximate`` uses a sketch instead.
    """
    each = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("dtype"),
                              F.col(n).cast("string").alias("v")) for n, t in panel.dtypes])
    long = panel.select(F.explode(each).alias("x")).select("x.*")
    if approximate:
        g = long.groupBy("column_name", "dtype").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("null_count"),
            F.approx_count_distinct("v").alias("n_unique"))
    else:
        pairs = long.groupBy("column_name", "dtype", "v").agg(F.count(F.lit(1)).alias("m"))
        g = pairs.groupBy("column_name", "dtype").agg(
            F.sum("m").alias("n"), F.sum(F.when(F.col("v").isNull(), F.col("m")).otherwise(F.lit(0))).alias("null_count"),
            F.count("v").alias("n_unique"))
    return g.select("column_name", "dtype", "null_count", (F.col("null_count") / F.col("n")).alias("null_rate"),
                    "n_unique").orderBy(F.desc("null_rate"), "column_name")


def series_summary(panel: DataFrame) -> DataFrame:
    d, s = F.col("observed_demand"), F.col("stockout_hours")
    return panel.groupBy("series_id").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"),
        F.count_distinct("date").alias("history_days"),
        F.coalesce(F.sum(d), F.lit(0.0)).alias("observed_demand_sum"), F.avg(d).alias("observed_demand_mean"),
        F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("observed_demand_std"), rate(d == 0).alias("zero_demand_rate"),
        rate(s > 0).alias("stockout_day_rate"), F.avg(s).alias("mean_stockout_hours"),
    ).orderBy(F.desc("observed_demand_sum"), "series_id")


def numeric_summary(panel: DataFrame) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles per numeric column.

    Moments and extremes of all columns share one aggregation; quartiles come from the long form.
    """
    cols = numeric_columns(panel)
    aggs = []
    for n in cols:
        x = F.col(n).cast("double")
        aggs.append(F.struct(F.lit(n).alias("column_name"), F.count(x).alias("count"), F.avg(x).alias("mean"),
                             F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")).alias(n))
    base = panel.agg(*aggs).select(F.explode(F.array(*[F.col(n) for n in cols])).alias("r")).select("r.*")
    long = quantiles(stacked(panel, cols), ["column_name"], "value", [0.25, 0.5, 0.75], out="q")
    q = F.col("q")
    return base.join(long, "column_name", "left").select("column_name", "count", "mean", "std", "min", q[0].alias("p25"), q[1].alias("median"),
                                                         q[2].alias("p75"), "max")


def temporal_summary(panel: DataFrame) -> DataFrame:
    per = panel.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("k"),
                                         F.min("date").alias("a"), F.max("date").alias("b"))
    t = per.agg(F.min("a").alias("date_min"), F.max("b").alias("date_max"), F.sum("n").alias("observed_rows"),
                F.count("series_id").alias("series"), F.sum(F.col("n") - F.col("k")).alias("duplicate_series_date_rows"))
    span = F.datediff("date_max", "date_min") + 1
    grid = span * F.col("series")
    return t.select("date_min", "date_max", span.alias("date_span_days"), "observed_rows",
                    grid.alias("expected_rows_full_grid"),
                    F.when(grid > 0, F.col("observed_rows") / grid).otherwise(F.lit(0.0)).alias("coverage_rate_full_grid"),
                    "duplicate_series_date_rows")


def weekday_summary(panel: DataFrame) -> DataFrame:
    df = panel.withColumn("weekday", F.weekday("date"))
    g = df.groupBy("weekday").agg(
        F.count(F.lit(1)).alias("observations"), F.avg("observed_demand").alias("observed_demand_mean"),
        rate(F.col("stockout_hours") > 0).alias("stockout_day_rate"),
        F.avg("stockout_hours").alias("mean_stockout_hours"))
    q = quantiles(df, ["weekday"], "observed_demand", [0.5])
    names = F.array(*[F.lit(d) for d in DAYS])
    return g.join(q, "weekday", "left").select(
        "weekday", names[F.col("weekday")].alias("weekday_name"), "observations", "observed_demand_mean",
        F.col("quantiles")[0].alias("observed_demand_median"), "stockout_day_rate",
        "mean_stockout_hours").orderBy("weekday")


def series_gap_summary(panel: DataFrame) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("date")
    gap = F.datediff("date", F.lag("date").over(w))
    return panel.select("series_id", "date", gap.alias("g")).groupBy("series_id").agg(
        F.count_distinct("date").alias("history_days"), F.min("date").alias("start_date"),
        F.max("date").alias("end_date"), F.coalesce(F.max("g"), F.lit(1)).alias("max_gap_days"),
        F.coalesce(F.sum(F.greatest(F.col("g") - 1, F.lit(0))), F.lit(0)).alias("missing_days_within_span"),
    ).orderBy(F.desc("missing_days_within_span"), "series_id")


def stockout_summary(panel: DataFrame) -> DataFrame:
    out = F.coalesce(F.col("stockout_hours") > 0, F.lit(False))
    zero = F.coalesce(F.col("observed_demand") == 0, F.lit(False)).cast("double")
    return panel.agg(
        F.count_if(out).alias("stockout_rows"), F.avg(out.cast("double")).alias("stockout_row_rate"),
        F.avg("stockout_hours").alias("mean_stockout_hours_all_rows"),
        F.coalesce(F.avg(F.when(out, F.col("stockout_hours"))), F.lit(0.0)).alias("mean_stockout_hours_stockout_rows"),
        F.coalesce(F.avg(F.when(out, zero)), F.lit(0.0)).alias("zero_demand_rate_stockout_rows"),
        F.coalesce(F.avg(F.when(~out, zero)), F.lit(0.0)).alias("zero_demand_rate_non_stockout_rows"))


def stockout_by_series(panel: DataFrame) -> DataFrame:
    s = F.col("stockout_hours")
    return panel.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("observations"), F.count_if(s > 0).alias("stockout_days"),
        rate(s > 0).alias("stockout_day_rate"), F.avg(s).alias("mean_stockout_hours"),
        F.max(s).alias("max_stockout_hours"), F.avg("observed_demand").alias("observed_demand_mean"),
    ).orderBy(F.desc("stockout_day_rate"), "series_id")


def stockout_band() -> Column:
    s = F.col("stockout_hours")
    return (F.when((s > -0.01) & (s <= 0), BANDS[0]).when((s > 0) & (s <= 2), BANDS[1])
            .when((s > 2) & (s <= 6), BANDS[2]).when(s > 6, BANDS[3]))


def stockout_bands(panel: DataFrame) -> DataFrame:
    """Demand by stock-out band; a band without rows is kept with a count of 0."""
    df = panel.withColumn("stockout_band", stockout_band()).where(F.col("stockout_band").isNotNull())
    g = df.groupBy("stockout_band").agg(
        F.count(F.lit(1)).alias("observations"), F.avg("observed_demand").alias("observed_demand_mean"),
        F.avg("stockout_hours").alias("stockout_hours_mean"))
    q = quantiles(df, ["stockout_band"], "observed_demand", [0.5])
    every = panel.sparkSession.createDataFrame([(b,) for b in BANDS], "stockout_band string")
    return every.join(g, "stockout_band", "left").join(q, "stockout_band", "left").select(
        "stockout_band", F.coalesce("observations", F.lit(0)).alias("observations"), "observed_demand_mean",
        F.col("quantiles")[0].alias("observed_demand_median"), "stockout_hours_mean")


def correlation_summary(panel: DataFrame) -> DataFrame:
    """Pearson correlation of each numeric column with demand, over rows where both are known; one aggregate."""
    cols = [n for n in numeric_columns(panel) if n != "observed_demand"]
    row = panel.agg(*[F.corr(F.col(n).cast("double"), F.col("observed_demand")).alias(n) for n in cols])
    each = F.array(*[F.struct(F.lit(n).alias("feature_name"), F.col(n).alias("r")) for n in cols])
    return row.select(F.explode(each).alias("x")).select(
        "x.feature_name", F.when(~F.isnan("x.r"), F.col("x.r")).alias("correlation_with_observed_demand"),
        F.when(~F.isnan("x.r"), F.abs("x.r")).alias("absolute_correlation"),
    ).orderBy(F.desc_nulls_last("absolute_correlation"), "feature_name")


def correlation_matrix(panel: DataFrame, columns: Sequence[str] = tuple(MEANINGFUL)) -> DataFrame:
    """Long correlation matrix of the columns that vary."""
    cols = [n for n in columns if n in panel.columns]
    varies = panel.agg(*[(F.min(n) < F.max(n)).alias(n) for n in cols]).first()
    cols = [n for n in cols if varies[n]]
    pairs = [(a, b) for a in cols for b in cols]
    row = panel.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}")
                      for i, (a, b) in enumerate(pairs) if a < b])
    pos = {p: i for i, p in enumerate(pairs)}
    each = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                              (F.lit(1.0) if a == b else F.col(f"c{pos[min((a, b), (b, a))]}")).alias("correlation"))
                     for a, b in pairs])
    return row.select(F.explode(each).alias("x")).select("x.*")


def acf(panel: DataFrame, max_lag: int = 28) -> DataFrame:
    """Autocorrelation of the daily mean by lag, with the 95 % noise band. Works on one row per day."""
    daily = panel.groupBy("date").agg(F.avg("observed_demand").alias("m"))
    whole = Window.partitionBy(F.lit(0))
    x = daily.select((F.row_number().over(whole.orderBy("date")) - 1).alias("i"),
                     (F.col("m") - F.avg("m").over(whole)).alias("x"), F.count(F.lit(1)).over(whole).alias("n"))
    a = x.select((F.col("i")).alias("ai"), F.col("x").alias("ax"), "n",
                 F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"))
    b = x.select(F.col("i").alias("bi"), F.col("x").alias("bx"))
    g = a.join(b, F.col("ai") + F.col("lag") == F.col("bi")).groupBy("lag").agg(
        F.sum(F.col("ax") * F.col("bx")).alias("num"), F.max("n").alias("n"))
    var = x.agg(F.sum(F.col("x") * F.col("x"))).scalar()
    return g.withColumn("var", var).where((F.col("n") >= max_lag + 2) & (F.col("var") > 0)).select(
        "lag", (F.col("num") / F.col("var")).alias("acf"), (1.96 / F.sqrt("n")).alias("band")).orderBy("lag")


def category_weekday_profile(panel: DataFrame, min_obs: int = 500) -> DataFrame:
    """Weekday means per category as z-scores, a demand tier, and distance from the average profile."""
    key = "third_category_id"
    day = F.weekday("date")
    per = panel.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("observed_demand").alias("n"), F.avg("observed_demand").alias("mean_demand"),
        *[F.avg(F.when(day == i, F.col("observed_demand"))).alias(d) for i, d in enumerate(DAYS)])
    per = materialise(per.where(F.col("n") >= min_obs), "category-weekdays")
    arr = F.array(*[F.col(d) for d in DAYS])
    per = per.withColumn("__k", F.filter(arr, lambda v: v.isNotNull()))
    per = per.withColumn("__m", F.aggregate("__k", F.lit(0.0), lambda a, v: a + v) / F.size("__k"))
    per = per.withColumn("__sd", F.when(F.size("__k") > 1, F.sqrt(F.aggregate(
        "__k", F.lit(0.0), lambda a, v: a + (v - F.col("__m")) * (v - F.col("__m"))) / (F.size("__k") - 1))))
    z = per.select(key, "mean_demand", *[F.when(F.col("__sd") > 0, (F.col(d) - F.col("__m")) / F.col("__sd")).alias(d)
                                         for d in DAYS])
    t1, t2 = scalar_quantiles(per.select("mean_demand"), "mean_demand", [1.0 / 3.0, 2.0 / 3.0])
    avg = z.agg(*[F.avg(d).alias(d) for d in DAYS])
    dev = F.lit(0.0)
    for d in DAYS:
        gap = F.col(d) - avg.select(d).scalar()
        dev = dev + F.coalesce(gap * gap, F.lit(0.0))
    tier = (F.when(F.col("mean_demand") >= F.lit(t2), "High").when(F.col("mean_demand") >= F.lit(t1), "Medium")
            .otherwise("Low"))
    return z.withColumns({"tier": tier, "deviation": dev}).drop("mean_demand")


def top_per_tier(profile: DataFrame, n: int = 7) -> DataFrame:
    """The ``n`` most unusual categories of each tier."""
    rn = F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("deviation"), "third_category_id"))
    return profile.withColumn("rank_in_tier", rn).where(F.col("rank_in_tier") <= n)


def covariate_bins(panel: DataFrame, columns: Sequence[str] = tuple(COVARIATES), n_bins: int = 20) -> DataFrame:
    """Mean demand with a 95 % band over equal-width bins of each covariate.

    Values up to the 1 % quantile go first, then those from the 99 % quantile of the rest. What a covariate is cut by is a row
    per covariate, so it goes to the rows: dealt by covariate, each would be held by one task.
    """
    cols = [n for n in columns if n in panel.columns]
    long = stacked(panel, cols, ["observed_demand"]).where(F.col("value").isNotNull()
                                                           & F.col("observed_demand").isNotNull())
    q1 = quantiles(long, ["column_name"], "value", [0.01], out="__a")
    mid = long.join(F.broadcast(q1), "column_name").where(F.col("value") > F.col("__a")[0]).drop("__a")
    q2 = quantiles(mid, ["column_name"], "value", [0.99], out="__b")
    body = mid.join(F.broadcast(q2), "column_name").where(F.col("value") < F.col("__b")[0]).drop("__b")
    span = body.groupBy("column_name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    binned = body.join(F.broadcast(span), "column_name").where(F.col("lo") < F.col("hi"))
    width = (F.col("hi") - F.col("lo")) / n_bins
    k = F.ceil((F.col("value") - F.col("lo")) / width).cast("int")
    binned = binned.withColumn("bin", F.least(F.greatest(k, F.lit(1)), F.lit(n_bins)))
    g = binned.groupBy("column_name", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("observed_demand").alias("mean"),
        (F.stddev_samp("observed_demand") / F.sqrt(F.count(F.lit(1)))).alias("sem"),
        F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    w = (F.col("hi") - F.col("lo")) / n_bins
    return g.select("column_name", "bin", "n", (F.col("lo") + w * (F.col("bin") - 0.5)).alias("x_mid"), "mean",
                    (F.col("mean") - 1.96 * F.col("sem")).alias("low"),
                    (F.col("mean") + 1.96 * F.col("sem")).alias("high"))


def histogram(df: DataFrame, value: str, bins: int = 25, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bin counts with centres and log10 counts; the last bin includes its right edge."""
    keys = list(keys)
    rows = df.select(*keys, c(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    span = rows.groupBy(*keys).agg(F.min("__v").alias("__a"), F.max("__v").alias("__b"))
    flat = F.col("__a") == F.col("__b")
    span = span.select(*keys, F.when(flat, F.col("__a") - 0.5).otherwise(F.col("__a")).alias("__lo"),
                       F.when(flat, F.col("__b") + 0.5).otherwise(F.col("__b")).alias("__hi")).where(
        F.col("__lo").isNotNull())
    if keys:
        tagged = join_same(rows, span, keys)
    else:
        tagged = rows.withColumns({"__lo": span.select("__lo").scalar(), "__hi": span.select("__hi").scalar()})
    width = (F.col("__hi") - F.col("__lo")) / bins
    b = F.least(F.floor((F.col("__v") - F.col("__lo")) / width).cast("int"), F.lit(bins - 1))
    counts = tagged.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = span.select(*keys, "__lo", "__hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = join_same(every, counts, [*keys, "bin"], "left").withColumn("count", F.coalesce("n", F.lit(0)))
    return full.select(*keys, "bin", (F.col("__lo") + width * (F.col("bin") + 0.5)).alias("center"), "count",
                       F.when(F.col("count") > 0, F.log10(F.col("count"))).otherwise(F.lit(0.0)).alias("log_count"))


def hour_histogram(panel: DataFrame, positive_only: bool = False) -> DataFrame:
    """Rows per whole stock-out hour, in unit bins centred on the hour (left edge closed).

    The top bin includes its right edge.
    """
    s = F.col("stockout_hours")
    rows = panel.where(s > 0) if positive_only else panel.where(s.isNotNull())
    top = panel.agg(F.floor(F.max("stockout_hours"))).scalar()
    b = F.least(F.floor(s + 0.5), top)
    out = rows.groupBy(b.alias("hour")).agg(F.count(F.lit(1)).alias("count"))
    return out.where(F.col("hour") >= 1) if positive_only else out


def demand_by_stockout_hour(panel: DataFrame) -> DataFrame:
    return panel.groupBy("stockout_hours").agg(F.avg("observed_demand").alias("observed_demand_mean"))


def zero_rate_stats(series: DataFrame) -> DataFrame:
    """Median zero-demand rate over series and the share of series above one half."""
    rows = series.where(F.col("zero_demand_rate").isNotNull())
    med = quantiles(rows, [], "zero_demand_rate", [0.5]).select(F.col("quantiles")[0]).scalar()
    return rows.agg((F.avg((F.col("zero_demand_rate") > 0.5).cast("double")) * 100.0).alias("pct_above_50"),
                    F.count(F.lit(1)).alias("series")).withColumn("median", F.coalesce(med, F.lit(0.0)))


def top_rows(df: DataFrame, n: int, order: str = "observed_demand_sum", tie: str = "series_id") -> DataFrame:
    return df.orderBy(F.desc(order), tie).limit(n)


def sigma_boxes(series: DataFrame, n: int = 20) -> DataFrame:
    """Mean with one- and two-sigma limits, floored at 0, for the series with most demand."""
    m, s = F.col("observed_demand_mean"), F.col("observed_demand_std")
    zero = F.lit(0.0)
    return top_rows(series, n).select(
        "series_id", F.greatest(zero, m - 2 * s).alias("min"), F.greatest(zero, m - s).alias("q1"),
        m.alias("median"), (m + s).alias("q3"), (m + 2 * s).alias("max"))


def quartile_boxes(panel: DataFrame, per_band: int = 5) -> DataFrame:
    """True quartiles of demand for series at the top, middle and bottom of the volume order."""
    totals = materialise(panel.groupBy("series_id").agg(
        F.coalesce(F.sum("observed_demand"), F.lit(0.0)).alias("demand_total")), "series-totals")
    placed = positions(totals, "demand_total", hash52("series_id"))
    n = totals.agg(F.count(F.lit(1))).scalar()
    p = F.col("position")
    half = F.floor(n / 2)
    band = (F.when(p < per_band, "top").when((p >= half) & (p < half + per_band), "middle")
            .when(p >= n - per_band, "bottom"))
    picked = placed.withColumn("band", band).where(F.col("band").isNotNull()).select("series_id", "band")
    return panel.join(picked, "series_id").groupBy("band", "series_id").agg(
        F.percentile("observed_demand", F.array(F.lit(0.0), F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(1.0))).alias("q")
    ).select("band", "series_id", *[F.col("q")[i].alias(k) for i, k in enumerate(("min", "q1", "median", "q3", "max"))])


def coverage_grid(panel: DataFrame, n: int = 20) -> DataFrame:
    """1 or 0 for each of the top series on each date any of them has."""
    top = top_rows(panel.groupBy("series_id").agg(
        F.coalesce(F.sum("observed_demand"), F.lit(0.0)).alias("observed_demand_sum")), n).select("series_id")
    own = panel.join(top, "series_id", "left_semi").select("series_id", "date").distinct()
    days = F.array(*[F.lit(d) for d in distinct_dates(own)])
    grid = top.withColumn("date", F.explode(days))
    return grid.join(own.withColumn("__p", F.lit(1)), ["series_id", "date"], "left").select(
        "series_id", "date", F.coalesce("__p", F.lit(0)).alias("present"))


def sample_rows(panel: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A seeded sample of rows: those with the smallest hash."""
    return panel.orderBy(hash52("series_id", "date", F.lit(seed)), "series_id", "date").limit(n)


def diverse_series(panel: DataFrame, n: int = 12, seed: int = 42) -> list[str]:
    """Series from different stores across demand and stock-out tiers.

    A cell needs no more candidates than there are cells, so the candidates are a short list
    and the one-store-once rule is settled on the driver.
    """
    stats = panel.groupBy("series_id").agg(
        F.count("date").alias("days"), F.avg("observed_demand").alias("mean_demand"),
        rate(F.col("stockout_hours") > 0).alias("out_rate"), F.min_by("store_id", "date").alias("store"))
    floor = scalar_quantiles(stats, "days", [0.5])[0]
    stats = stats.where(F.col("days") >= F.lit(floor))
    t1, t2 = scalar_quantiles(stats, "mean_demand", [1 / 3, 2 / 3])
    m, o = F.col("mean_demand"), F.col("out_rate")
    stats = stats.withColumns({
        "demand_tier": F.when(m <= t1, "low").when(m <= t2, "mid").otherwise("high"),
        "out_tier": F.when(o <= 0.05, "low").when(o <= 0.3, "mid").otherwise("high"),
        "h": hash52("series_id", F.lit(seed))})
    per_store = stats.groupBy("demand_tier", "out_tier", "store").agg(
        F.min("h").alias("h"), F.min_by("series_id", "h").alias("series_id"))
    rn = F.row_number().over(Window.partitionBy("demand_tier", "out_tier").orderBy("h"))
    short = [r.asDict() for r in per_store.withColumn("rn", rn).where(F.col("rn") <= 10).collect()]
    chosen, stores = [], set()
    for d in ("high", "mid", "low"):
        for s in ("high", "mid", "low"):
            free = [r for r in short if r["demand_tier"] == d and r["store"] not in stores]
            pool = [r for r in free if r["out_tier"] == s] or free
            if pool and len(chosen) < n:
                best = min(pool, key=lambda r: r["h"])
                chosen.append(best["series_id"])
                stores.add(best["store"])
    return chosen


def series_overlay(panel: DataFrame, series: Sequence[str]) -> DataFrame:
    """Demand and stock-out hours of chosen series, hours scaled to the demand maximum."""
    w = Window.partitionBy("series_id")
    top, hours = F.max("observed_demand").over(w), F.max("stockout_hours").over(w)
    scaled = F.when(hours > 0, F.col("stockout_hours") / hours * top).otherwise(F.col("stockout_hours"))
    return panel.where(F.col("series_id").isin(list(series))).select(
        "series_id", "date", "observed_demand", "stockout_hours", scaled.alias("stockout_scaled"))


def profile_panel(panel: DataFrame, cfg: DatasetConfig = DatasetConfig(top_n_series=None)) -> dict[str, DataFrame]:
    """All profile tables of one panel, lazily."""
    series = series_summary(panel)
    return {
        "dataset_summary": dataset_summary(panel), "config_alignment_summary": config_alignment(panel, cfg),
        "missingness_summary": missingness_summary(panel), "numeric_summary": numeric_summary(panel),
        "series_summary": series, "temporal_summary": temporal_summary(panel),
        "weekday_summary": weekday_summary(panel), "series_gap_summary": series_gap_summary(panel),
        "stockout_summary": stockout_summary(panel), "stockout_by_series_summary": stockout_by_series(panel),
        "stockout_demand_bands": stockout_bands(panel), "correlation_summary": correlation_summary(panel)}


