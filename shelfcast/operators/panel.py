"""Raw daily sales to a clean series-by-date panel.

After ``dedupe_key`` a series holds at most one row per calendar day, so every window
partitioned by ``series_id`` is bounded by the length of the calendar, however the rows
are spread over stores or products. Duplicates are folded by an aggregate with map-side
combine before any window sees them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DatasetConfig, PreprocessingConfig
from ..functions.columns import nan_to_null, require_columns
from ..functions.ranks import scalar_quantiles, value_classes
from ..session import materialise

OPERATIVE_HOURS = 16.0
STATIC_IDS = ["city_id", "store_id", "management_group_id", "first_category_id",
              "second_category_id", "third_category_id", "product_id"]
WEATHER_FILLED = ["avg_temperature", "avg_humidity", "avg_wind_level"]
KEY = ["store_id", "product_id", "date"]

SERIES_ROWS = 250_000  # rows of a series frame that one task sorts at most, as far as whole series allow


def series_window():
    return Window.partitionBy("series_id").orderBy("date")


def canonicalise(raw: DataFrame) -> DataFrame:
    """Raw column names to panel names; the date to a calendar day; NaN to null."""
    renames = {"dt": "date", "sale_amount": "observed_demand", "stock_hour6_22_cnt": "stockout_hours"}
    df = raw.withColumnsRenamed({k: v for k, v in renames.items() if k in raw.columns})
    return nan_to_null(df.withColumn("date", F.to_date("date")))


def drop_negative_sales(panel: DataFrame) -> DataFrame:
    return panel.where(F.col("observed_demand") >= 0)


def dedupe_key(panel: DataFrame) -> DataFrame:
    """One row per store, product and date: the smallest by the other columns, in schema order."""
    rest = [n for n in panel.columns if n not in KEY]
    return (panel.groupBy(*KEY).agg(F.min(F.struct(*rest)).alias("__r"))
            .select(*[F.col(n) if n in KEY else F.col(f"__r.{n}").alias(n) for n in panel.columns]))


def series_key(panel: DataFrame) -> DataFrame:
    return panel.withColumn("series_id", F.concat_ws("_", F.col("store_id").cast("string"),
                                                     F.col("product_id").cast("string")))


def row_cap(panel: DataFrame, max_rows: int | None) -> DataFrame:
    """First ``max_rows`` rows in (store, product, date) order, without a single-task sort.

    Counts per series give each series its start position, whatever the share of one store;
    only the position inside a series needs a window over its rows.
    """
    if not max_rows:
        return panel
    per_series = materialise(panel.groupBy("store_id", "product_id").agg(F.count(F.lit(1)).alias("__n")), "row-counts")
    stores = value_classes(per_series, [], "store_id", weight="__n").select(
        "store_id", F.col("before").alias("__store_off"))
    starts = value_classes(per_series, ["store_id"], "product_id", weight="__n").select(
        "store_id", "product_id", F.col("before").alias("__in"))
    starts = starts.join(stores, "store_id").select(
        "store_id", "product_id", (F.col("__store_off") + F.col("__in")).alias("__start"))
    kept = panel.join(starts.where(F.col("__start") < max_rows), ["store_id", "product_id"])
    pos = F.row_number().over(Window.partitionBy("store_id", "product_id").orderBy("date"))
    return (kept.withColumn("__pos", F.col("__start") + pos)
            .where(F.col("__pos") <= max_rows).drop("__start", "__pos").select(*panel.columns))


def min_history(panel: DataFrame, days: int) -> DataFrame:
    """Keep series with at least ``days`` dated rows; the same exchange serves later series windows."""
    n = F.count("date").over(Window.partitionBy("series_id"))
    return panel.withColumn("__n", n).where(F.col("__n") >= days).drop("__n")


def top_series(panel: DataFrame, n: int) -> DataFrame:
    """The ``n`` series with most demand; ties by series id."""
    total = panel.groupBy("series_id").agg(F.coalesce(F.sum("observed_demand"), F.lit(0.0)).alias("demand_total"))
    return total.orderBy(F.desc("demand_total"), "series_id").limit(n)


def semi_filter(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def anti_filter(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def keep_top_series(panel: DataFrame, n: int | None) -> DataFrame:
    return semi_filter(panel, top_series(panel, n), ["series_id"]) if n else panel


def fill_defaults(panel: DataFrame) -> DataFrame:
    """Zero flags, rain and stock-out hours; discount 1.0 (none); stock-out clipped to the operative window."""
    out = {n: F.coalesce(F.col(n), F.lit(0.0)) for n in
           ("holiday_flag", "activity_flag", "precpt", "stockout_hours") if n in panel.columns}
    if "stockout_hours" in out:
        out["stockout_hours"] = F.greatest(F.least(out["stockout_hours"], F.lit(OPERATIVE_HOURS)), F.lit(0.0))
    if "discount" in panel.columns:
        out["discount"] = F.coalesce("discount", F.lit(1.0))
    return panel.withColumns(out)


def weather_fill(panel: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Last reading forward, first reading backward, and the table median for a series with none.

    What the forward fill leaves are leading gaps, and the reading that follows a leading gap is
    the first of the series: a whole-series frame finds it once instead of once per row.
    The median is only worked out when some series has no reading at all, which one cheap
    aggregate tells.
    """
    cols = [n for n in (columns or WEATHER_FILLED) if n in panel.columns]
    if not cols:
        return panel
    back = series_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = series_window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = panel.withColumns({
        n: F.coalesce(F.last(n, True).over(back), F.first(n, True).over(whole)) for n in cols})
    seen = panel.groupBy("series_id").agg(*[F.count(n).alias(n) for n in cols])
    gaps = seen.agg(*[F.coalesce(F.max(F.col(n) == 0), F.lit(False)).alias(n) for n in cols]).first()
    for n in cols:
        if gaps[n]:
            median = scalar_quantiles(filled, n, [0.5])[0]
            filled = filled.withColumn(n, F.coalesce(n, F.lit(median).cast("double")))
    return filled


def dealt_by_series(panel: DataFrame) -> DataFrame:
    """Rows of a stored panel dealt by series and sorted by day once, in the order that all series windows go on from.

    A large panel gets a task for every ``SERIES_ROWS`` rows, whatever number of partitions is set or merged to.
    """
    tasks = -(-panel.count() // SERIES_ROWS)
    few = tasks <= panel.sparkSession.sparkContext.defaultParallelism
    return (panel.repartition("series_id") if few else panel.repartition(tasks, "series_id")).sortWithinPartitions("series_id", "date")


def densify(panel: DataFrame, start: str, end: str, zero: tuple[str, ...] = ("observed_demand", "stockout_hours"),
            carry: tuple[str, ...] = ()) -> DataFrame:
    """Put every series that has a row in [start, end] on that calendar; missing days get 0 in ``zero`` columns, null elsewhere.

    Each row also emits the missing days up to the series' next row, so one exchange on
    ``series_id`` does it, and later series windows find their rows in place. Repeated rows of a
    day all stay. ``carry`` names columns that are fixed per series.
    """
    a, b = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    inside = panel.where(F.col("date").between(a, b))
    w = series_window()
    nxt = F.lead("date").over(w)
    first = F.row_number().over(w) == 1
    days = F.sequence(F.when(first, a).otherwise(F.col("date")),
                      F.when(nxt.isNull(), b).otherwise(F.greatest(F.col("date"), F.date_sub(nxt, 1))), F.expr("interval 1 day"))
    full = inside.withColumn("__days", days).withColumn("__day", F.explode("__days"))
    own = F.col("__day") == F.col("date")
    out = {}
    for n in panel.columns:
        if n not in ("series_id", "date", *carry):
            kept = F.when(own, F.col(n))
            out[n] = F.coalesce(kept, F.lit(0.0)) if n in zero else kept
    return full.withColumns({**out, "date": F.col("__day")}).select(*panel.columns)


def prepare_panel(raw: DataFrame, dataset: DatasetConfig = DatasetConfig(),
                  prep: PreprocessingConfig = PreprocessingConfig(),
                  restrict_to: DataFrame | None = None) -> DataFrame:
    """Clean, key, filter and fill. A non-train split passes ``restrict_to`` and inherits train's series."""
    require_columns(raw, ["store_id", "product_id", "dt", "sale_amount"], "raw split")
    panel = canonicalise(raw)
    if restrict_to is None:
        panel = row_cap(panel, dataset.max_rows)
    if prep.drop_negative_sales:
        panel = drop_negative_sales(panel)
    panel = series_key(dedupe_key(panel))
    if restrict_to is not None:
        panel = semi_filter(panel, restrict_to, ["series_id"])
    else:
        panel = min_history(panel, dataset.min_history_days)
        panel = keep_top_series(panel, dataset.top_n_series)
    if prep.fill_missing_values:
        panel = weather_fill(fill_defaults(panel))
    return panel


def date_ordinals(panel: DataFrame, column: str = "date") -> DataFrame:
    """Distinct dates numbered from 0. The calendar is the bound: one row per day."""
    days = panel.select(column).where(F.col(column).isNotNull()).distinct()
    return days.withColumn("ordinal", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(column)) - 1)


def latest_rows(df: DataFrame, n: int = 1) -> DataFrame:
    """The last ``n`` rows per series by date."""
    rn = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("date")))
    return df.withColumn("__rn", rn).where(F.col("__rn") <= n).drop("__rn")


def carve_split(panel: DataFrame, n_series: int, train_days: int) -> tuple[DataFrame, DataFrame]:
    """Top series by volume, cut at the ``train_days``-th distinct date into train and eval."""
    kept = keep_top_series(panel, n_series)
    row = date_ordinals(kept).where(F.col("ordinal") == train_days).first()
    if row is None:
        raise ValueError(f"train_days={train_days} is not below the number of dates in the panel")
    cut = F.lit(row["date"])
    return kept.where(F.col("date") < cut), kept.where(F.col("date") >= cut)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


