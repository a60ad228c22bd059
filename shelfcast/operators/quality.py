"""Panel checks: one aggregate for the whole report."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DatasetConfig, QualityConfig

KEYS = ["date", "series_id", "observed_demand"]
REQUIRED = ["date", "series_id", "observed_demand", "stockout_hours"]


class DataQualityError(ValueError):
    pass


def _duplicates(panel: DataFrame) -> DataFrame:
    """Rows beyond the first per series and date, from counts per key; null keys match each other."""
    return panel.groupBy("series_id", "date").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("d"))


def data_quality_report(panel: DataFrame, cfg: QualityConfig = QualityConfig(), run_mode: str = "experiment",
                        today: date | None = None) -> DataFrame:
    """Issues found, as (severity, code, column_name, amount) rows; no rows when the panel is sound."""
    spark = panel.sparkSession
    missing = sorted(set(REQUIRED) - set(panel.columns))
    if missing:
        return spark.createDataFrame([("blocking", "missing_required_columns", n, 1.0) for n in missing],
                                     "severity string, code string, column_name string, amount double")
    parsed = F.expr("try_cast(date AS date)")
    rest = [n for n in panel.columns if n not in KEYS]
    nulls = {n: F.count_if(F.col(n).isNull()) for n in panel.columns}
    agg = panel.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(parsed.isNull()).alias("bad_dates"),
        F.count_if((F.col("stockout_hours") < 0) | (F.col("stockout_hours") > 16)).alias("bad_hours"),
        F.max(parsed).alias("latest"), *[x.alias(f"null_{n}") for n, x in nulls.items()],
    ).withColumn("dup", _duplicates(panel).scalar())

    def issue(when, severity: str, code: str, column: str | None, amount):
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"),
                                     F.lit(column).cast("string").alias("column_name"),
                                     amount.cast("double").alias("amount")))

    checks = [issue(F.col("dup") > 0, "blocking", "duplicate_series_date_rows", None, F.col("dup"))]
    checks += [issue(F.col(f"null_{n}") > 0, "blocking", "null_key_columns", n, F.col(f"null_{n}")) for n in KEYS]
    checks.append(issue(F.col("bad_dates") > 0, "blocking", "invalid_date_format", None, F.col("bad_dates")))
    checks.append(issue(F.col("bad_hours") > 0, "blocking", "invalid_stockout_hours", None, F.col("bad_hours")))
    for n in rest:
        share = F.when(F.col("rows") > 0, F.col(f"null_{n}") / F.col("rows")).otherwise(F.lit(0.0))
        checks.append(issue(share > cfg.max_missing_fraction_warning, "warning", "high_missingness", n, share))
    if cfg.max_data_age_days is not None and run_mode != "experiment":
        age = F.datediff(F.lit(today) if today else F.current_date(), F.col("latest"))
        checks.append(issue((F.col("bad_dates") == 0) & (age > cfg.max_data_age_days), "blocking", "stale_data",
                            None, age))
    return agg.select(F.explode(F.array_compact(F.array(*checks))).alias("i")).select("i.*")


def report_header(panel: DataFrame, issues: DataFrame) -> DataFrame:
    """Checked rows and (distinct) series, date span, and whether nothing blocks."""
    day = F.expr("try_cast(date AS date)")
    return panel.agg(F.count(F.lit(1)).alias("checked_rows"), F.count_distinct("series_id").alias("checked_series"),
                     F.min(day).alias("date_min"), F.max(day).alias("date_max")).withColumns({
        "warning_count": issues.agg(F.count_if(F.col("severity") == "warning")).scalar(),
        "blocking_error_count": issues.agg(F.count_if(F.col("severity") == "blocking")).scalar(),
    }).withColumn("passed", F.col("blocking_error_count") == 0)


def raise_on_blocking(issues: DataFrame) -> None:
    """At most one row per check and column, so the blocking ones can be listed."""
    bad = issues.where(F.col("severity") == "blocking").collect()
    if bad:
        raise DataQualityError("; ".join(f"{r['code']}({r['column_name'] or '-'})={r['amount']:g}" for r in bad))


def config_alignment(panel: DataFrame, cfg: DatasetConfig = DatasetConfig()) -> DataFrame:
    """Configured against actual series count and shortest history."""
    per = panel.groupBy("series_id").agg(F.count_distinct("date").alias("n"))
    s = per.agg(F.count(F.lit(1)).alias("actual_unique_series"),
                F.coalesce(F.min("n"), F.lit(0)).alias("actual_min_history_days"))
    top_ok = F.lit(True) if not cfg.top_n_series else F.col("actual_unique_series") <= cfg.top_n_series
    return s.select(
        F.lit(cfg.top_n_series).cast("int").alias("configured_top_n_series"), "actual_unique_series",
        top_ok.alias("top_n_series_matches_config"),
        F.lit(cfg.min_history_days).alias("configured_min_history_days"), "actual_min_history_days",
        (F.col("actual_min_history_days") >= cfg.min_history_days).alias("min_history_matches_config"))


def raise_on_misalignment(alignment: DataFrame) -> None:
    r = alignment.first()
    bad = []
    if not r["top_n_series_matches_config"]:
        bad.append(f"{r['actual_unique_series']} series, configured {r['configured_top_n_series']}")
    if not r["min_history_matches_config"]:
        bad.append(f"shortest history {r['actual_min_history_days']}, configured {r['configured_min_history_days']}")
    if bad:
        raise RuntimeError("panel does not match the configuration: " + "; ".join(bad))


