"""Daily ingest on keyed running state: each new day is scored as the whole panel up to it would be.

Under ``root`` a batch writes, all by its own number, so that it can be run again:

* ``days``: its rows, one per store, product and date; those not after their series' newest day are late and set aside.
* ``sums``: sum and number of known demands and newest day per series, product, category and in total. A batch adds what
  it brings to the buckets of the keys it touches.
* ``history``: the newest rows of each series, as many as features look back on, in touched buckets only.
* ``predictions``, ``recommendations``: the touched series, scored.

Fallback means and the regimes that depend on a series' mean come from ``sums``; training reads ``days``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..functions.columns import ratio
from ..models.conformal import ConformalModel
from ..operators.costs import series_cost_profile
from ..operators.features import inference_with_fallback
from ..operators.panel import dedupe_key, latest_rows, series_key
from ..operators.regimes import label_all_regimes
from ..operators.report import reorder_recommendations
from ..plans.scoring import score_rows
from ..sources.store import exists
from .versions import VersionedTable

SUMS = "scope string, key string, demand_sum double, demand_n bigint, last_date date"
SCOPES = {"series": "series_id", "product": "product_id", "third_category": "third_category_id"}
BUCKETS = 64


def history_needed(settings: Settings) -> int:
    """Rows per series the features look back on."""
    return max(*settings.features.lags, *settings.features.rolling_windows) + 1


def demand_increments(rows: DataFrame) -> DataFrame:
    """What ``rows`` add to the running sums, in one pass with map-side combine."""
    keys = [F.struct(F.lit(scope).alias("scope"), F.col(column).cast("string").alias("key")) for scope, column in SCOPES.items()]
    keys.append(F.struct(F.lit("global").alias("scope"), F.lit("all").alias("key")))
    each = rows.select("observed_demand", "date", F.explode(F.array(*keys)).alias("k")).select("k.*", "observed_demand", "date")
    return each.groupBy("scope", "key").agg(F.coalesce(F.sum("observed_demand"), F.lit(0.0)).alias("demand_sum"),
                                            F.count("observed_demand").alias("demand_n"), F.max("date").alias("last_date"))


def merged_sums(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("scope", "key").agg(
        F.sum("demand_sum").alias("demand_sum"), F.sum("demand_n").alias("demand_n"), F.max("last_date").alias("last_date"))


def running_means(sums: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """The means that ``fallback_lookup`` asks for, from the running sums."""
    mean = ratio("demand_sum", "demand_n")
    out = {scope: sums.where(F.col("scope") == scope).select(F.col("key").cast(rows.schema[column].dataType).alias(column), mean.alias(f"mean_{scope}"))
           for scope, column in SCOPES.items()}
    return out | {"global": sums.where(F.col("scope") == "global").select(mean.alias("mean_global"))}


def sums_table(spark: SparkSession, root: str, buckets: int = BUCKETS) -> VersionedTable:
    return VersionedTable(spark, f"{root}/sums", SUMS, ["scope", "key"], buckets)


def history_table(rows: DataFrame, root: str, buckets: int = BUCKETS) -> VersionedTable:
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return VersionedTable(rows.sparkSession, f"{root}/history", schema, ["series_id"], buckets)


def stored_days(spark: SparkSession, root: str, before: int, late: bool = False) -> DataFrame:
    """All rows taken in before a batch (or, with ``late``, set aside): the panel that training reads."""
    rows = spark.read.parquet(f"{root}/days")
    return rows.where((F.col("batch_id") < before) & (F.col("late") == int(late))).drop("batch_id", "late")


def take_in(batch: DataFrame, root: str, batch_id: int, sums: VersionedTable) -> DataFrame:
    """Store a batch's rows and return those that are not late. A row whose demand is not known is a day like any other; a negative one is dropped."""
    spark = batch.sparkSession
    known = F.coalesce(F.col("observed_demand") >= 0, F.lit(True))
    new = series_key(dedupe_key(batch.where(known)))
    names = new.columns
    newest = sums.read(batch_id).where("scope = 'series'").select(F.col("key").alias("__key"), F.col("last_date").alias("__newest"))
    late = F.coalesce(F.col("date") <= F.col("__newest"), F.col("date").isNull()).cast("int")
    marked = new.join(newest, F.col("series_id") == F.col("__key"), "left").select(*names, late.alias("late"))
    marked.write.mode("overwrite").partitionBy("late").parquet(f"{root}/days/batch_id={batch_id}")
    schema = ", ".join(f"`{n}` {t}" for n, t in new.dtypes)
    return spark.read.schema(f"{schema}, late int").parquet(f"{root}/days/batch_id={batch_id}").where("late = 0").drop("late")


def score_batch(batch: DataFrame, root: str, model: ConformalModel, settings: Settings, batch_id: int, buckets: int = BUCKETS) -> None:
    """Take a batch in, bring the state up to date and score the series it touches. ``buckets`` of a state stay what they were at first."""
    spark = batch.sparkSession
    sums = sums_table(spark, root, buckets)
    rows = take_in(batch, root, batch_id, sums)
    if rows.isEmpty():
        return
    added = demand_increments(rows)
    touched = sums.touched(added)
    sums.write(batch_id, merged_sums(sums.read(batch_id, touched), added), touched)
    now = sums.read(batch_id + 1)
    history = history_table(rows, root, buckets)
    touched = history.touched(rows)
    history.write(batch_id, latest_rows(history.read(batch_id, touched).unionByName(rows), history_needed(settings)), touched)

    recent = history.read(batch_id + 1, touched).join(rows.select("series_id").distinct(), "series_id", "left_semi")
    means = running_means(now, rows)
    of_series = means["series"].withColumnRenamed("mean_series", "__mean")
    labelled = label_all_regimes(recent.join(of_series, "series_id", "left"), mean=F.col("__mean")).drop("__mean")
    latest, _ = inference_with_fallback(labelled, settings.features, settings.dataset.horizon, means)
    profile = series_cost_profile(stored_days(spark, root, batch_id + 1), settings.inventory) if settings.inventory.use_series_costs else None
    score_rows(latest, model, settings, profile).write.mode("overwrite").parquet(f"{root}/predictions/batch_id={batch_id}")
    scored = spark.read.parquet(f"{root}/predictions/batch_id={batch_id}")
    reorder_recommendations(scored, settings.business).write.mode("overwrite").parquet(f"{root}/recommendations/batch_id={batch_id}")
    sums.vacuum(batch_id)
    history.vacuum(batch_id)


def current_model(spark: SparkSession, root: str, model: ConformalModel) -> ConformalModel:
    """The newest model that a retrain stored, else the given one: a restarted stream goes on with what it had."""
    if not exists(spark, f"{root}/retrain_events"):
        return model
    newest = spark.read.parquet(f"{root}/retrain_events").agg(F.max("day_index")).first()[0]
    path = f"{root}/models/{newest}"
    return ConformalModel.load(spark, path) if newest is not None and exists(spark, path) else model


def stream_scoring(days: DataFrame, root: str, model: ConformalModel, settings: Settings, checkpoint: str,
                   retrain: Callable[[DataFrame], ConformalModel] | None = None, every: int | None = None,
                   buckets: int = BUCKETS) -> StreamingQuery:
    """Score every batch; with ``every``, train a new model on all stored days before each so-many-th batch is scored.

    Retrains are logged under ``retrain_events`` with the rows they had, and models that can be saved are kept under ``models``.
    """
    held = {"model": current_model(days.sparkSession, root, model)}

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        if retrain is not None and every and (batch_id + 1) % every == 0 and exists(spark, f"{root}/days"):
            past = stored_days(spark, root, batch_id)
            n = past.count()
            if n:
                held["model"] = retrain(past)
                if hasattr(held["model"], "save"):
                    held["model"].save(f"{root}/models/{batch_id}")
                event = spark.createDataFrame([(batch_id, f"every_{every}", n)], "day_index bigint, cadence string, history_rows bigint")
                event.write.mode("overwrite").parquet(f"{root}/retrain_events/batch={batch_id}")
        score_batch(batch, root, held["model"], settings, batch_id, buckets)

    return days.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
