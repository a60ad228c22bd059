"""Scans of named splits and materialised panels, and the tables a run leaves behind."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DatasetConfig, PreprocessingConfig, Settings, fingerprint
from ..operators.panel import carve_split, prepare_panel
from .tables import RAW_SCHEMA


def scan_raw_split(spark: SparkSession, root: str, split: str = "train",
                   columns: list[str] | None = None) -> DataFrame:
    """Column-pruned scan of a split with the declared schema; no inference."""
    df = spark.read.schema(RAW_SCHEMA).parquet(f"{root}/{split}.parquet")
    return df.select(*columns) if columns else df


def panel_key(dataset: DatasetConfig, prep: PreprocessingConfig, split: str) -> str:
    """Name of a materialised panel: the split plus a digest of everything that shapes it."""
    return f"{split}_{fingerprint(dataset, prep)}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def write_panel(panel: DataFrame, path: str) -> None:
    """Panel rows clustered by series and sorted by date inside each file."""
    (panel.repartition("series_id").sortWithinPartitions("series_id", "date")
     .write.mode("overwrite").parquet(path))


def load_prepared_panel(spark: SparkSession, raw_root: str, panel_root: str,
                        dataset: DatasetConfig = DatasetConfig(), prep: PreprocessingConfig = PreprocessingConfig(),
                        split: str = "train") -> DataFrame:
    """Build the panel once per split and settings, then read it back.

    A split other than train keeps exactly train's series; an empty one is an error.
    """
    path = f"{panel_root}/{panel_key(dataset, prep, split)}"
    if not exists(spark, f"{path}/_SUCCESS") or spark.read.parquet(path).isEmpty():
        keep = None
        if split != "train":
            keep = load_prepared_panel(spark, raw_root, panel_root, dataset, prep, "train").select("series_id")
        write_panel(prepare_panel(scan_raw_split(spark, raw_root, split), dataset, prep, keep), path)
    panel = spark.read.parquet(path)
    if split != "train" and panel.isEmpty():
        raise ValueError(f"the prepared '{split}' panel is empty: no train series occurs in it")
    return panel


def write_carved_split(panel: DataFrame, panel_root: str, dataset: DatasetConfig, prep: PreprocessingConfig,
                       n_series: int, train_days: int) -> tuple[str, str]:
    """Carve train and eval and write both under the names the loader looks for."""
    paths = []
    for split, part in zip(("train", "eval"), carve_split(panel, n_series, train_days)):
        path = f"{panel_root}/{panel_key(dataset, prep, split)}"
        write_panel(part, path)
        paths.append(path)
    return paths[0], paths[1]


def new_run_id(name: str) -> str:
    return f"{name}_{datetime.now(timezone.utc):%Y%m%d_%H%M%S}"


def write_run(root: str, run_id: str, artifacts: dict[str, DataFrame], settings: Settings,
              extra: dict | None = None) -> None:
    """One table per artifact, partitioned by run, so a reader prunes to the run it wants. A run written again replaces itself."""
    spark = None
    for name, df in artifacts.items():
        spark = df.sparkSession
        (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run_id").parquet(f"{root}/{name}"))
    if spark is not None:
        meta = {"run_id": run_id, "run_mode": settings.run_mode, "config_hash": fingerprint(settings, length=64),
                "created_at": datetime.now(timezone.utc).isoformat(), "artifacts": ",".join(sorted(artifacts)),
                **{k: str(v) for k, v in (extra or {}).items()}}
        (spark.createDataFrame([(run_id, json.dumps(meta, sort_keys=True))], "run_id string, body string")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(f"{root}/run_metadata"))


def runs_with(spark: SparkSession, root: str, required: list[str]) -> DataFrame:
    """Run ids that hold every required artifact."""
    out = None
    for name in required:
        if not exists(spark, f"{root}/{name}"):
            return spark.createDataFrame([], "run_id string")
        ids = spark.read.parquet(f"{root}/{name}").select(F.col("run_id").cast("string")).distinct()
        out = ids if out is None else out.join(ids, "run_id", "left_semi")
    return out


def latest_run(spark: SparkSession, root: str, required: list[str]) -> str | None:
    row = runs_with(spark, root, required).agg(
        F.max_by("run_id", F.regexp_extract("run_id", r"(\d{8}_\d{6})$", 1)).alias("r")).first()
    return row["r"]


def read_artifact(spark: SparkSession, root: str, name: str, run_id: str | None = None,
                  columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{root}/{name}")
    if run_id is not None:
        df = df.where(F.col("run_id") == run_id)
    return df.select(*columns) if columns else df


def read_csv_artifact(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a declared schema; an unreadable or missing file gives an empty frame."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, schema=schema, header=True)


def write_tables(root: str, tables: dict[str, DataFrame]) -> None:
    """Write a dictionary of profile tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def write_origin_backtest(root: str, predictions: DataFrame, summary: DataFrame, comparison: DataFrame,
                          events: DataFrame) -> None:
    predictions.write.mode("overwrite").partitionBy("cadence").parquet(f"{root}/predictions_by_day")
    summary.write.mode("overwrite").csv(f"{root}/cadence_summary", header=True)
    comparison.write.mode("overwrite").csv(f"{root}/cadence_comparison", header=True)
    events.write.mode("overwrite").json(f"{root}/retrain_events")


def read_champion_predictions(spark: SparkSession, root: str, strategy: str | None, model: str,
                              backend: str) -> DataFrame | None:
    """Champion rows of the newest run, at validation grain or, failing that, at decision grain."""
    for name in ("validation_predictions", "predictions"):
        run = latest_run(spark, root, [name])
        if run is not None:
            df = read_artifact(spark, root, name, run)
            df = df.where((F.col("model_name") == model) & (F.col("backend_name") == backend))
            return df.where(F.col("data_strategy") == strategy) if strategy is not None else df
    return None
