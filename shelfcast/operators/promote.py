"""Champion and challenger: the promotion decision and the registry.

Cost summaries have one row per model and strategy, so windows over a whole summary are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BusinessConfig

# The reasons recorded with a decision.
PROMOTED = "Challenger improves total cost and respects the configured service-level tolerance."
KEPT = "No challenger satisfied both the minimum cost improvement and service-level guardrail."
BOOTSTRAPPED = "Registry bootstrapped from configured champion."

REGISTRY = ("data_strategy string, model_name string, backend_name string, promoted_at timestamp, "
            "run_name string, reason string")


def champion_reference(cfg: BusinessConfig, registry: DataFrame | None = None) -> dict:
    """Who the champion is: the newest registry row, else the configuration."""
    row = None if registry is None else registry.orderBy(F.desc("promoted_at")).first()
    if row is not None:
        return {"source": "registry", "data_strategy": row["data_strategy"], "model_name": row["model_name"],
                "backend_name": row["backend_name"]}
    return {"source": "config", "data_strategy": cfg.champion_data_strategy,
            "model_name": cfg.champion_model_name, "backend_name": cfg.champion_backend_name}


def matches(df: DataFrame, ref: dict) -> Column:
    m = (F.col("model_name") == ref["model_name"]) & (F.col("backend_name") == ref["backend_name"])
    if "data_strategy" in df.columns and ref.get("data_strategy") is not None:
        m = m & (F.col("data_strategy") == ref["data_strategy"])
    return m


def promotion_decision(summary: DataFrame, cfg: BusinessConfig = BusinessConfig(),
                       registry: DataFrame | None = None) -> DataFrame:
    """One row: the best challenger and whether it replaces the champion. Empty without both."""
    ref = champion_reference(cfg, registry)
    ids = [n for n in ("data_strategy", "model_name", "backend_name") if n in summary.columns]
    whole = Window.partitionBy(F.lit(0))
    mine = matches(summary, ref)
    row = F.struct(*ids, "total_cost", "service_level")
    s = summary.withColumn("__c", F.min_by(F.when(mine, row), F.when(mine, F.col("total_cost"))).over(whole))
    s = s.where(F.col("__c").isNotNull())
    other = F.lit(False)
    for n in ids:
        other = other | ~F.col(n).eqNullSafe(F.col(f"__c.{n}"))
    gain = (F.col("__c.total_cost") - F.col("total_cost")) / F.nullif(F.col("__c.total_cost"), F.lit(0.0)) * 100.0
    delta = F.col("service_level") - F.col("__c.service_level")
    ok = ((gain >= cfg.champion_min_cost_improvement_pct)
          & (delta >= -cfg.champion_max_service_level_degradation))
    picked = (s.where(other).withColumns({"cost_improvement_pct": gain, "service_level_delta": delta,
                                          "promote": F.coalesce(ok, F.lit(False))})
              .orderBy(F.desc("promote"), "total_cost", F.desc("service_level")).limit(1))
    reason = F.when(F.col("promote"), PROMOTED).otherwise(KEPT)
    return picked.select(
        F.lit(ref["source"]).alias("champion_source"),
        *[F.col(f"__c.{n}").alias(f"champion_{n}") for n in ids], *[F.col(n).alias(f"challenger_{n}") for n in ids],
        F.col("__c.total_cost").alias("champion_total_cost"), F.col("total_cost").alias("challenger_total_cost"),
        "cost_improvement_pct", F.col("__c.service_level").alias("champion_service_level"),
        F.col("service_level").alias("challenger_service_level"), "service_level_delta", "promote",
        reason.alias("decision_reason"))


def registry_update(summary: DataFrame, decision: DataFrame, cfg: BusinessConfig = BusinessConfig(),
                    registry: DataFrame | None = None, run_name: str = "run") -> DataFrame:
    """The row to append: the promoted challenger, or the configured champion when there is no registry yet.

    Empty when an existing champion stays.
    """
    spark = summary.sparkSession
    d = decision.first()
    have = registry is not None and not registry.isEmpty()
    promoted = d is not None and d["promote"]
    if have and not promoted:
        return spark.createDataFrame([], REGISTRY)
    ref = champion_reference(cfg, registry)
    reason = BOOTSTRAPPED
    if promoted:
        ref = {"data_strategy": d["challenger_data_strategy"] if "challenger_data_strategy" in d else None,
               "model_name": d["challenger_model_name"], "backend_name": d["challenger_backend_name"]}
        reason = d["decision_reason"]
    strategy = F.col("data_strategy") if "data_strategy" in summary.columns else F.lit(None).cast("string")
    return summary.where(matches(summary, ref)).orderBy("total_cost").limit(1).select(
        strategy.alias("data_strategy"), "model_name", "backend_name", F.current_timestamp().alias("promoted_at"),
        F.lit(run_name).alias("run_name"), F.lit(reason).alias("reason"))
