"""Multi-period order-up-to ledger: what a policy's orders cost once stock carries over.

Folds are few, so the history of one model and series is a short array. Without a shared
capacity each array is folded where it lies, in the JVM. With one, series depend on each
other inside a fold, so the folds are stepped through in order with every step a
distributed job and the state written between steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import InventoryConfig
from ..functions.columns import quantile_columns
from ..session import cut_lineage
from .capacity import capacity_allocate
from .costs import attach_series_costs
from .orders import inventory_costs, order_up_to

MODEL_KEYS = ["data_strategy", "model_name", "backend_name"]
NAIVE = "seasonal_naive"
SIM = ["sim_on_hand", "sim_backlog", "sim_arrivals", "sim_total_cost"]


def model_keys(df: DataFrame) -> list[str]:
    return [k for k in MODEL_KEYS if k in df.columns]


def decision_rows(df: DataFrame) -> DataFrame:
    """The newest origin per model, series and fold: the policy orders once per fold.

    Rows are placed by model and series first, which also serves the later fold over folds.
    """
    keys = [*model_keys(df), "series_id"]
    rn = F.row_number().over(Window.partitionBy(*keys, "fold_id").orderBy(F.desc("date")))
    placed = df.where(F.col("series_id").isNotNull()).repartition(*keys)
    return placed.withColumn("__rn", rn).where(F.col("__rn") == 1).drop("__rn")


def with_level(df: DataFrame, cfg: InventoryConfig, profile: DataFrame | None) -> DataFrame:
    """Adds the order-up-to level; the naive model has no quantiles and uses its point forecast."""
    out = attach_series_costs(df, cfg, profile)
    s = order_up_to(quantile_columns(df))
    return out.withColumn("__s", F.when(F.col("model_name") == NAIVE, F.col("y_pred")).otherwise(s)
                          if "model_name" in df.columns else s)


def placed_order(level: Column, on_hand: Column, backlog: Column, stuck: Column, clip: bool) -> Column:
    q = level - (on_hand - backlog + stuck)
    return F.when(q.isNotNull(), F.greatest(q, F.lit(0.0))) if clip else q


def settle(on_hand: Column, backlog: Column, arrivals: Column, demand: Column) -> tuple[Column, Column]:
    """Stock and backlog at the end of a period: arrivals, then old backlog, then demand."""
    have = on_hand + arrivals
    owed = backlog + demand
    return F.greatest(have - owed, F.lit(0.0)), F.greatest(owed - have, F.lit(0.0))


def simulate_ledger(df: DataFrame, cfg: InventoryConfig = InventoryConfig(), profile: DataFrame | None = None,
                    initial_on_hand: float = 0.0) -> DataFrame:
    """One row per model, series and fold with the order placed and the stock it leads to.

    An order placed in fold f arrives in fold f + 1; one that no fold receives stays on order.
    """
    if cfg.global_capacity_units is not None:
        return _simulate_capped(df, cfg, profile, initial_on_hand)
    rows = with_level(decision_rows(df), cfg, profile)
    keys = [*model_keys(df), "series_id"]
    kept = [n for n in rows.columns if n not in keys and n not in ("order_quantity", *SIM)]
    packed = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("fold_id").alias("__k"), *kept))).alias("h"))
    step_type = ("array<struct<order_quantity:double,sim_on_hand:double,sim_backlog:double,"
                 "sim_arrivals:double,sim_total_cost:double>>")
    start = F.struct(F.lit(float(initial_on_hand)).alias("on_hand"), F.lit(0.0).alias("backlog"),
                     F.lit(0.0).alias("stuck"), F.lit(None).cast("int").alias("last"), F.lit(0.0).alias("qty"),
                     F.array().cast(step_type).alias("out"))

    def step(a: Column, r: Column) -> Column:
        due = F.coalesce(a["last"] + 1 == r["__k"], F.lit(False))
        arrivals = F.when(due, a["qty"]).otherwise(F.lit(0.0))
        stuck = a["stuck"] + F.when(due, F.lit(0.0)).otherwise(a["qty"])
        order = placed_order(r["__s"], a["on_hand"], a["backlog"], stuck, cfg.clip_negative_orders)
        on_hand, backlog = settle(a["on_hand"], a["backlog"], arrivals, r["y_true"])
        cost = on_hand * r["c_over"] + backlog * r["c_under"]
        row = F.struct(order.alias("order_quantity"), on_hand.alias("sim_on_hand"), backlog.alias("sim_backlog"),
                       arrivals.alias("sim_arrivals"), cost.alias("sim_total_cost"))
        return F.struct(on_hand.alias("on_hand"), backlog.alias("backlog"), stuck.alias("stuck"),
                        r["__k"].cast("int").alias("last"), F.coalesce(order, F.lit(0.0)).alias("qty"),
                        F.concat(a["out"], F.array(row)).alias("out"))

    folded = packed.withColumn("sim", F.aggregate("h", start, step, lambda a: a["out"]))
    flat = folded.select(*keys, F.explode(F.arrays_zip("h", "sim")).alias("z"))
    out = flat.select(*keys, *[F.col(f"z.h.{n}").alias(n) for n in kept if n != "__s"],
                      *[F.col(f"z.sim.{n}").alias(n) for n in ("order_quantity", *SIM)])
    return inventory_costs(out, cfg, profile)


def _simulate_capped(df: DataFrame, cfg: InventoryConfig, profile: DataFrame | None, initial: float) -> DataFrame:
    groups, keys = model_keys(df), [*model_keys(df), "series_id"]
    rows = cut_lineage(with_level(decision_rows(df), cfg, profile).drop("order_quantity", *SIM))
    folds = sorted(r[0] for r in rows.select("fold_id").distinct().collect())
    q_cols = quantile_columns(df)
    state, parts = None, []
    for f in folds:
        now = rows.where(F.col("fold_id") == f)
        if state is None:
            now = now.withColumns({"__oh": F.lit(float(initial)), "__bl": F.lit(0.0), "__st": F.lit(0.0),
                                   "__last": F.lit(None).cast("int"), "__qty": F.lit(0.0)})
        else:
            now = now.join(state, keys, "left").fillna(
                {"__oh": float(initial), "__bl": 0.0, "__st": 0.0, "__qty": 0.0})
        due = F.coalesce(F.col("__last") + 1 == F.lit(f), F.lit(False))
        now = now.withColumns({"sim_arrivals": F.when(due, F.col("__qty")).otherwise(F.lit(0.0)),
                               "__st": F.col("__st") + F.when(due, F.lit(0.0)).otherwise(F.col("__qty"))})
        now = now.withColumn("__request", F.coalesce(placed_order(F.col("__s"), F.col("__oh"), F.col("__bl"),
                                                               F.col("__st"), cfg.clip_negative_orders), F.lit(0.0)))
        now = capacity_allocate(now, float(cfg.global_capacity_units), groups, q_cols, order="__request",
                                out="order_quantity")
        oh, bl = settle(F.col("__oh"), F.col("__bl"), F.col("sim_arrivals"), F.col("y_true"))
        done = now.withColumns({"sim_on_hand": oh, "sim_backlog": bl})
        done = cut_lineage(done.withColumn("sim_total_cost", F.col("sim_on_hand") * F.col("c_over")
                                           + F.col("sim_backlog") * F.col("c_under")))
        new = done.select(*keys, F.col("sim_on_hand").alias("__oh"), F.col("sim_backlog").alias("__bl"), "__st",
                          F.lit(f).cast("int").alias("__last"), F.col("order_quantity").alias("__qty"))
        if state is not None:
            new = new.unionByName(state.join(new.select(*keys), keys, "left_anti"))
        state = new if state is None else cut_lineage(new)
        parts.append(done.drop("__oh", "__bl", "__st", "__last", "__qty", "__request", "__s"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return inventory_costs(out, cfg, profile)
