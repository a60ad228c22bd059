"""Queries on costs, orders, capacity and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import BusinessConfig, InventoryConfig
from ..operators import capacity as K
from ..operators import costs as C
from ..operators import ledger as L
from ..operators import metrics as M
from ..operators import orders as O
from ..operators import promote as T
from ..session import materialise
from .base import cte, query
from .frames import costed_forecasts, daily_panel, forecasts
from .sqlparts import costed, level

PRED = "data_strategy model_name series_id @date #fold_id"

cte("cost_stats", """SELECT series_id, avg(observed_demand) AS m, coalesce(stddev_samp(observed_demand), 0e0) AS sd,
 avg(CASE WHEN observed_demand=0 THEN 1e0 ELSE 0e0 END) AS z, avg(CASE WHEN stockout_hours>0 THEN 1e0 ELSE 0e0 END) AS o,
 arg_min(third_category_id, date) AS third_category_id FROM daily GROUP BY 1""", "daily")


def _rank(v: str) -> str:
    """Average-tie percentile rank; values that differ only in the last bits count as tied on both sides."""
    return f"""CASE WHEN (min({v}) OVER ())=(max({v}) OVER ()) THEN 5e-1 ELSE (rank() OVER (ORDER BY {v}) +
 (count(*) OVER (PARTITION BY {v})-1)/2e0-1)/(count({v}) OVER ()-1e0) END"""


cte("cost_profile", f"""SELECT series_id, co AS c_over, cu AS c_under, cu/(cu+co) AS critical_fractile, per AS synthetic_perishability_score,
 cri AS service_criticality_score FROM (SELECT *, (8e-1+8e-1*per)*(9e-1+5e-1*slow) AS co, 4e0*(9e-1+5e-1*cri) AS cu FROM (SELECT series_id,
 5e-1*cz+3e-1*cv+2e-1*ir AS per, 6e-1*ir+4e-1*(1-dr) AS slow, 7e-1*dr+3e-1*orr AS cri FROM (SELECT s.*, {_rank('round(m,12)')} AS dr, {_rank('round(z,12)')} AS ir,
 {_rank('round(o,12)')} AS orr FROM cost_stats s) JOIN (SELECT third_category_id, {_rank('round(zz,12)')} AS cz, {_rank('round(vv,12)')} AS cv FROM
 (SELECT third_category_id, avg(z) AS zz, avg(coalesce(sd/nullif(m,0),0e0)) AS vv FROM cost_stats GROUP BY 1)) USING (third_category_id)))""",
    "cost_stats")
PROFILE = "series_id ~c_over ~c_under ~critical_fractile ~synthetic_perishability_score ~service_criticality_score"
SERIES_COSTS = InventoryConfig(use_series_costs=True)


@query("series_cost_stats", "series_id ~mean_observed_demand ~demand_std ~zero_demand_rate ~stockout_day_rate "
       "~coefficient_variation #third_category_id", "A27", "cost_stats",
       """SELECT series_id, m AS mean_observed_demand, sd AS demand_std, z AS zero_demand_rate, o AS stockout_day_rate,
 coalesce(sd/nullif(m,0),0e0) AS coefficient_variation, third_category_id FROM cost_stats""")
def _(spark, sf):
    return C.series_cost_stats(daily_panel(spark, sf))


@query("series_cost_profile", PROFILE, "I04 W06 J02 A27 I01", "cost_profile", "SELECT * FROM cost_profile")
def _(spark, sf):
    return C.series_cost_profile(daily_panel(spark, sf), SERIES_COSTS)


@query("attached_series_costs", PRED + " ~c_over ~c_under ~critical_fractile", "J01", "forecasts cost_profile",
       "SELECT f.*, c_over, c_under, critical_fractile FROM forecasts f JOIN cost_profile USING (series_id)")
def _(spark, sf):
    return C.attach_series_costs(forecasts(spark, sf), SERIES_COSTS,
                                 C.series_cost_profile(daily_panel(spark, sf), SERIES_COSTS))


@query("order_quantity", PRED + " ~order_quantity", "I01 I02 M14", "orders_placed", "SELECT * FROM orders_placed")
def _(spark, sf):
    return O.order_quantity(forecasts(spark, sf))


@query("order_quantity_after_stock", PRED + " ~order_quantity", "I02", "forecasts", digits=5,
       sql=f"SELECT *, greatest({level('8e-1')} - (coalesce(m28, 0e0)*3 + stockout_hours), 0e0) AS order_quantity FROM forecasts")
def _(spark, sf):
    f = forecasts(spark, sf)
    on_hand = F.coalesce(F.col("q_0_5") / 7.0, F.lit(0.0)) * 3
    f = f.join(f.where(F.col("model_name") == "rolling_normal").select(
        "data_strategy", "series_id", "date", on_hand.alias("stock")), ["data_strategy", "series_id", "date"])
    return O.order_quantity(f, stock="stock", on_order="stockout_hours")


@query("series_cost_orders", PRED + " ~order_quantity ~total_cost", "I02 I03 J01", "forecasts cost_profile", digits=5,
       sql=costed(f"""(SELECT f.*, c_over, c_under, critical_fractile, greatest({level('critical_fractile')}, 0e0) AS order_quantity
 FROM forecasts f JOIN cost_profile USING (series_id))"""))
def _(spark, sf):
    prof = C.series_cost_profile(daily_panel(spark, sf), SERIES_COSTS)
    return O.inventory_costs(O.order_quantity(forecasts(spark, sf), SERIES_COSTS, prof), SERIES_COSTS, prof)


@query("inventory_costs", PRED + " ~order_quantity ~overstock_units ~stockout_units ~overstock_cost ~stockout_cost ~total_cost",
       "I03", "costed", "SELECT * FROM costed")
def _(spark, sf):
    return costed_forecasts(spark, sf)


cte("cost_summary", """SELECT data_strategy, model_name, backend_name, count(*) AS observations, avg(order_quantity) AS mean_order_quantity,
 sum(overstock_units) AS total_overstock_units, sum(stockout_units) AS total_stockout_units, sum(overstock_cost) AS total_overstock_cost,
 sum(stockout_cost) AS total_stockout_cost, sum(total_cost) AS total_cost, avg(total_cost) AS mean_cost,
 avg(CASE WHEN stockout_units<=0 THEN 1e0 ELSE 0e0 END) AS service_level, sum(least(y_true, order_quantity))/sum(y_true) AS fill_rate
 FROM costed GROUP BY 1, 2, 3""", "costed")
COST = ("data_strategy model_name backend_name #observations ~mean_order_quantity ~total_overstock_units ~total_stockout_units "
        "~total_overstock_cost ~total_stockout_cost ~total_cost ~mean_cost ~service_level ~fill_rate")


@query("cost_summary", COST, "A25 P16", "cost_summary", "SELECT * FROM cost_summary", digits=5)
def _(spark, sf):
    return M.summarize_costs(costed_forecasts(spark, sf))


@query("metrics_with_costs", "data_strategy model_name backend_name ~mae ~total_cost", "J07 A22 A25", "cost_summary", digits=5,
       sql="""SELECT c.data_strategy, c.model_name, c.backend_name, m.mae, c.total_cost FROM cost_summary c JOIN
 (SELECT data_strategy, model_name, avg(abs(y_pred-y_true)) AS mae FROM forecasts GROUP BY 1, 2) m USING (data_strategy, model_name)""")
def _(spark, sf):
    f = materialise(costed_forecasts(spark, sf), "forecasts")
    keys = ["data_strategy", "model_name", "backend_name"]
    m = M.summarize_predictions(f).where(F.col("fold_id").isNull()).select(*keys, "mae")
    return M.summarize_costs(f).join(m, keys)


_RATIO = costed(f"""(SELECT * REPLACE (CASE WHEN q_0_1 IS NULL THEN y_pred ELSE greatest({level('(ratio/(ratio+1e0))')}, 0e0) END AS order_quantity,
 ratio AS c_under) FROM orders_placed CROSS JOIN (VALUES (1e0),(2e0),(4e0),(8e0),(1e1)) v(ratio))""")


@query("cost_sensitivity", "~ratio model_name data_strategy ~total_cost ~overstock_cost ~stockout_cost ~mean_order_quantity",
       "A26 J15", "orders_placed", digits=4,
       sql=f"""SELECT ratio, model_name, data_strategy, sum(total_cost) AS total_cost, sum(overstock_cost) AS overstock_cost,
 sum(stockout_cost) AS stockout_cost, avg(order_quantity) AS mean_order_quantity FROM ({_RATIO}) GROUP BY 1, 2, 3""")
def _(spark, sf):
    return O.cost_sensitivity(costed_forecasts(spark, sf))


# The newest origin of each model, series and fold, and demand segments of its order.
cte("decisions", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY data_strategy, model_name, series_id, fold_id
 ORDER BY date DESC) AS rn FROM costed) WHERE rn=1""", "costed")
cte("segments", """SELECT data_strategy, fold_id, series_id, w AS width, v AS value FROM (SELECT *, unnest([
 {'w': w1, 'v': 4e0-5e0*5e-2}, {'w': w2, 'v': 4e0-5e0*3e-1}, {'w': w3, 'v': 4e0-5e0*7e-1}, {'w': cap-w1-w2-w3, 'v': 4e0-5e0*9e-1}], recursive := true)
 FROM (SELECT *, least(greatest(q_0_9-q_0_5,0e0), cap-w1-w2) AS w3 FROM (SELECT *, least(greatest(q_0_5-q_0_1,0e0), cap-w1) AS w2 FROM
 (SELECT *, greatest(order_quantity,0e0) AS cap, least(greatest(q_0_1,0e0), greatest(order_quantity,0e0)) AS w1 FROM decisions
 WHERE model_name='rolling_normal')))) WHERE w>0""", "decisions")
_SHARE = """SELECT data_strategy, fold_id, value, greatest(0e0, least(1e0, (cap-(run-mass))/mass)) AS share FROM (SELECT *,
 sum(mass) OVER (PARTITION BY data_strategy, fold_id ORDER BY value DESC) AS run FROM (SELECT data_strategy, fold_id, value, sum(width) AS mass
 FROM segments WHERE value>0 GROUP BY 1, 2, 3)) JOIN (SELECT data_strategy, fold_id, sum(order_quantity)*F AS cap FROM decisions
 WHERE model_name='rolling_normal' GROUP BY 1, 2) USING (data_strategy, fold_id)"""


def decisions(spark, sf):
    return materialise(L.decision_rows(costed_forecasts(spark, sf)), "decisions")


@query("decision_rows", PRED + " ~order_quantity", "I09", "decisions", "SELECT * FROM decisions")
def _(spark, sf):
    return decisions(spark, sf)


Q = ["q_0_1", "q_0_5", "q_0_9"]


@query("value_segments", "data_strategy #fold_id series_id ~width ~value", "I05", "segments", "SELECT * FROM segments")
def _(spark, sf):
    d = decisions(spark, sf).where(F.col("model_name") == "rolling_normal")
    seg = K.value_segments(F.col("order_quantity"), Q, F.col("c_under"), F.col("c_over"))
    return d.select("data_strategy", "fold_id", "series_id", F.explode(seg).alias("s")).select(
        "data_strategy", "fold_id", "series_id", "s.width", "s.value")


@query("capacity_allocation", "data_strategy #fold_id series_id ~order_quantity ~allocated", "I06", "segments", digits=5,
       sql=f"""SELECT d.data_strategy, d.fold_id, d.series_id, order_quantity, coalesce(a, 0e0) AS allocated FROM decisions d LEFT JOIN
 (SELECT data_strategy, fold_id, series_id, sum(width*share) AS a FROM segments JOIN ({_SHARE.replace('*F', '*6e-1')})
 USING (data_strategy, fold_id, value) GROUP BY 1, 2, 3) USING (data_strategy, fold_id, series_id) WHERE model_name='rolling_normal'""")
def _(spark, sf):
    d = decisions(spark, sf).where(F.col("model_name") == "rolling_normal")
    keys = ["data_strategy", "fold_id"]
    cap = d.groupBy(*keys).agg((F.sum("order_quantity") * 0.6).alias("cap"))
    return K.capacity_allocate(d.join(cap, keys), "cap", keys, Q)


_SWEEP = " UNION ALL ".join(f"""SELECT {f} AS capacity_fraction, sum(greatest(y_true-coalesce(a,0e0),0e0)*4e0) AS piecewise_penalty,
 sum(greatest(y_true-order_quantity*{f},0e0)*4e0) AS proportional_penalty, count(*) FILTER (coalesce(a,0e0)<1e-9) AS piecewise_series_zeroed
 FROM decisions d LEFT JOIN (SELECT data_strategy, fold_id, series_id, sum(width*share) AS a FROM segments JOIN ({_SHARE.replace('*F', f'*{f}')})
 USING (data_strategy, fold_id, value) GROUP BY 1, 2, 3) USING (data_strategy, fold_id, series_id)
 WHERE model_name='rolling_normal' AND data_strategy='Observed'""" for f in ("75e-2", "5e-1", "3e-1"))


@query("capacity_sweep", "~capacity_fraction ~piecewise_penalty ~flat_penalty ~proportional_penalty #piecewise_series_zeroed "
       "~piecewise_vs_proportional_pct", "I07 J15", "segments", digits=4,
       sql=f"""SELECT capacity_fraction, piecewise_penalty, proportional_penalty AS flat_penalty, proportional_penalty, piecewise_series_zeroed,
 (proportional_penalty-piecewise_penalty)/proportional_penalty*1e2 AS piecewise_vs_proportional_pct FROM ({_SWEEP})""")
def _(spark, sf):
    d = decisions(spark, sf).where((F.col("model_name") == "rolling_normal") & (F.col("data_strategy") == "Observed"))
    return K.capacity_sweep(d, [0.75, 0.5, 0.3], Q)


_SIM = f"""SELECT d.*, CASE WHEN model_name='seasonal_naive' THEN y_pred ELSE {level('8e-1')} END AS s FROM decisions d"""
_LEDGER = """SELECT data_strategy, model_name, series_id, fold_id, date, order_quantity, sim_on_hand, sim_backlog, sim_arrivals,
 sim_on_hand*1e0+sim_backlog*4e0 AS sim_total_cost, greatest(order_quantity-y_true,0e0)+4e0*greatest(y_true-order_quantity,0e0) AS total_cost FROM (
 WITH RECURSIVE base AS (BASE), chain AS (
 SELECT data_strategy, model_name, series_id, fold_id, date, y_true, greatest(s, 0e0) AS order_quantity, 0e0 AS sim_on_hand, y_true AS sim_backlog,
 0e0 AS sim_arrivals FROM base WHERE fold_id=0
 UNION ALL SELECT b.data_strategy, b.model_name, b.series_id, b.fold_id, b.date, b.y_true, greatest(b.s-(c.sim_on_hand-c.sim_backlog), 0e0),
 greatest(c.sim_on_hand+c.order_quantity-c.sim_backlog-b.y_true, 0e0), greatest(c.sim_backlog+b.y_true-c.sim_on_hand-c.order_quantity, 0e0), c.order_quantity
 FROM chain c JOIN base b ON b.data_strategy=c.data_strategy AND b.model_name=c.model_name AND b.series_id=c.series_id AND b.fold_id=c.fold_id+1)
 SELECT * FROM chain)""".replace("BASE", _SIM)
SIM = PRED + " ~order_quantity ~sim_on_hand ~sim_backlog ~sim_arrivals ~sim_total_cost ~total_cost"


@query("order_up_to_ledger", SIM, "I08 I09", "decisions", _LEDGER, digits=5)
def _(spark, sf):
    return L.simulate_ledger(costed_forecasts(spark, sf))


@query("ledger_cost_summary", "data_strategy model_name ~sim_total_cost ~sim_mean_cost ~sim_service_level", "A25 I08", "decisions",
       digits=4, sql=f"""SELECT data_strategy, model_name, sum(sim_total_cost) AS sim_total_cost, avg(sim_total_cost) AS sim_mean_cost,
 avg(CASE WHEN sim_backlog<=0 THEN 1e0 ELSE 0e0 END) AS sim_service_level FROM ({_LEDGER}) GROUP BY 1, 2""")
def _(spark, sf):
    return M.summarize_costs(L.simulate_ledger(costed_forecasts(spark, sf)))


@query("capped_ledger", SIM, "I08 I06")
def _(spark, sf):
    d = materialise(costed_forecasts(spark, sf), "forecasts")
    want = L.decision_rows(d).where(F.col("fold_id") == 0).groupBy("data_strategy", "model_name").agg(
        F.sum("order_quantity").alias("t")).agg(F.min("t")).first()[0]
    return L.simulate_ledger(d, InventoryConfig(global_capacity_units=want * 0.7))


_CHAMP = BusinessConfig(champion_model_name="seasonal_naive", champion_backend_name="heuristic")


_DECISION = """SELECT 'config' AS champion_source, c.data_strategy AS champion_data_strategy, c.model_name AS champion_model_name,
 x.data_strategy AS challenger_data_strategy, x.model_name AS challenger_model_name, c.total_cost AS champion_total_cost,
 x.total_cost AS challenger_total_cost, (c.total_cost-x.total_cost)/c.total_cost*1e2 AS cost_improvement_pct,
 x.service_level-c.service_level AS service_level_delta, (c.total_cost-x.total_cost)>=0 AND x.service_level-c.service_level>=-2e-2 AS promote
 FROM cost_summary c JOIN cost_summary x ON NOT (x.model_name=c.model_name AND x.data_strategy=c.data_strategy)
 WHERE c.model_name='seasonal_naive' AND c.data_strategy='Observed'
 ORDER BY promote DESC, x.total_cost, x.service_level DESC LIMIT 1"""


@query("promotion_decision", "champion_source champion_data_strategy champion_model_name challenger_data_strategy "
       "challenger_model_name ~champion_total_cost ~challenger_total_cost ~cost_improvement_pct ~service_level_delta #promote",
       "I10 L10 P17 J09", "cost_summary", digits=5,
       sql=_DECISION)
def _(spark, sf):
    return T.promotion_decision(M.summarize_costs(costed_forecasts(spark, sf)), _CHAMP)


@query("registry_update", "data_strategy model_name backend_name run_name", "I11 I10", "cost_summary",
       f"""SELECT c.data_strategy, c.model_name, c.backend_name, 'run' AS run_name FROM cost_summary c, ({_DECISION}) d WHERE CASE WHEN promote
 THEN c.data_strategy=challenger_data_strategy AND c.model_name=challenger_model_name ELSE c.data_strategy='Observed' AND c.model_name='seasonal_naive' END""")
def _(spark, sf):
    s = materialise(M.summarize_costs(costed_forecasts(spark, sf)), "cost-summary")
    return T.registry_update(s, T.promotion_decision(s, _CHAMP), _CHAMP)


