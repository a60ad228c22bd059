"""Demand hidden by stock-outs: estimates, and how good they are on days with a known answer."""

from __future__ import annotations

import math
import statistics
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import InventoryConfig
from ..functions.columns import both, floor0, hash52, hash_hex, HASH_SPAN, ratio, sum0
from ..functions.ranks import kth_smallest, value_classes
from ..session import materialise
from .panel import OPERATIVE_HOURS

SCALING_FACTOR = 1.2
CENSORED_SHARE = 0.30
SLOTS = 1024
LISTED = 256  # distinct severities up to which a nested draw finds one in a list rather than by a join
SURE = 8.0  # standard deviations to each side in which the last hash of a draw is looked for
DRAWS = "array<struct<seed: bigint, severity_hours: double>>"
CLOSED_FORM = ("historical_mean", "clipped_scaling")
Teacher = Callable[[DataFrame], DataFrame]


def is_clean() -> Column:
    return F.coalesce(F.col("stockout_hours") == 0, F.lit(False))


def stockout_share(hours: Column) -> Column:
    """Part of the operative hours that was out of stock."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), hours / F.lit(OPERATIVE_HOURS)))


def clean_mean(panel: DataFrame) -> Column:
    """Mean of the series' clean days; the table's clean mean where it has none."""
    own = F.avg(F.when(is_clean(), F.col("observed_demand"))).over(Window.partitionBy("series_id"))
    overall = panel.where(is_clean()).agg(F.avg("observed_demand")).scalar()
    return F.coalesce(own, overall)


def estimates(panel: DataFrame, strategies: Sequence[str], teacher: Teacher | None = None) -> DataFrame:
    """One ``latent_<strategy>`` column per strategy, all from a single pass over the panel.

    ``teacher`` adds ``teacher_prediction``: a full day's demand as learnt from clean days.
    """
    y, hours = F.col("observed_demand"), F.col("stockout_hours")
    out, df = {}, panel
    for s in strategies:
        if s == "none":
            est = y
        elif s == "historical_mean":
            est = both(F.greatest, y, clean_mean(panel))
        elif s == "clipped_scaling":
            est = F.greatest(y, y * F.lit(SCALING_FACTOR))
        elif s == "supervised":
            if teacher is None:
                raise ValueError("the supervised strategy needs a teacher")
            df = teacher(df)
            est = y + stockout_share(hours) * floor0("teacher_prediction")
        else:
            raise ValueError(f"unknown imputation strategy: {s}")
        out[f"latent_{s}"] = F.when(is_clean(), y).otherwise(F.coalesce(est, y))
    return df.withColumns(out).drop("teacher_prediction")


def impute_latent(panel: DataFrame, strategy: str = "historical_mean", teacher: Teacher | None = None) -> DataFrame:
    """Replace censored demand, keeping the original and a flag. Clean days are never changed."""
    df = estimates(panel, [strategy], teacher)
    flag = F.lit(False) if strategy == "none" else ~is_clean()
    return (df.withColumn("is_imputed", flag)
            .withColumnsRenamed({"observed_demand": "original_observed_demand",
                                 f"latent_{strategy}": "latent_demand_est"})
            .withColumn("observed_demand", F.col("latent_demand_est"))
            .select(*panel.columns, "latent_demand_est", "original_observed_demand", "is_imputed"))


def latent_long(panel: DataFrame, strategies: Sequence[str] = CLOSED_FORM, teacher: Teacher | None = None) -> DataFrame:
    """Series, date and strategy with observed demand, estimate and flag."""
    df = estimates(panel, strategies, teacher)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(f"latent_{s}").alias("latent_demand_est"))
                               for s in strategies]))
    return df.select("series_id", "date", F.col("observed_demand").alias("observed"), "stockout_hours",
                     (~is_clean()).alias("is_imputed"), each.alias("e")).select(
        "series_id", "date", "e.strategy", "observed", "e.latent_demand_est", "stockout_hours", "is_imputed")


def draw_cuts(clean: DataFrame, seeds: Sequence[int], share: float, n_clean: int) -> dict[int, str]:
    """For each seed the hash of the last row that it draws, as ``hash_hex`` digits.

    Hashes are spread evenly, so the one wanted is known within some standard deviations of its rank. Hashes in that span are ranked one by one
    and those below and above it are two more classes; should a span miss (days that come many times), all are ranked.
    """
    rows = clean.select(day_key().alias("__day")).withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    rows = rows.select("seed", hash_hex("__day", "seed").alias("__x"))
    n = F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(share)))
    p = max(1, math.floor(n_clean * share)) / n_clean
    room = SURE * (math.sqrt(p * max(0.0, 1.0 - p) / n_clean) + 1.0 / n_clean)
    lo, hi = (min(max(int((p + d) * HASH_SPAN), 0), int(HASH_SPAN) - 1) for d in (-room, room))
    each = F.conv("__x", 16, 10).cast("bigint")
    near = F.when(F.col("__x") < f"{lo:013x}", F.lit(-1)).when(F.col("__x") > f"{hi:013x}", F.lit(int(HASH_SPAN))).otherwise(each)
    for h in (near, each):
        h = F.coalesce(h, F.lit(0))  # never null, which spares a second look at the hash
        cuts = {r["seed"]: r["__cut"] for r in kth_smallest(rows.withColumn("__h", h), ["seed"], "__h", n, "__cut").collect()}  # a row per draw
        if all(0 <= c < HASH_SPAN for c in cuts.values()):
            break
    return {s: f"{c:013x}" for s, c in cuts.items()}


def synthetic_censor(panel: DataFrame, seeds: Sequence[int], share: float = CENSORED_SHARE,
                     mask: Column | None = None, nested: bool = False) -> DataFrame:
    """Clean days picked for each seed, with a severity drawn from the real stock-outs of the same rows.

    Picks are the rows with the smallest hash of (series, date, seed), so a draw depends on
    neither partitioning nor row order. The severity is read off the distribution of real
    severities at a second hash: each distinct severity covers a run of ranks, cut into slots
    to make the lookup an equi-join.

    ``nested`` gives the whole panel instead, in which the column ``draws`` lists the seeds that pick the row and its severity under each, after those
    that it lists already: rows stay where they are, however many draws there are. ``long_draws`` makes the picks of it.
    """
    window = panel if mask is None else panel.where(mask)
    pool = window.where(F.col("stockout_hours") > 0).select("stockout_hours")
    clean = window.where(is_clean()).select("series_id", "date", F.col("observed_demand").alias("true_demand"))
    counts = window.agg(F.count_if(is_clean()).alias("clean"), F.count_if(F.col("stockout_hours") > 0).alias("out")).first()
    if not counts["clean"] or not counts["out"]:
        raise ValueError(f"synthetic censoring needs clean days and real stock-outs, found {counts['clean']} "
                         f"and {counts['out']}")
    cuts = draw_cuts(clean, seeds, share, counts["clean"])
    size = counts["out"]
    sev = value_classes(pool, [], "stockout_hours")
    rank = lambda u: F.floor(u * F.lit(float(size)) / F.lit(HASH_SPAN))
    if nested:
        classes = sev.orderBy("before").limit(LISTED + 1).collect()
        if len(classes) > LISTED:
            return with_draws(panel, synthetic_censor(panel, seeds, share, mask))
        ends, hours = (F.array(*[F.lit(x) for x in v]) for v in ([r["before"] + r["mass"] for r in classes], [r["stockout_hours"] for r in classes]))
        day = F.col("__day")
        hit = F.array_compact(F.array(*[F.when(hash_hex(day, F.lit(str(int(s)))) <= cuts[s], F.lit(int(s)).cast("bigint")) for s in seeds]))
        drawn = F.transform(hit, lambda s: F.struct(s.alias("seed"), rank(hash52(day, s.cast("string"), F.lit("severity"))).alias("rank")))
        drawn = F.transform(drawn, lambda d: F.struct(d["seed"].alias("seed"), F.get(hours, F.size(F.filter(ends, lambda e: e <= d["rank"]))).alias("severity_hours")))
        keyed = panel.withColumn("__day", day_key())
        return add_draws(keyed, F.when(is_clean() if mask is None else is_clean() & mask, drawn)).drop("__day")
    pairs = F.array(*[F.struct(F.lit(int(s)).alias("seed"), F.lit(cuts[s]).alias("cut")) for s in seeds])
    drawn = clean.withColumn("__day", day_key()).withColumn("__d", F.explode(pairs)).withColumns({"seed": F.col("__d.seed"), "__to": F.col("__d.cut")}).drop("__d")
    picked = drawn.where(hash_hex("__day", "seed") <= F.col("__to"))
    picked = picked.withColumn("__rank", rank(hash52("__day", "seed", F.lit("severity"))))
    slot = F.floor(F.col("__rank") * SLOTS / F.lit(size))
    sev = sev.select(F.col("stockout_hours").alias("severity_hours"), F.col("before").alias("__lo"),
                     (F.col("before") + F.col("mass")).alias("__hi"),
                     F.explode(F.sequence(F.floor(F.col("before") * SLOTS / F.lit(size)),
                                          F.floor((F.col("before") + F.col("mass") - 1) * SLOTS / F.lit(size)))).alias("__slot"))
    joined = picked.withColumn("__slot", slot).join(sev, "__slot").where(
        (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
    return joined.select("seed", "series_id", "date", "true_demand", "severity_hours", censored_demand().alias("censored_demand"))


def day_key() -> Column:
    """Series and date as ``hash52`` joins them: null, which it skips, where both are."""
    return F.when(F.col("series_id").isNotNull() | F.col("date").isNotNull(), F.concat_ws("|", "series_id", F.col("date").cast("string")))


def censored_demand() -> Column:
    return F.col("true_demand") * (1.0 - F.col("severity_hours") / F.lit(OPERATIVE_HOURS))


def add_draws(panel: DataFrame, more: Column) -> DataFrame:
    """``more`` draws of each row, null for none, after those that it has."""
    more = F.coalesce(more, F.array().cast(DRAWS))
    return panel.withColumn("draws", F.concat("draws", more) if "draws" in panel.columns else more)


def with_draws(panel: DataFrame, draws: DataFrame) -> DataFrame:
    """The panel with the picks of a table of draws in its column ``draws``, as ``synthetic_censor`` nests them."""
    per_day = draws.groupBy("series_id", "date").agg(F.collect_set(F.struct(F.col("seed").cast("bigint").alias("seed"), "severity_hours")).alias("__more"))
    return add_draws(panel.join(per_day, ["series_id", "date"], "left"), F.when(is_clean(), F.col("__more"))).drop("__more")


def long_draws(panel: DataFrame) -> DataFrame:
    """The picks of a panel with nested draws, one row each."""
    rows = panel.select("series_id", "date", F.col("observed_demand").alias("true_demand"), F.explode("draws").alias("__d"))
    rows = rows.select("__d.seed", "series_id", "date", "true_demand", "__d.severity_hours")
    return rows.withColumn("censored_demand", censored_demand())


def censored_panel(panel: DataFrame, draws: DataFrame, seeds: Sequence[int] | None = None) -> DataFrame:
    """The whole panel once per seed with the drawn days censored; ``true_demand`` marks them."""
    n = list(seeds) if seeds is not None else [r["seed"] for r in draws.select("seed").distinct().collect()]
    each = panel.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in n])))
    j = each.join(draws, ["seed", "series_id", "date"], "left")
    hit = F.col("true_demand").isNotNull()
    return j.withColumns({
        "observed_demand": F.when(hit, F.col("censored_demand")).otherwise(F.col("observed_demand")),
        "stockout_hours": F.when(hit, F.col("severity_hours")).otherwise(F.col("stockout_hours")),
    }).drop("censored_demand", "severity_hours")


def scored_draw(panel: DataFrame, seed: int, strategies: Sequence[str], teacher: Teacher | None = None) -> DataFrame:
    """Estimates on the censored days of one draw: (strategy, signal, true_demand) rows."""
    draws = synthetic_censor(panel, [seed])
    cens = materialise(censored_panel(panel, draws, [seed]), "censored-panel")
    est = estimates(cens, strategies, teacher).where(F.col("true_demand").isNotNull())
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(f"latent_{s}").alias("signal"))
                               for s in strategies]))
    return est.select("series_id", "date", "true_demand", each.alias("e")).select(
        "series_id", "date", "e.strategy", "e.signal", "true_demand")


def imputation_quality(panel: DataFrame, seed: int = 42, strategies: Sequence[str] = CLOSED_FORM,
                       teacher: Teacher | None = None) -> DataFrame:
    """MAE, RMSE, bias and MAPE of each strategy on one synthetic draw."""
    e = F.col("signal") - F.col("true_demand")
    pos = F.col("true_demand") > 0
    return scored_draw(panel, seed, strategies, teacher).groupBy("strategy").agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        (F.avg(F.when(pos, F.abs(e) / F.col("true_demand"))) * 100.0).alias("mape"),
        F.count(F.lit(1)).alias("n_eval"))


def strategy_label(s: str) -> str:
    return "Observed" if s == "none" else f"Latent_{s}"


def fair_cost(panel: DataFrame, cfg: InventoryConfig = InventoryConfig(), seed: int = 42,
              strategies: Sequence[str] = ("none", *CLOSED_FORM), teacher: Teacher | None = None) -> DataFrame:
    """The same order policy and flat costs on every strategy's signal, charged against one known truth."""
    cu, co = cfg.stockout_cost, cfg.overstock_cost
    z = statistics.NormalDist().inv_cdf(cu / (cu + co))
    rows = materialise(scored_draw(panel, seed, strategies, teacher), "scored-draw")
    spread = rows.groupBy("strategy").agg(F.stddev_pop("true_demand").alias("__sd"))
    rows = rows.join(spread, "strategy")
    q = F.greatest(F.col("signal") + F.lit(z) * F.col("__sd"), F.lit(0.0))
    rows = rows.withColumn("__q", q)
    short = floor0(F.col("true_demand") - F.col("__q"))
    over = floor0(F.col("__q") - F.col("true_demand"))
    labels = F.create_map(*[F.lit(x) for s in strategies for x in (s, strategy_label(s))])
    return rows.groupBy(F.element_at(labels, F.col("strategy")).alias("strategy")).agg(
        F.avg(F.abs(F.col("signal") - F.col("true_demand"))).alias("signal_mae"),
        sum0(F.lit(co) * over + F.lit(cu) * short).alias("total_cost"),
        ((1.0 - ratio(F.sum(short), F.sum("true_demand"))) * 100.0).alias("fill_rate"),
        F.avg("__q").alias("mean_order"), F.count(F.lit(1)).alias("n_eval"))


def sample_series(panel: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` series by hash order: the ids only."""
    return (panel.select("series_id").distinct().orderBy(hash52("series_id", F.lit(seed))).limit(n))


def fair_cost_sample(panel: DataFrame, n_series: int = 30, cfg: InventoryConfig = InventoryConfig(), seed: int = 42,
                     strategies: Sequence[str] = ("none", *CLOSED_FORM), teacher: Teacher | None = None) -> DataFrame:
    """``fair_cost`` on a sample of series, with the size of the source panel recorded."""
    kept = panel.join(sample_series(panel, n_series, seed), "series_id", "left_semi")
    source = panel.agg(F.count_distinct("series_id")).scalar()
    sampled = kept.agg(F.count_distinct("series_id")).scalar()
    return fair_cost(kept, cfg, seed, strategies, teacher).withColumns(
        {"source_panel_series": source, "sampled_series": sampled})


def draw_means(panel: DataFrame, draws: DataFrame) -> DataFrame:
    """``seed, series_id, clean_mean``: the mean of a series' clean days without those that the draw censors, for each series it touches.

    Where no day is left it is the mean of the whole table's clean days without the draw's. Panel totals less the draw's own: the panel is
    read once, whatever the number of draws.
    """
    n_s = lambda c, n, s: (F.count(c).alias(n), F.sum(c).alias(s))
    totals = panel.where(is_clean()).groupBy("series_id").agg(*n_s("observed_demand", "__n", "__s"))
    taken = draws.groupBy("seed", "series_id").agg(*n_s("true_demand", "__tn", "__ts"))
    whole = draws.groupBy("seed").agg(*n_s("true_demand", "__an", "__as"))
    n, s = (panel.where(is_clean()).agg(f("observed_demand")).scalar() for f in (F.count, F.sum))
    every = whole.select("seed", ratio(s - F.col("__as"), n - F.col("__an")).alias("__all"))
    own = F.when(F.col("__n") > F.col("__tn"), (F.col("__s") - F.col("__ts")) / (F.col("__n") - F.col("__tn")))
    rows = taken.join(totals, "series_id").join(F.broadcast(every), "seed")  # a row per draw
    return rows.select("seed", "series_id", F.coalesce(own, F.col("__all")).alias("clean_mean"))


def draw_errors(panel: DataFrame, draws: DataFrame, strategies: Sequence[str],
                teacher: Teacher | None = None) -> DataFrame:
    """Mean absolute error per seed and strategy: every draw in one job, which looks at drawn days only."""
    y = F.col("observed_demand")
    est = {"none": y, "clipped_scaling": F.greatest(y, y * F.lit(SCALING_FACTOR)),
           "historical_mean": F.greatest(y, F.col("clean_mean"))}
    rows = draws.join(draw_means(panel, draws), ["seed", "series_id"]).withColumnsRenamed(
        {"censored_demand": "observed_demand", "severity_hours": "stockout_hours"})
    if "supervised" in strategies:
        if teacher is None:
            raise ValueError("the supervised strategy needs a teacher")
        rows = teacher(rows.join(panel.drop("observed_demand", "stockout_hours"), ["series_id", "date"]))
        est["supervised"] = y + stockout_share(F.col("stockout_hours")) * floor0("teacher_prediction")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), est[s].alias("signal")) for s in strategies]))
    long = rows.select("seed", "true_demand", each.alias("e")).select("seed", "true_demand", "e.*")
    return long.groupBy("seed", "strategy").agg(
        F.avg(F.abs(F.col("signal") - F.col("true_demand"))).alias("mae"), F.count(F.lit(1)).alias("n_eval"))
