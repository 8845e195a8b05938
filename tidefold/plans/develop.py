"""Development sweep: winners per family and strategy, their test errors, summaries and rule reports."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.functions.arrays import dot, total
from tidefold.operators import compare
from tidefold.operators.cover import as_rules, firing_strengths, standardize
from tidefold.operators.ordered import CHUNK
from tidefold.operators.select import best
from tidefold.operators.sweep import Grid, lag_context, run_sweep
from tidefold.plans.decide import MODEL, candidates, counted_series, open_role, role_metrics, scalers
from tidefold.session import store

# The two selection strategies and their keys.
STRATEGIES = {"validation_rmse": "rmse", "certificate": "certificate"}


class Sweep:
    """Candidates of all series with both prior centers and both confidence levels."""

    def __init__(self, prepared: DataFrame, grid: Grid, series_count: int | None = None, delta_total: float = 0.05,
                 max_len: int | None = None, chunk: int = CHUNK):
        self.grid = grid
        self.lagged = store(
            lag_context(prepared, max(grid.lags), max_len, chunk).withColumn("series_id", F.col("series_id").cast("string")), "role"
        )
        self.specs, self._scored, self.covers = run_sweep(self.lagged, grid, max_len, chunk)
        self.scale = scalers(self.lagged.filter(F.col("role") == "prior"))
        self.deltas = (delta_total / counted_series(self.lagged, series_count), delta_total)

    @cached_property
    def candidates(self) -> DataFrame:
        """Stored when first asked for; the winners, summaries and audit read it."""
        level, second = self.deltas
        return store(candidates(self.specs, self._scored, self.scale, self.grid, level, True, second))

    def selected(self, per_count: bool = False) -> DataFrame:
        """Winner per series, family and strategy (and fixed rule count), with test errors."""
        groups = ["series_id", "family"] + (["wanted_k"] if per_count else [])
        pool = self.candidates
        if per_count:
            fixed = F.col("family") == "fixed_k_dense_tsk"
            pool = pool.withColumn("wanted_k", F.when(fixed, F.col("wanted_k")))
        extra = ["zero_mean_certificate", "certificate_pointwise", "validation_mae"]
        keep = list(dict.fromkeys(["series_id", "family", "wanted_k", *MODEL, *extra]))
        out = None
        for strategy, key in STRATEGIES.items():
            won = best(pool.select(*keep), groups, key).withColumn("selection_strategy", F.lit(strategy))
            out = won if out is None else out.unionByName(won)
        winners = store(out)
        opened = open_role(self.lagged, winners, self.covers)
        keys = ["series_id", "family", "wanted_k", "selection_strategy"]
        # A missing rule count is a group of its own, so the join is NULL-safe.
        tested = role_metrics(opened, keys)
        on = F.lit(True)
        for k in keys:
            on = on & winners[k].eqNullSafe(tested[k])
        return winners.join(tested, on).select(
            winners["*"], tested["test_rmse_raw"].alias("test_rmse"), tested["test_mae_raw"].alias("test_mae"),
            tested["test_target_clipping_rate"], tested["test_forecast_clipping_rate"],
        ).drop("coefficients")

    def audit(self, selected: DataFrame) -> DataFrame:
        """One row for the whole run: counts and flags."""
        alphas = len(self.grid.ridge_alphas)
        built = self.specs.agg(
            F.countDistinct("series_id").alias("completed_series"),
            (F.count_if(~F.col("capped") & F.col("failure").isNull()) * alphas).alias("total_candidates"),
            (F.count_if(F.col("capped")) * alphas).alias("skipped_capped_candidates"),
            F.count_if(F.col("failure").isNotNull()).alias("build_failure_count"),
        )
        chosen = selected.agg(
            F.count("*").alias("selected_rows"), F.bool_and(F.col("test_rmse").isNotNull()).alias("all_tested"),
            F.avg("certificate").alias("mean_certificate"),
        )
        return built.withColumn("_one", F.lit(1)).join(chosen.withColumn("_one", F.lit(1)), "_one").drop("_one")


def best_fixed_count(selected: DataFrame) -> DataFrame:
    """Best rule count among the fixed-count winners of each series and strategy."""
    key = F.when(F.col("selection_strategy") == "certificate", F.col("certificate_untruncated")).otherwise(F.col("validation_rmse"))
    order = Window.partitionBy("series_id", "selection_strategy").orderBy(
        key, "validation_rmse", "validation_mae", "consequent_dimension", "rule_count"
    )
    return (
        selected.filter(F.col("family") == "fixed_k_dense_tsk")
        .withColumn("_rn", F.row_number().over(order))
        .filter("_rn = 1")
        .drop("_rn")
    )


def top_terms(slopes: Column, count: int = 3) -> Column:
    """The lags with the largest coefficients as text, e.g. ``+0.500 y(t-1); -0.200 y(t-7)``."""
    ranked = F.array_sort(
        F.transform(slopes, lambda v, i: F.struct((-F.abs(v)).alias("a"), i.alias("i"), v.alias("v")))
    )
    return F.array_join(
        F.transform(F.slice(ranked, 1, count), lambda t: F.format_string("%+.3f y(t-%d)", t["v"], t["i"] + 1)), "; "
    )


def rule_report(lagged: DataFrame, models: DataFrame, covers: DataFrame, roles=("bound", "validation")) -> tuple[DataFrame, DataFrame]:
    """(summary per rule, detail per rule and lag) in source units for one rule model per series.

    Usage comes from the certification rows; centers, spreads and coefficients
    are array arithmetic on the small model table.
    """
    ruled = models.filter(F.col("k") > 0).join(
        covers.select("series_id", "lag", "k", "feature_mean", "feature_scale", "centers", "spreads", "support"), ["series_id", "lag", "k"]
    )
    lag, rules = F.col("lag"), F.col("rule_count")
    rows = lagged.filter(F.col("role").isin(*roles)).select("series_id", "step", "features")
    joined = rows.join(ruled, "series_id").filter(F.col("step") >= lag)
    z = standardize(F.slice("features", F.lit(1), lag), F.col("feature_mean"), F.col("feature_scale"))
    weights = firing_strengths(
        z, as_rules(F.col("centers"), rules, lag), as_rules(F.col("spreads"), rules, lag), F.col("active")
    )
    used = joined.select("series_id", F.inline(F.array(F.struct(weights.alias("w"))))).select(
        "series_id", (F.array_position("w", F.array_max("w")) - 1).alias("hard"), F.posexplode("w").alias("rule", "weight")
    ).groupBy("series_id", "rule").agg(
        F.avg("weight").alias("mean_firing"), F.count_if(F.col("hard") == F.col("rule")).alias("certification_hard_support")
    )
    scale, mean = F.col("scaler_scale"), F.col("scaler_mean")
    per_rule = ruled.select(
        "*", F.posexplode(F.arrays_zip(
            as_rules(F.col("centers"), rules, lag).alias("c"), as_rules(F.col("spreads"), rules, lag).alias("s"),
            as_rules(F.col("coefficients"), rules, lag + 1).alias("b"), F.col("support").alias("n"),
        )).alias("rule", "r"),
    )
    center = F.zip_with(
        F.zip_with(F.col("r.c"), "feature_scale", lambda c, s: c * s), "feature_mean", lambda v, mu: mean + scale * (v + mu)
    )
    width = F.zip_with(F.col("r.s"), "feature_scale", lambda v, s: v * s * scale)
    slopes = F.zip_with(F.slice(F.col("r.b"), F.lit(2), lag), "feature_scale", lambda b, s: b / s)
    offsets = F.transform("feature_mean", lambda mu: mean + scale * mu)
    shaped = per_rule.withColumns({"center": center, "spread": width, "slopes": slopes}).withColumn(
        "local_intercept_original", mean + scale * F.col("r.b")[0] - dot(F.col("slopes"), offsets)
    ).join(used, ["series_id", "rule"])
    summary = shaped.select(
        "series_id", "candidate_id", (F.col("rule") + 1).alias("rule"), F.col("r.n").alias("prior_support"),
        "certification_hard_support", "mean_firing", (total(F.col("center")) / lag).alias("center_mean"),
        F.col("center")[0].alias("center_lag1"), F.get("center", lag - 1).alias("center_lag_last"),
        (F.col("center")[0] - F.get("center", lag - 1)).alias("center_recent_minus_oldest"),
        (total(F.col("spread")) / lag).alias("mean_spread"), "local_intercept_original",
        top_terms(F.col("slopes")).alias("top_consequent_terms"),
    )
    detail = shaped.select(
        "series_id", (F.col("rule") + 1).alias("rule"), "local_intercept_original", F.col("r.n").alias("prior_support"), "mean_firing",
        F.posexplode(F.arrays_zip(F.col("center").alias("c"), F.col("spread").alias("s"), F.col("slopes").alias("b"))).alias("lag", "t"),
    ).select(
        "series_id", "rule", (F.col("lag") + 1).alias("lag"), F.col("t.c").alias("antecedent_center_original"),
        F.col("t.s").alias("antecedent_spread_original"), F.col("t.b").alias("consequent_coefficient_original"),
        "local_intercept_original", "prior_support", "mean_firing",
    )
    return summary, detail


def summaries(selected: DataFrame, cands: DataFrame) -> tuple[DataFrame, DataFrame]:
    by_strategy = compare.strategy_summary(selected, ["family", "selection_strategy"])
    return by_strategy, compare.radius_chain(cands)
