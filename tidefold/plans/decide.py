"""Candidate tables, selection, deployment gates and the opening of the test role.

Everything up to the decision reads the roles prior, bound and validation only.
Decisions are written (or checkpointed) before any test row is scored.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions import metrics as m
from tidefold.functions.arrays import dot
from tidefold.functions.text import candidate_id
from tidefold.operators import certify
from tidefold.operators.cover import as_rules, rule_forecast, standardize
from tidefold.operators.lags import with_shift
from tidefold.operators.ordered import CHUNK
from tidefold.operators.select import KEYS, best, key_of, robust_gate, simple_gate
from tidefold.operators.sweep import GEOMETRY, Grid, block_id, lag_context, run_sweep
from tidefold.operators.sweep import KEYS as DESIGN
from tidefold.session import cut_lineage, store


def scalers(prepared: DataFrame) -> DataFrame:
    return prepared.groupBy(F.col("series_id").cast("string").alias("series_id")).agg(
        F.first("scaler_mean").alias("scaler_mean"), F.first("scaler_scale").alias("scaler_scale")
    )


def candidates(
    spec_rows: DataFrame,
    scored: DataFrame,
    scale: DataFrame,
    grid: Grid,
    delta: float,
    variants: bool = False,
    pointwise_delta: float | None = None,
) -> DataFrame:
    """One row per candidate with validation errors in source units and its risk bound.

    ``variants`` adds a zero-mean prior next to the localized one and charges
    ln 2 for the choice; ``pointwise_delta`` adds the bound at a second level.
    """
    usable = spec_rows.filter(~F.col("capped") & F.col("failure").isNull()).select(
        *DESIGN, "family", "radius", "wanted_k", "rule_count"
    )
    rows = usable.join(scored, DESIGN).join(scale, "series_id")
    s, n = F.col("scaler_scale"), F.col("n_val")
    cert_n = F.col("n_cert")
    structure = certify.structure_code(
        F.col("family"), F.col("rule_count"), len(grid.families), len(grid.lags), len(grid.radii),
        len(grid.ridge_alphas), grid.max_rules,
    )
    weight = F.transform("weight", lambda w: w / cert_n)
    entropy = -F.aggregate(
        F.transform(weight, lambda w: F.when(w > 0, w * F.log(w)).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v
    ) / F.log(F.col("rule_count").cast("double"))
    ruled = F.col("k") > 0
    out = rows.withColumns(
        {
            "consequent_dimension": F.col("dimension"),
            "validation_rmse": s * F.sqrt(F.col("sse") / n),
            "validation_mae": s * F.col("sae") / n,
            "validation_rmse_clipped": s * F.sqrt(F.col("cut_sse") / n),
            "validation_mae_clipped": s * F.col("cut_sae") / n,
            "validation_weighted_cost": s * F.col("cut_cost") / n,
            "validation_forecast_clipping_rate": F.col("forecast_clips") / n,
            "clip_bound_scaled": F.col("clip_bound"),
            "clip_lower_original": F.col("scaler_mean") - F.col("clip_bound") * s,
            "clip_upper_original": F.col("scaler_mean") + F.col("clip_bound") * s,
            "certification_target_clipping_rate": F.col("target_clips") / cert_n,
            "certificate_sample_size": cert_n,
            "structure_kl": structure,
            "effective_rule_count": F.when(ruled, F.size(F.filter("hard", lambda h: h > 0))).otherwise(1),
            "minimum_hard_rule_support": F.when(ruled, F.array_min("hard").cast("long")),
            "maximum_hard_rule_support": F.when(ruled, F.array_max("hard").cast("long")),
            "mean_active_rules": F.when(ruled, F.col("active_sum") / cert_n).otherwise(1.0),
            "maximum_active_rules": F.when(ruled, F.col("active_max")).otherwise(1),
            "rule_usage_entropy": F.when(ruled & (F.col("rule_count") > 1), entropy).otherwise(0.0),
        }
    ).withColumn(
        "candidate_id",
        candidate_id(F.col("family"), F.col("lag"), F.col("radius"), F.col("ridge_alpha"), F.col("rule_count")),
    )
    risks = F.transform("risk", lambda r: r / cert_n)
    extra = math.log(2.0) if variants else 0.0

    def bound(location: str, level: float) -> Column:
        return certify.best_certificate(
            risks, cert_n, F.col("dimension"), F.col(location), F.col("structure_kl"), grid.prior_scales,
            grid.posterior_ratios, grid.temperatures, level, extra,
        )

    out = out.withColumn("_c", bound("location_local", delta)).select("*", "_c.*").drop("_c", "grid_index")
    if variants:
        zero = bound("location_zero", delta)
        out = out.withColumn("_z", zero).withColumns(
            {
                "zero_mean_certificate": F.col("_z.certificate"),
                "zero_mean_certificate_untruncated": F.col("_z.certificate_untruncated"),
                "zero_mean_total_kl": F.col("_z.total_kl"),
            }
        ).drop("_z")
    if pointwise_delta is not None:
        # The grid entry chosen at the familywise level is bounded again at the second level.
        mass = 1.0 / len(grid.temperatures)
        second = F.array_min(
            F.transform(
                F.array(*[F.lit(float(t)) for t in grid.temperatures]),
                lambda t: certify.certificate(
                    F.col("empirical_gibbs_risk"), F.col("total_kl"), t, cert_n, float(pointwise_delta), mass
                ),
            )
        )
        out = out.withColumn("certificate_pointwise_untruncated", second).withColumn(
            "certificate_pointwise", F.least(F.lit(1.0), second)
        )
    return out


def seasonal_validation(shifted: DataFrame, count: int) -> DataFrame:
    """Errors of the fallback on validation, whole and per block."""
    y, f = F.col("value_imputed"), F.col("seasonal")
    blk = block_id(F.col("role_step"), F.col("role_size"), count)
    sq, cost = (y - f) * (y - f), m.asymmetric_loss(y, f)
    rows = shifted.filter(F.col("role") == "validation").withColumn("_b", blk)

    def per_block(value: Column) -> Column:
        return F.array(*[F.avg(F.when(F.col("_b") == b, value)) for b in range(count)])

    return rows.groupBy("series_id").agg(
        F.count("*").alias("seasonal_validation_points"),
        m.rmse(y, f).alias("seasonal_validation_rmse"),
        m.mae(y, f).alias("seasonal_validation_mae"),
        m.weighted_cost(y, f).alias("seasonal_validation_weighted_cost"),
        m.normalized_cost(y, f).alias("seasonal_validation_normalized_weighted_cost"),
        per_block(sq).alias("_base_sq"),
        per_block(cost).alias("_base_cost"),
        F.array(*[F.count_if(F.col("_b") == b) for b in range(count)]).alias("_block_n"),
    )


def with_stability(cands: DataFrame, base: DataFrame) -> DataFrame:
    """Gains over the fallback, whole and per validation block."""
    s = F.col("scaler_scale")

    def floored(b: Column, c: Column) -> Column:
        return m.gain(b, c, "floored")

    joined = cands.join(base, "series_id")
    rmse_gain = F.transform(
        F.arrays_zip("_base_sq", "block_sse", "_block_n"),
        lambda t: floored(F.sqrt(t["_base_sq"]), s * F.sqrt(t["block_sse"] / t["_block_n"])),
    )
    cost_gain = F.transform(
        F.arrays_zip("_base_cost", "block_cost", "_block_n"),
        lambda t: floored(t["_base_cost"], s * t["block_cost"] / t["_block_n"]),
    )
    return (
        joined.withColumns({"validation_block_rmse_improvements": rmse_gain, "validation_block_cost_improvements": cost_gain})
        .withColumns(
            {
                "validation_rmse_nonnegative_blocks": F.size(F.filter("validation_block_rmse_improvements", lambda v: v >= 0)),
                "validation_cost_nonnegative_blocks": F.size(F.filter("validation_block_cost_improvements", lambda v: v >= 0)),
                "validation_worst_block_rmse_improvement": F.array_min("validation_block_rmse_improvements"),
                "validation_worst_block_cost_improvement": F.array_min("validation_block_cost_improvements"),
                "validation_rmse_improvement_vs_fallback": floored(
                    F.col("seasonal_validation_rmse"), F.col("validation_rmse_clipped")
                ),
                "validation_cost_improvement_vs_fallback": floored(
                    F.col("seasonal_validation_weighted_cost"), F.col("validation_weighted_cost")
                ),
            }
        )
        .drop("_base_sq", "_base_cost", "_block_n")
    )


MODEL = [
    "lag", "k", "active", "radius", "ridge_alpha", "rule_count", "consequent_dimension", "candidate_id",
    "certificate", "certificate_untruncated", "empirical_gibbs_risk", "total_kl", "gaussian_kl",
    "certification_target_clipping_rate", "clip_bound_scaled", "validation_rmse", "validation_mae",
    "validation_rmse_clipped", "validation_weighted_cost", "coefficients",
]


def decide(cands: DataFrame, base: DataFrame, gate: str, fallback: str) -> DataFrame:
    """One decision per series before the test role is opened.

    ``simple``: best passing candidate by RMSE, then not worse than the
    fallback. ``robust``: eight predicates, then best by operating cost.
    """
    if gate == "simple":
        passing, key, no = cands.filter(simple_gate()), "rmse_then_certificate", "no_certificate_eligible_candidate"
        yes = "certificate_and_validation_gates_passed"
    elif gate == "robust":
        passing, key, no = cands.filter(robust_gate()), "cost", "no_candidate_passed_robust_gate"
        yes = "robust_certificate_validation_gate_passed"
    else:
        raise ValueError(f"Unknown gate {gate}.")
    keep = list(dict.fromkeys(["series_id", "family", *MODEL, *KEYS[key]]))
    if gate == "robust":
        keep += ["validation_rmse_improvement_vs_fallback", "validation_cost_improvement_vs_fallback"]
    row = F.struct(*[F.col(c) for c in keep if c != "series_id"])
    winners = passing.groupBy("series_id").agg(
        F.min_by(row, key_of(KEYS[key])).alias("selected"), F.count("*").alias("eligible_candidate_count")
    )
    fields = [c for c in base.columns if c.startswith("seasonal_")]
    joined = base.select("series_id", *fields).join(winners, "series_id", "left")
    worse = F.lit(False)
    if gate == "simple":
        worse = F.coalesce(F.col("selected.validation_rmse") > F.col("seasonal_validation_rmse"), F.lit(False))
    none = F.col("selected").isNull()
    return (
        joined.withColumn(
            "reason",
            F.when(none, no).when(worse, "eligible_models_failed_seasonal_validation_gate").otherwise(yes),
        )
        .withColumn("selected", F.when(~none & ~worse, F.col("selected")))
        .withColumn("deployment", F.coalesce("selected.family", F.lit(fallback)))
        .withColumn("eligible_candidate_count", F.coalesce("eligible_candidate_count", F.lit(0)))
        .withColumn("decision_made_before_test_opening", F.lit(True))
    )


def family_winners(cands: DataFrame, key: str) -> DataFrame:
    keep = list(dict.fromkeys(["series_id", "family", *MODEL, *KEYS[key]]))
    return best(cands.select(*keep), ["series_id", "family"], key)


def open_role(lagged: DataFrame, models: DataFrame, covers: DataFrame | None, role: str = "test") -> DataFrame:
    """Forecast rows of one role with stored coefficients; nothing is fitted again.

    ``models`` holds one row per (series, label) with lag, k, active,
    coefficients and clip bound; rule geometry comes from ``covers``.
    """
    rows = lagged.filter(F.col("role") == role).select(
        F.col("series_id").cast("string").alias("series_id"), "step", "pos", "features", "value_scaled",
        "value_imputed", "scaler_mean", "scaler_scale",
    )
    keyed = models
    if covers is not None:
        geometry = covers.select("series_id", "lag", "k", *GEOMETRY)
        keyed = models.join(geometry, ["series_id", "lag", "k"], "left")
    joined = rows.join(keyed, "series_id").filter(F.col("step") >= F.col("lag"))
    x = F.slice("features", F.lit(1), F.col("lag"))
    plain = dot(F.concat(F.array(F.lit(1.0)), x), F.col("coefficients"))
    forecast = plain
    if covers is not None:
        z = standardize(x, F.col("feature_mean"), F.col("feature_scale"))
        count, lag = F.col("rule_count"), F.col("lag")
        rules = [as_rules(F.col(c), count, lag) for c in ("centers", "spreads")]
        ruled = rule_forecast(z, *rules, F.col("active"), as_rules(F.col("coefficients"), count, lag + 1))
        forecast = F.when(F.col("k") == 0, plain).otherwise(ruled)
    b = F.col("clip_bound_scaled")
    # ``inline`` fixes the forecast once; a projection would repeat its expression in every column below.
    return (
        joined.select("*", F.inline(F.array(F.struct(forecast.alias("forecast_scaled")))))
        .withColumn("forecast_clipped_scaled", m.clip(F.col("forecast_scaled"), b))
        .withColumns(
            {
                "actual": F.col("value_imputed"),
                "forecast_raw": F.col("forecast_scaled") * F.col("scaler_scale") + F.col("scaler_mean"),
                "forecast": F.col("forecast_clipped_scaled") * F.col("scaler_scale") + F.col("scaler_mean"),
                "target_clipped": (F.abs("value_scaled") > b),
                "forecast_was_clipped": (F.abs("forecast_scaled") > b),
            }
        )
    )


def role_metrics(forecasts: DataFrame, keys: list[str], prefix: str = "test") -> DataFrame:
    y, raw, cut = F.col("actual"), F.col("forecast_raw"), F.col("forecast")
    return forecasts.groupBy(*keys).agg(
        m.rmse(y, raw).alias(f"{prefix}_rmse_raw"), m.mae(y, raw).alias(f"{prefix}_mae_raw"),
        m.rmse(y, cut).alias(f"{prefix}_rmse_clipped"), m.mae(y, cut).alias(f"{prefix}_mae_clipped"),
        m.weighted_cost(y, cut).alias(f"{prefix}_weighted_cost"),
        m.normalized_cost(y, cut).alias(f"{prefix}_normalized_weighted_cost"),
        F.avg(F.col("target_clipped").cast("double")).alias(f"{prefix}_target_clipping_rate"),
        F.avg(F.col("forecast_was_clipped").cast("double")).alias(f"{prefix}_forecast_clipping_rate"),
        F.count("*").alias(f"{prefix}_points"),
    )


def counted_series(rows: DataFrame, stated: int | None) -> int:
    """Number of series in the rows; a stated number that differs is an error."""
    found = rows.select("series_id").distinct().count()
    if stated is not None and stated != found:
        raise ValueError(f"The confidence level is for {stated} series, but there are {found}.")
    return max(1, found)


class Case:
    """The frames of one locked decision run.

    Making one writes the lagged rows, the covers and the specs to the shared
    folder; everything after them is lazy. The confidence left to a series is
    ``delta_total`` over the number of series, which is counted; a stated
    ``series_count`` must agree with it.
    """

    def __init__(self, prepared: DataFrame, grid: Grid, season: int, gate: str, series_count: int | None = None, delta_total: float = 0.05,
                 fallback: str = "seasonal_naive", max_len: int | None = None, chunk: int = CHUNK):
        self.grid = grid
        self.gate = gate
        # Written once, partitioned by role: the decision jobs never list the test files.
        self.lagged = store(
            lag_context(
                with_shift(prepared, season, "value_imputed", "seasonal", max_len=max_len, chunk=chunk),
                max(grid.lags), max_len, chunk,
            ).withColumn("series_id", F.col("series_id").cast("string")),
            "role",
        )
        self.shifted = self.lagged.filter(F.col("seasonal").isNotNull())
        self.specs, self._scored, self.covers = run_sweep(self.lagged, grid, max_len, chunk)
        self.scale = scalers(self.lagged.filter(F.col("role") == "prior"))
        self.base = seasonal_validation(self.shifted, grid.validation_blocks)
        self.delta = delta_total / counted_series(self.lagged, series_count)
        self.fallback = fallback

    @cached_property
    def candidates(self) -> DataFrame:
        """The candidate table feeds several results, so it is stored once, when first asked for."""
        found = candidates(self.specs, self._scored, self.scale, self.grid, self.delta)
        return store(with_stability(found, self.base))

    def decisions(self) -> DataFrame:
        """The barrier: decisions are stored before a test row is read."""
        return cut_lineage(decide(self.candidates, self.base, self.gate, self.fallback))

    def build_report(self) -> DataFrame:
        """Per series: candidates kept, capped candidates skipped, and build failures."""
        alphas = len(self.grid.ridge_alphas)
        return self.specs.groupBy("series_id").agg(
            (F.count_if(~F.col("capped") & F.col("failure").isNull()) * alphas).alias("candidate_count"),
            (F.count_if(F.col("capped")) * alphas).alias("skipped_capped_candidates"),
            F.count_if(F.col("failure").isNotNull()).alias("build_failures"),
        )

    def family_results(self) -> DataFrame:
        key = "cost" if self.gate == "robust" else "rmse_then_certificate"
        winners = family_winners(self.candidates, key)
        opened = open_role(self.lagged, winners, self.covers)
        scored = role_metrics(opened, ["series_id", "family"])
        report = [c for c in winners.columns if c != "coefficients"]
        return winners.select(*report).join(scored, ["series_id", "family"]).join(self.scale, "series_id").withColumn(
            "certificate_rms_allowance_original",
            m.rms_allowance(F.col("certificate"), F.col("clip_bound_scaled"), F.col("scaler_scale")),
        )

    def outcomes(self, decisions: DataFrame) -> DataFrame:
        """Decisions joined with the test results of the fallback and of what was deployed."""
        variant = "floored" if self.gate == "robust" else "plain"
        rows = self.predictions(decisions)
        y, f, d = F.col("actual"), F.col("seasonal"), F.col("deployed_forecast")
        scored = rows.groupBy("series_id").agg(
            m.rmse(y, f).alias("test_baseline_rmse"), m.mae(y, f).alias("test_baseline_mae"),
            m.weighted_cost(y, f).alias("test_baseline_weighted_cost"),
            m.normalized_cost(y, f).alias("test_baseline_normalized_weighted_cost"),
            m.rmse(y, d).alias("test_deployed_rmse"), m.mae(y, d).alias("test_deployed_mae"),
            m.weighted_cost(y, d).alias("test_deployed_weighted_cost"),
            m.normalized_cost(y, d).alias("test_deployed_normalized_weighted_cost"),
        )
        return decisions.join(scored, "series_id").withColumns(
            {
                "test_rmse_improvement_vs_fallback": m.gain(
                    F.col("test_baseline_rmse"), F.col("test_deployed_rmse"), variant
                ),
                "test_cost_improvement_vs_fallback": m.gain(
                    F.col("test_baseline_weighted_cost"), F.col("test_deployed_weighted_cost"), variant
                ),
                "test_opened_after_decision": F.lit(True),
            }
        )

    def predictions(self, decisions: DataFrame) -> DataFrame:
        """Test rows with actual, fallback and deployed forecast, aligned on (series, step)."""
        chosen = decisions.filter(F.col("selected").isNotNull()).select("series_id", "selected.*")
        opened = open_role(self.lagged, chosen, self.covers).select("series_id", "step", F.col("forecast").alias("_model"))
        base = self.shifted.filter(F.col("role") == "test").select(
            "series_id", "step", "pos", F.col("value_imputed").alias("actual"), "seasonal"
        )
        return base.join(opened, ["series_id", "step"], "left").withColumn(
            "deployed_forecast", F.coalesce("_model", "seasonal")
        ).drop("_model")
