"""Registered queries: linear models, bounds, gates and decisions, paired inference."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from tidefold.checks import sql
from tidefold.checks.comparison import _P as POOL
from tidefold.checks.comparison import rounded
from tidefold.checks.pools import picked, picked_sql, pool
from tidefold.functions import metrics as m
from tidefold.functions.arrays import dot
from tidefold.functions.text import digest_head
from tidefold.operators import certify, compare, infer, lags
from tidefold.operators.ordered import with_medians
from tidefold.operators.linear import fit_linear, gram_rows, merge_grams, predict, score, with_chunk
from tidefold.operators.sweep import Grid, block_id
from tidefold.plans import decide, prepare
from tidefold.session import store
from tidefold.sources import panels

SLOTS = panels.EVENT_HOURS.slots
SEASON = 24
ALPHAS = (0.01, 0.1, 1.0)
AR1 = Grid(families=("ridge",), lags=(1,), ridge_alphas=ALPHAS)
DELTA = 0.05
REPLICATES = 20_000


def _evt(spark, folder):
    return prepare.by_ratio_panel(panels.evt_hour(spark, folder), SEASON, max_len=SLOTS)


def _rows(spark, folder, order):
    rows = lags.with_lags(_evt(spark, folder), order, max_len=SLOTS)
    return with_chunk(rows.withColumn("y", F.col("value_scaled")), SLOTS)


def _fits(spark, folder, order, model, alphas=ALPHAS):
    rows = _rows(spark, folder, order)
    return rows, fit_linear(merge_grams(gram_rows(rows, [order]), ["series_id", "lag", "role"], 0), model, alphas)


def ridge_ar1(spark, folder):
    _r, models = _fits(spark, folder, 1, "penalised_ridge")
    c, d = F.col("coefficients"), F.col("inverse_diag")
    return models.select(
        "series_id", "ridge_alpha", "n", F.round(c[0], 6).alias("b0"), F.round(c[1], 6).alias("b1"),
        F.round(d[0], 9).alias("inv0"), F.round(d[1], 9).alias("inv1"), F.round("rss", 6).alias("rss"),
    )


def ridge_ar2_path(spark, folder):
    _r, models = _fits(spark, folder, 2, "penalised_ridge")
    c = F.col("coefficients")
    return models.select("series_id", "ridge_alpha", *[F.round(c[i], 6).alias(f"b{i}") for i in range(3)])


def free_intercept_models(spark, folder):
    """Least squares, ridge and lasso on one lag, with an unpenalised intercept."""
    rows = _rows(spark, folder, 1)
    grams = store(merge_grams(gram_rows(rows, [1]), ["series_id", "lag", "role"], 2))
    c = F.col("coefficients")
    out = None
    for model, alphas in (("ols", (0.0,)), ("ridge", (0.1, 10.0)), ("lasso", (0.01, 0.1))):
        part = fit_linear(grams, model, alphas).select(
            "series_id", "model", "ridge_alpha", F.round(c[0], 6).alias("intercept"), F.round(c[1], 6).alias("slope")
        )
        out = part if out is None else out.unionByName(part)
    return out


def linear_scores(spark, folder):
    """Stored coefficients scored on later roles by a key join."""
    rows, models = _fits(spark, folder, 1, "penalised_ridge")
    scored = score(rows.filter(F.col("role").isin("validation", "test")), models)
    y, f = F.col("y"), F.col("forecast")
    return scored.groupBy("series_id", "ridge_alpha", "role").agg(
        F.count("*").alias("rows"), F.round(m.rmse(y, f), 6).alias("rmse"), F.round(m.mae(y, f), 6).alias("mae")
    )


def block_stability(spark, folder):
    """Gains of persistence over the seasonal forecast in four validation blocks."""
    rows = lags.with_shift(_evt(spark, folder), SEASON, "value_imputed", "base", max_len=SLOTS)
    rows = lags.with_shift(rows, 1, "value_imputed", "new", max_len=SLOTS).filter(F.col("role") == "validation")
    y, b, c = F.col("value_imputed"), F.col("base"), F.col("new")
    per = rows.withColumn("block", block_id(F.col("role_step"), F.col("role_size"), 4)).groupBy("series_id", "block").agg(
        F.count("*").alias("rows"),
        m.gain(m.rmse(y, b), m.rmse(y, c), "floored").alias("rmse_gain"),
        m.gain(m.weighted_cost(y, b), m.weighted_cost(y, c), "floored").alias("cost_gain"),
    )
    return per.groupBy("series_id").agg(
        F.min("rows").alias("smallest_block"), F.max("rows").alias("largest_block"),
        F.count_if(F.col("rmse_gain") >= 0).alias("rmse_nonnegative_blocks"),
        F.count_if(F.col("cost_gain") >= 0).alias("cost_nonnegative_blocks"),
        F.round(F.min("rmse_gain"), 6).alias("worst_rmse_gain"), F.round(F.min("cost_gain"), 6).alias("worst_cost_gain"),
    )


def _case(spark, folder, gate):
    return decide.Case(_evt(spark, folder), AR1, SEASON, gate, None, DELTA, max_len=SLOTS)


def certificate_grid(spark, folder):
    got = _case(spark, folder, "simple").candidates
    return rounded(
        got.select(
            "series_id", "candidate_id", "validation_rmse", "validation_mae", "clip_bound_scaled", "certification_target_clipping_rate",
            "certificate_sample_size", "structure_kl", "prior_scale", "posterior_ratio", "temperature", "empirical_gibbs_risk",
            "gaussian_kl", "total_kl", "certificate_untruncated", "certificate",
        ),
        validation_rmse=6, validation_mae=6, clip_bound_scaled=6, certification_target_clipping_rate=6, structure_kl=6,
        empirical_gibbs_risk=6, gaussian_kl=5, total_kl=5, certificate_untruncated=6, certificate=6,
    )


def _decision(spark, folder, gate):
    case = _case(spark, folder, gate)
    out = case.outcomes(case.decisions()).select(
        "series_id", "deployment", "reason", "eligible_candidate_count", F.col("selected.candidate_id").alias("selected_candidate_id"),
        "seasonal_validation_rmse", "test_baseline_rmse", "test_deployed_rmse", "test_baseline_weighted_cost", "test_deployed_weighted_cost",
        "test_rmse_improvement_vs_fallback", "test_cost_improvement_vs_fallback",
    )
    return rounded(out, **{c: 8 if c.endswith("cost") else 6 for c, t in out.dtypes if t == "double"})


def simple_gate(spark, folder):
    return _decision(spark, folder, "simple")


def robust_gate(spark, folder):
    return _decision(spark, folder, "robust")


def structure_codes(spark, folder):
    """Code lengths of the pool's structures under the grid law and under the table law."""
    p = pool(spark, folder)
    codes = certify.table_code(p, ["dataset", "series_id"], 0.5, 0.05, 0.1)
    fixed = certify.fixed_grid_code(F.col("rule_count"), 3, 4, 3, 12)
    out = codes.withColumn("fixed_grid_code", fixed).groupBy("dataset", "lag_order", "rule_count").agg(
        F.max("structures").alias("structures"), F.avg("structure_kl").alias("table_code"), F.avg("fixed_grid_code").alias("fixed_grid_code"),
    )
    return rounded(out, table_code=6, fixed_grid_code=6)


def matched_structure(spark, folder):
    p = store(pool(spark, folder))
    codes = certify.table_code(p, ["dataset", "series_id"], 0.5, 0.05, 0.1)
    chosen = picked(p, caps=(4,), modes=("uncapped_only",))
    got = certify.match_structure(chosen, codes, ["dataset", "series_id"])
    return rounded(got.select("dataset", "series_id", "selected_lag", "structure_kl"), structure_kl=6)


def _cert_sample(spark, folder):
    """Certification rows of the one-lag ridge with penalty 1 of every series."""
    rows, models = _fits(spark, folder, 1, "penalised_ridge", (1.0,))
    x = F.concat(F.array(F.lit(1.0)), F.slice("features", 1, 1))
    bound = rows.filter(F.col("role") == "prior").groupBy("series_id").agg(
        m.clip_bound(F.max(F.abs("y")), 1.25).alias("clip_bound")
    )
    sizes = rows.filter(F.col("role").isin("bound", "validation")).groupBy("series_id").agg(
        F.count("*").alias("n"), F.min("step").alias("_first")
    )
    return (
        rows.filter(F.col("role").isin("bound", "validation"))
        .join(sizes, "series_id").join(bound, "series_id").join(models.select("series_id", "lag", "coefficients"), "series_id")
        .select(
            "series_id", (F.col("step") - F.col("_first")).alias("at"), "n", "y",
            predict(F.col("features"), F.col("lag"), F.col("coefficients")).alias("center"),
            dot(x, x).alias("square_size"), F.lit(2).alias("dimension"), dot(F.col("coefficients"), F.col("coefficients")).alias("q_square"),
            "clip_bound", F.lit(math.log(3.0)).alias("structure_kl"),
        )
    )


def mixing_profile(spark, folder):
    got = certify.mixing_profile(
        _cert_sample(spark, folder), (1, 4, 12, 300), (0.5, 2.0), (0.1, 1.0), (0.25, 1.0), DELTA, 1.5
    )
    return rounded(
        got.select(
            "series_id", "block_length", "status", "effective_sample_size", "used_observations", "assumed_beta_upper", "mixing_residual",
            "effective_delta", "prior_scale", "posterior_ratio", "temperature", "block_risk", "total_kl", "certificate",
        ),
        assumed_beta_upper=9, mixing_residual=6, effective_delta=6, block_risk=6, total_kl=6, certificate=6,
    )


def odd_blocks(spark, folder):
    rows = _cert_sample(spark, folder).withColumn(
        "loss", certify.pointwise_loss(F.col("y"), F.col("center"), F.lit(0.0), F.col("clip_bound"))
    )
    got = certify.odd_block_risk(rows, ["series_id"], (1, 5, 24))
    return rounded(got, block_risk=9)


def recomputed_bounds(spark, folder):
    """Stored bounds, one of them altered, against bounds worked out again from their parts."""
    case = _case(spark, folder, "simple")
    altered = (F.col("series_id") == "error") & (F.col("ridge_alpha") == max(AR1.ridge_alphas))
    got = case.candidates.withColumn("certificate_untruncated", F.col("certificate_untruncated") + F.when(altered, 1e-6).otherwise(0.0))
    again = certify.certificate(
        F.col("empirical_gibbs_risk"), F.col("total_kl"), F.col("temperature"), F.col("certificate_sample_size"), case.delta,
        1.0 / len(AR1.temperatures),
    )
    return got.groupBy("series_id").agg(
        F.count("*").alias("bounds"), (certify.recompute_gap("certificate_untruncated", again) <= 1e-10).alias("agrees"),
        F.round(F.max(again), 6).alias("largest_bound"),
    )


def _differences(spark, folder, exact=False):
    """Differences of the errors to four places; ``exact`` ones, for ranks, are rounded on whole numbers (the errors have at most six places)."""
    p = store(pool(spark, folder))
    wide = picked(p, caps=(4,), modes=("uncapped_only",))
    narrow = picked(p, caps=(2,), modes=("uncapped_only",))
    small = picked(p, caps=(4,), modes=("uncapped_only",), max_radius=1.0)
    parts = None
    for name, other in (("caps", narrow), ("radii", small)):
        part = compare.paired(wide, other, compare.SERIES, ["rmse", "mase"]).withColumn("comparison", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    places = m.exact_round(F.col("difference"), 4) if exact else F.round("difference", 4)
    return parts.withColumn("difference", places).withColumn(
        "pair", F.concat_ws("|", "dataset", "series_id")
    )


def paired_counts(spark, folder):
    d = F.col("difference")
    rows = store(_differences(spark, folder))
    keys = ["comparison", "metric"]
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("pair_count"), F.round(F.avg("difference"), 6).alias("mean_difference"), F.count_if(d < 0).alias("left_lower"),
        F.count_if(d > 0).alias("left_higher"), F.count_if(F.abs(d) <= 1e-8).alias("ties"),
    )
    return rounded(with_medians(out, rows, keys, {"median_difference": d}), median_difference=6)


def signed_ranks(spark, folder):
    out = infer.signed_ranks(store(_differences(spark, folder, exact=True)), ["comparison", "metric"])
    return rounded(out, z_score=6)


def rank_biserial(spark, folder):
    return rounded(infer.rank_biserial(store(_differences(spark, folder)), ["comparison", "metric"]), rank_biserial=9)


def holm(spark, folder):
    """Step-down over made p-values of the comparison table: shares of worse series per model pair."""
    d = _differences(spark, folder).groupBy("comparison", "metric", "dataset").agg(
        F.round((F.count_if(F.col("difference") > 0) + 1) / (F.count("*") + 1), 9).alias("p_value")
    )
    return rounded(infer.holm(d, ["comparison"]), p_holm=9)


def bootstrap_mean(spark, folder):
    out = infer.bootstrap_mean(store(_differences(spark, folder)), ["comparison", "metric"], "difference", "pair", REPLICATES, 7)
    return rounded(out, mean=6, ci_low=6, ci_high=6)


def paired_statistics(spark, folder):
    """The full paired table: mean, median, interval, counts, signed-rank p, Holm p and effect."""
    out = infer.paired_statistics(store(_differences(spark, folder)), ["comparison", "metric"], "pair", REPLICATES, ["comparison"], seed=7)
    return rounded(out, mean=6, median_difference=6, ci_low=6, ci_high=6, p_value=9, p_holm=9, rank_biserial=9)


def signed_rank_p(spark, folder):
    """Rank sums and p-values of comparisons of few series, where the exact distribution is used, and of many."""
    rows = store(_differences(spark, folder, exact=True))
    # Series of one last digit: groups of at most some tens of pairs; without ties they are exact.
    few = rows.withColumn("part", F.concat_ws("|", "dataset", F.right("series_id", F.lit(1)))).withColumn(
        "difference", F.col("difference") + digest_head(F.col("pair")) / 1e14
    )
    out = infer.wilcoxon(few, ["comparison", "metric", "part"]).unionByName(
        infer.wilcoxon(rows.withColumn("part", F.lit("all")), ["comparison", "metric", "part"], zeros="wilcox")
    )
    return rounded(out, z_score=6, p_value=9)


def block_bootstrap(spark, folder):
    rows = lags.with_shift(_evt(spark, folder), SEASON, "value_imputed", "base", max_len=SLOTS)
    rows = lags.with_shift(rows, 1, "value_imputed", "deployed", max_len=SLOTS).filter(F.col("role") == "test")
    pairs = rows.select(
        "series_id", F.col("role_step").alias("at"), F.col("role_size").alias("n"), F.col("value_imputed").alias("actual"), "base", "deployed"
    )
    out = infer.block_bootstrap(pairs, (7, 24), REPLICATES, primary=24, seed=3, max_len=SLOTS, round_gain=9)
    return rounded(out, **{c: 6 for c, t in out.dtypes if t == "double"})


# --- SQL --------------------------------------------------------------------------------

_EVT = "WITH RECURSIVE " + sql.prepared(sql.EVT_HOUR, "evt_hour", SEASON)
_LAG = _EVT + """,
x AS (SELECT *, value_scaled AS y FROM (SELECT *, lag(value_scaled, 1) OVER w AS x1, lag(value_scaled, 2) OVER w AS x2, lag(value_imputed, 24) OVER w AS seas,
  lag(value_imputed, 1) OVER w AS last1 FROM p WINDOW w AS (PARTITION BY series_id ORDER BY step)))"""
_A = "(SELECT unnest([0.01::DOUBLE, 0.1::DOUBLE, 1.0::DOUBLE]) AS a)"
_SUMS = """
{n} AS (SELECT series_id, count(*) AS n, sum(x1) AS sx, sum(x1 * x1) AS sxx, sum(y) AS sy, sum(x1 * y) AS sxy, sum(y * y) AS syy, max(abs(y)) AS top
  FROM x WHERE step >= 1 AND role = '{r}' GROUP BY 1),
{n}_c AS (SELECT *, (n + a) * (sxx + a) - sx * sx AS det FROM {n}, """ + _A + """),
{n}_b AS (SELECT *, ((sxx + a) * sy - sx * sxy) / det AS b0, ((n + a) * sxy - sx * sy) / det AS b1, (sxx + a) / det AS inv0, (n + a) / det AS inv1 FROM {n}_c),
{n}_f AS (SELECT *, syy - 2 * (b0 * sy + b1 * sxy) + b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx AS rss FROM {n}_b)"""
_FIT = _LAG + "," + _SUMS.format(n="bd", r="bound") + "," + _SUMS.format(n="pr1", r="prior")
_CERT = _FIT + """,
mdl AS (SELECT b.series_id, b.a, b.b0 AS q0, b.b1 AS q1, sqrt(least(greatest(greatest(1e-4, p.rss / p.n) * p.inv0, 1e-6), 100.0)) AS s0,
  sqrt(least(greatest(greatest(1e-4, p.rss / p.n) * p.inv1, 1e-6), 100.0)) AS s1, p.b0 AS p0, p.b1 AS p1, greatest(1.0::DOUBLE, 1.25::DOUBLE * p.top) AS bb
  FROM bd_f b JOIN pr1_f p ON b.series_id = p.series_id AND b.a = p.a),
cm AS (SELECT *, ((q0 - p0) / s0) ** 2 + ((q1 - p1) / s1) ** 2 AS loc FROM mdl),
cr AS (SELECT c.series_id, c.a, c.loc, c.bb, (least(greatest(y, -bb), bb) - q0 - q1 * x1) ** 2 AS bias, s0 * s0 + x1 * x1 * s1 * s1 AS var, CAST(abs(y) > bb AS INT) AS clipped
  FROM x JOIN cm c ON c.series_id = x.series_id WHERE step >= 1 AND role IN ('bound', 'validation')),
gr AS (SELECT i, [0.5, 1, 2, 4, 8][i // 5 + 1]::DOUBLE AS sc, [0.01, 0.03, 0.1, 0.3, 1.0][i % 5 + 1]::DOUBLE AS ra FROM (SELECT unnest(range(25)) AS i)),
rk AS (SELECT series_id, a, i, sc, ra, min(loc) AS loc, min(bb) AS bb, count(*) AS n, avg(clipped::DOUBLE) AS clip, avg(least(1.0, (bias + (sc * ra) ** 2 * var) / (4 * bb * bb))) AS risk
  FROM cr, gr GROUP BY ALL),
kk AS (SELECT *, greatest(0, 0.5 * (2 * (ln(1 / (ra * ra)) - 1 + ra * ra) + loc / (sc * sc))) AS kl FROM rk),
tt AS (SELECT *, ln(3::DOUBLE) + ln(5::DOUBLE) + kl AS total, t, risk + t / 8 + (ln(3::DOUBLE) + ln(5::DOUBLE) + kl + ln(6 * (SELECT count(DISTINCT series_id) FROM x) / 0.05::DOUBLE)) / (t * n) AS value
  FROM kk, (SELECT unnest([0.125, 0.25, 0.5, 1, 2, 4]::DOUBLE[]) AS t)),
bst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, a ORDER BY value, i, t) AS rn FROM tt) WHERE rn = 1),
vl AS (SELECT x.series_id, c.a, sqrt(avg((y - q0 - q1 * x1) ** 2)) * min(scaler_scale) AS rmse, avg(abs(y - q0 - q1 * x1)) * min(scaler_scale) AS mae,
  sqrt(avg((y - least(greatest(q0 + q1 * x1, -bb), bb)) ** 2)) * min(scaler_scale) AS crmse,
  avg(2 * greatest(y - least(greatest(q0 + q1 * x1, -bb), bb), 0) + greatest(least(greatest(q0 + q1 * x1, -bb), bb) - y, 0)) * min(scaler_scale) AS ccost
  FROM x JOIN cm c ON c.series_id = x.series_id WHERE role = 'validation' GROUP BY ALL),
cand AS (SELECT b.*, v.rmse, v.mae, v.crmse, v.ccost, 'ridge|p=1|r=none|a=' || printf('%.8g', b.a) || '|k=1' AS candidate_id
  FROM bst b JOIN vl v ON b.series_id = v.series_id AND b.a = v.a)"""
_BASE = _CERT + """,
sv AS (SELECT series_id, sqrt(avg((value_imputed - seas) ** 2)) AS srmse, avg(2 * greatest(value_imputed - seas, 0) + greatest(seas - value_imputed, 0)) AS scost
  FROM x WHERE role = 'validation' AND seas IS NOT NULL GROUP BY 1),
tst AS (SELECT x.series_id, c.a, value_imputed AS y, seas, least(greatest(q0 + q1 * x1, -bb), bb) * scaler_scale + scaler_mean AS f
  FROM x JOIN cm c ON c.series_id = x.series_id WHERE role = 'test' AND seas IS NOT NULL)"""
_GATE_TAIL = """,
dep AS (SELECT s.series_id, s.srmse, d.candidate_id, d.a, coalesce(e.k, 0) AS k, {reason} AS reason FROM sv s LEFT JOIN sel d ON d.series_id = s.series_id
  LEFT JOIN (SELECT series_id, count(*) AS k FROM elig GROUP BY 1) e ON e.series_id = s.series_id),
dd AS (SELECT *, CASE WHEN reason = '{yes}' THEN a END AS use_a FROM dep),
ev AS (SELECT t.series_id, t.y, t.seas, CASE WHEN d.use_a IS NULL THEN t.seas ELSE t.f END AS f FROM tst t JOIN dd d ON d.series_id = t.series_id AND t.a = coalesce(d.use_a, 1.0)),
ms AS (SELECT series_id, sqrt(avg((y - seas) ** 2)) AS br, sqrt(avg((y - f) ** 2)) AS dr, avg(2 * greatest(y - seas, 0) + greatest(seas - y, 0)) AS bc,
  avg(2 * greatest(y - f, 0) + greatest(f - y, 0)) AS dc FROM ev GROUP BY 1)
SELECT d.series_id, CASE WHEN use_a IS NULL THEN 'seasonal_naive' ELSE 'ridge' END AS deployment, reason, k AS eligible_candidate_count,
 CASE WHEN use_a IS NOT NULL THEN candidate_id END AS selected_candidate_id, round(srmse, 6) AS seasonal_validation_rmse, round(br, 6) AS test_baseline_rmse, round(dr, 6) AS test_deployed_rmse,
 round(bc, 8) AS test_baseline_weighted_cost, round(dc, 8) AS test_deployed_weighted_cost, round((br - dr) / br, 6) AS test_rmse_improvement_vs_fallback, round((bc - dc) / bc, 6) AS test_cost_improvement_vs_fallback
FROM dd d JOIN ms ON ms.series_id = d.series_id"""
_BLOCKS = """(CASE WHEN role_step < (role_size % 4) * (role_size // 4 + 1) THEN role_step // (role_size // 4 + 1)
  ELSE role_size % 4 + (role_step - (role_size % 4) * (role_size // 4 + 1)) // (role_size // 4) END)"""
_TABLE_CODE = POOL + """,
sc AS (SELECT DISTINCT dataset, series_id, lag_order, radius, ridge_alpha, rule_count, -(0.5::DOUBLE * rule_count + 0.05::DOUBLE * rule_count * (lag_order + 1) + 0.1::DOUBLE * lag_order) AS score FROM pool),
nm AS (SELECT dataset, series_id, ln(sum(exp(score))) AS lz, count(*) AS structures FROM sc GROUP BY 1, 2)"""
_SAMPLE = _FIT + """,
smp AS (SELECT x.series_id, step - min(step) OVER (PARTITION BY x.series_id) AS place, count(*) OVER (PARTITION BY x.series_id) AS n, y, b.b0 + b.b1 * x1 AS center, 1 + x1 * x1 AS sq,
  b.b0 ** 2 + b.b1 ** 2 AS q2, greatest(1.0::DOUBLE, 1.25::DOUBLE * p.top) AS bb
  FROM x JOIN bd_f b ON b.series_id = x.series_id AND b.a = 1.0 JOIN pr1 p ON p.series_id = x.series_id WHERE step >= 1 AND role IN ('bound', 'validation'))"""
_DIFF = POOL + "," + picked_sql("w", (4,), ("uncapped_only",)) + "," + picked_sql("nr", (2,), ("uncapped_only",)) + "," + picked_sql("sm", (4,), ("uncapped_only",), 1.0) + """,
df AS (SELECT 'caps' AS comparison, 'rmse' AS metric, w.dataset, w.series_id, round(w.rmse - o.rmse, 4) AS d FROM w JOIN nr o ON w.dataset = o.dataset AND w.series_id = o.series_id
 UNION ALL SELECT 'caps', 'mase', w.dataset, w.series_id, round(w.mase - o.mase, 4) FROM w JOIN nr o ON w.dataset = o.dataset AND w.series_id = o.series_id
 UNION ALL SELECT 'radii', 'rmse', w.dataset, w.series_id, round(w.rmse - o.rmse, 4) FROM w JOIN sm o ON w.dataset = o.dataset AND w.series_id = o.series_id
 UNION ALL SELECT 'radii', 'mase', w.dataset, w.series_id, round(w.mase - o.mase, 4) FROM w JOIN sm o ON w.dataset = o.dataset AND w.series_id = o.series_id)"""
# Errors have at most six places, so one difference in a hundred ends in a half of the fourth: rounded on whole numbers, noise does not decide it.
_UNITS = r"CAST(round((w.\1 - o.\1) * 1000000) AS BIGINT)"
_EXACT = re.sub(r"round\(w\.(\w+) - o\.\1, 4\)", f"sign({_UNITS}) * ((abs({_UNITS}) + 50) // 100) / 10000.0::DOUBLE", _DIFF)
_RANKS = """,
ra AS (SELECT *, rank() OVER (PARTITION BY comparison, metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY comparison, metric, abs(d)) - 1) / 2.0::DOUBLE AS rk,
  count(*) OVER (PARTITION BY comparison, metric, abs(d)) AS ties FROM df {where})"""


_MEANS = _DIFF + """,
nb AS (SELECT comparison, metric, d, row_number() OVER (PARTITION BY comparison, metric ORDER BY md5(dataset || '|' || series_id), dataset || '|' || series_id) - 1 AS place, count(*) OVER (PARTITION BY comparison, metric) AS n FROM df),
gr AS (SELECT DISTINCT comparison, metric, n, """ + sql.digest_head("'7|' || comparison || '|' || metric") + f""" AS key, rep FROM nb, (SELECT unnest(range({REPLICATES})) AS rep)),""" + sql.mixed(
    "gr", "xor(key, rep)", "gm", "h") + """,
gp AS (SELECT g.comparison, g.metric, g.rep, g.n, g.h, b.place FROM gm g JOIN nb b ON b.comparison = g.comparison AND b.metric = g.metric),""" + sql.mixed("gp", "xor(h, place)", "dr", "pick") + """,
mn AS (SELECT r.comparison, r.metric, rep, avg(d) AS v FROM dr r JOIN nb b ON b.comparison = r.comparison AND b.metric = r.metric AND b.place = r.pick % r.n GROUP BY ALL),
ci AS (SELECT comparison, metric, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM mn GROUP BY 1, 2),
st AS (SELECT comparison, metric, count(*) AS n, avg(d) AS mean, min(d) AS a, max(d) AS b FROM df GROUP BY 1, 2)"""
_INTERVAL = """round(mean, 6) AS mean, round(CASE WHEN b - a <= 1e-8 + 1e-5 * abs(a) THEN a ELSE lo END, 6) AS ci_low, round(CASE WHEN b - a <= 1e-8 + 1e-5 * abs(a) THEN a ELSE hi END, 6) AS ci_high"""


def _p_sql(rows: str, name: str, keys: str, zeros: str) -> str:
    """Rank sums and p-values of ``rows(keys, d)``: exact counts by recursion over ranks, the normal tail by Simpson's rule."""
    where = "" if zeros == "pratt" else "WHERE d <> 0"
    on = " AND ".join(f"w.{k} = s.{k}" for k in keys.split(", "))
    zero_mean, zero_var = ("- z * (z + 1) / 4.0::DOUBLE", "- z * (z + 1) * (2 * z + 1)") if zeros == "pratt" else ("", "")
    return f"""
{name}_r AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {keys}, abs(d)) - 1) / 2.0::DOUBLE AS rk,
  count(*) OVER (PARTITION BY {keys}, abs(d)) AS ties FROM {rows} {where}),
{name}_s AS (SELECT {keys}, count(*) AS n, count(*) FILTER (d = 0) AS z, coalesce(sum(rk) FILTER (d > 0), 0) AS up, coalesce(sum(rk) FILTER (d < 0), 0) AS down,
  CAST(coalesce(sum(ties * ties - 1) FILTER (d <> 0), 0) AS BIGINT) AS tt FROM {name}_r GROUP BY {keys}),
{name}_z AS (SELECT *, n <= 50 AND z = 0 AND tt = 0 AS exact, sqrt((n * (n + 1) * (2 * n + 1) {zero_var} - tt / 2.0::DOUBLE) / 24.0::DOUBLE) AS sd, n * (n + 1) / 4.0::DOUBLE {zero_mean} AS mean FROM {name}_s),
{name}_v AS (SELECT *, CASE WHEN sd > 0 THEN (least(up, down) - mean) / sd ELSE 0 END AS zs FROM {name}_z),
{name}_w AS (SELECT {keys}, sum(ways) AS ways, any_value(n) AS n FROM (SELECT s.*, c.ways FROM {name}_v s JOIN sign_ways c ON c.k = s.n AND c.total <= round(least(up, down)) WHERE exact) GROUP BY {keys}),
{name}_f AS (SELECT {keys}, max(abs(d)) <= 1e-8 AS flat FROM {rows} GROUP BY {keys}),
{name} AS (SELECT s.*, CASE WHEN s.flat OR s.n IS NULL OR s.n = z THEN 1.0::DOUBLE WHEN exact THEN least(1.0::DOUBLE, 2.0::DOUBLE * w.ways / 2.0::DOUBLE ** s.n)
  ELSE least(1.0::DOUBLE, 2 / sqrt(2 * pi()) * list_sum(list_transform(range(4001), lambda k: (CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * (abs(zs) + k * 0.003) ** 2))) * 0.001) END AS p
  FROM (SELECT f.*, v.* EXCLUDE ({keys}) FROM {name}_f f LEFT JOIN {name}_v v ON {on.replace("w.", "f.").replace("s.", "v.")}) s LEFT JOIN {name}_w w ON {on})"""


_WAYS = """
sign_steps(k, total, ways) AS (SELECT 0::BIGINT, 0::BIGINT, 1.0::DOUBLE UNION ALL
  SELECT k + 1, t, sum(w) FROM (SELECT k, total AS t, ways AS w FROM sign_steps UNION ALL SELECT k, total + k + 1, ways FROM sign_steps) WHERE k < 50 GROUP BY 1, 2),
sign_ways AS (SELECT * FROM sign_steps)"""


CHECKS = {
    "ridge_ar1": (ridge_ar1, _FIT + """
SELECT series_id, a AS ridge_alpha, n, round(b0, 6) AS b0, round(b1, 6) AS b1, round(inv0, 9) AS inv0, round(inv1, 9) AS inv1, round(rss, 6) AS rss FROM bd_f"""),
    "ridge_ar2_path": (ridge_ar2_path, _LAG + """,
s AS (SELECT series_id, count(*) AS n, sum(x1) AS u, sum(x2) AS v, sum(x1 * x1) AS uu, sum(x2 * x2) AS vv, sum(x1 * x2) AS uv, sum(y) AS sy, sum(x1 * y) AS uy, sum(x2 * y) AS vy
  FROM x WHERE step >= 2 AND role = 'bound' GROUP BY 1),
g AS (SELECT series_id, a, n + a AS p, u, v, uu + a AS q, vv + a AS r, uv, sy, uy, vy FROM s, """ + _A + """),
d AS (SELECT *, p * (q * r - uv * uv) - u * (u * r - uv * v) + v * (u * uv - q * v) AS det FROM g)
SELECT series_id, a AS ridge_alpha,
 round((sy * (q * r - uv * uv) - u * (uy * r - uv * vy) + v * (uy * uv - q * vy)) / det, 6) AS b0,
 round((p * (uy * r - uv * vy) - sy * (u * r - uv * v) + v * (u * vy - uy * v)) / det, 6) AS b1,
 round((p * (q * vy - uy * uv) - u * (u * vy - uy * v) + sy * (u * uv - q * v)) / det, 6) AS b2 FROM d"""),
    "free_intercept_models": (free_intercept_models, _LAG + """,
s AS (SELECT series_id, count(*) AS n, avg(x1) AS mx, avg(y) AS my, sum(x1 * x1) - count(*) * avg(x1) ** 2 AS g, sum(x1 * y) - count(*) * avg(x1) * avg(y) AS r FROM x WHERE step >= 1 AND role = 'bound' GROUP BY 1),
f AS (SELECT *, 'ols' AS model, 0.0::DOUBLE AS ridge_alpha, r / g AS slope FROM s
 UNION ALL SELECT *, 'ridge', a, r / (g + a) FROM s, (SELECT unnest([0.1::DOUBLE, 10.0::DOUBLE]) AS a)
 UNION ALL SELECT *, 'lasso', a, sign(r) * greatest(abs(r) - n * a, 0) / g FROM s, (SELECT unnest([0.01::DOUBLE, 0.1::DOUBLE]) AS a))
SELECT series_id, model, ridge_alpha, round(my - mx * slope, 6) AS intercept, round(slope, 6) AS slope FROM f""".replace(
        "SELECT *, 'ridge', a, r / (g + a) FROM s,", "SELECT s.*, 'ridge', a, r / (g + a) FROM s,").replace("SELECT *, 'lasso', a,", "SELECT s.*, 'lasso', a,")),
    "linear_scores": (linear_scores, _FIT + """
SELECT x.series_id, a AS ridge_alpha, role, count(*) AS rows, round(sqrt(avg((y - b0 - b1 * x1) ** 2)), 6) AS rmse, round(avg(abs(y - b0 - b1 * x1)), 6) AS mae
FROM x JOIN bd_f b ON b.series_id = x.series_id WHERE role IN ('validation', 'test') GROUP BY ALL"""),
    "block_stability": (block_stability, _LAG + """,
b AS (SELECT series_id, """ + _BLOCKS + """ AS block, count(*) AS rows, sqrt(avg((value_imputed - seas) ** 2)) AS br, sqrt(avg((value_imputed - last1) ** 2)) AS cr,
 avg(2 * greatest(value_imputed - seas, 0) + greatest(seas - value_imputed, 0)) AS bc, avg(2 * greatest(value_imputed - last1, 0) + greatest(last1 - value_imputed, 0)) AS cc
 FROM x WHERE role = 'validation' GROUP BY 1, 2)
SELECT series_id, min(rows) AS smallest_block, max(rows) AS largest_block, count(*) FILTER (br >= cr) AS rmse_nonnegative_blocks, count(*) FILTER (bc >= cc) AS cost_nonnegative_blocks,
 round(min((br - cr) / greatest(br, 1e-12)), 6) AS worst_rmse_gain, round(min((bc - cc) / greatest(bc, 1e-12)), 6) AS worst_cost_gain FROM b GROUP BY 1"""),
    "certificate_grid": (certificate_grid, _CERT + """
SELECT series_id, candidate_id, round(rmse, 6) AS validation_rmse, round(mae, 6) AS validation_mae, round(bb, 6) AS clip_bound_scaled, round(clip, 6) AS certification_target_clipping_rate,
 n AS certificate_sample_size, round(ln(3::DOUBLE), 6) AS structure_kl, sc AS prior_scale, ra AS posterior_ratio, t AS temperature, round(risk, 6) AS empirical_gibbs_risk, round(kl, 5) AS gaussian_kl,
 round(total, 5) AS total_kl, round(value, 6) AS certificate_untruncated, round(least(1.0, value), 6) AS certificate FROM cand"""),
    "simple_gate": (simple_gate, _BASE + """,
elig AS (SELECT * FROM cand WHERE value <= 0.20 AND clip <= 0.05),
sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY rmse, value, a) AS pick FROM elig) WHERE pick = 1)""" + _GATE_TAIL.format(
        reason="CASE WHEN d.series_id IS NULL THEN 'no_certificate_eligible_candidate' WHEN d.rmse > s.srmse THEN 'eligible_models_failed_seasonal_validation_gate' ELSE 'certificate_and_validation_gates_passed' END",
        yes="certificate_and_validation_gates_passed")),
    "robust_gate": (robust_gate, _BASE + """,
bk AS (SELECT x.series_id, c.a, """ + _BLOCKS + """ AS block, value_imputed AS v, seas, least(greatest(q0 + q1 * x1, -bb), bb) * scaler_scale + scaler_mean AS f
  FROM x JOIN cm c ON c.series_id = x.series_id WHERE role = 'validation'),
bm AS (SELECT series_id, a, block, sqrt(avg((v - seas) ** 2)) AS br, sqrt(avg((v - f) ** 2)) AS cr, avg(2 * greatest(v - seas, 0) + greatest(seas - v, 0)) AS bc,
  avg(2 * greatest(v - f, 0) + greatest(f - v, 0)) AS cc FROM bk GROUP BY ALL),
st AS (SELECT series_id, a, count(*) FILTER (br >= cr) AS rg, count(*) FILTER (bc >= cc) AS cg, min((br - cr) / greatest(br, 1e-12)) AS rw, min((bc - cc) / greatest(bc, 1e-12)) AS cw FROM bm GROUP BY ALL),
elig AS (SELECT c.* FROM cand c JOIN st ON st.series_id = c.series_id AND st.a = c.a JOIN sv ON sv.series_id = c.series_id
  WHERE value <= 0.10 AND clip <= 0.02 AND (srmse - crmse) / greatest(srmse, 1e-12) >= 0.05 AND (scost - ccost) / greatest(scost, 1e-12) >= 0.05 AND rg >= 3 AND cg >= 3 AND rw >= -0.05 AND cw >= -0.05),
sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ccost, crmse, value, a) AS pick FROM elig) WHERE pick = 1)""" + _GATE_TAIL.format(
        reason="CASE WHEN d.series_id IS NULL THEN 'no_candidate_passed_robust_gate' ELSE 'robust_certificate_validation_gate_passed' END",
        yes="robust_certificate_validation_gate_passed")),
    "structure_codes": (structure_codes, _TABLE_CODE + """
SELECT sc.dataset, lag_order, rule_count, max(structures) AS structures, round(avg(lz - score), 6) AS table_code,
 round(min(ln(36::DOUBLE) + ln(2::DOUBLE) * rule_count + ln((SELECT sum(0.5::DOUBLE ** k) FROM (SELECT unnest(range(1, 13)) AS k)))), 6) AS fixed_grid_code
FROM sc JOIN nm ON nm.dataset = sc.dataset AND nm.series_id = sc.series_id GROUP BY 1, 2, 3"""),
    "matched_structure": (matched_structure, _TABLE_CODE + "," + picked_sql("res", (4,), ("uncapped_only",)) + """
SELECT r.dataset, r.series_id, r.selected_lag, round(lz - score, 6) AS structure_kl FROM res r JOIN sc ON sc.dataset = r.dataset AND sc.series_id = r.series_id AND sc.lag_order = r.selected_lag
 AND sc.radius = r.selected_radius AND sc.ridge_alpha = r.selected_ridge_alpha JOIN nm ON nm.dataset = r.dataset AND nm.series_id = r.series_id"""),
    "mixing_profile": (mixing_profile, _SAMPLE + """,
lo AS (SELECT s.*, len, sc, ra, n // (2 * len) AS mu, least(1.0, ((least(greatest(y, -bb), bb) - center) ** 2 + (sc * ra) ** 2 * sq) / (4 * bb * bb)) AS loss
  FROM smp s, (SELECT unnest([1, 4, 12, 300]) AS len), (SELECT unnest([0.5, 2.0]::DOUBLE[]) AS sc), (SELECT unnest([0.1, 1.0]::DOUBLE[]) AS ra)),
bl AS (SELECT series_id, len, sc, ra, mu, place // len AS blk, avg(loss) AS m, min(q2) AS q2 FROM lo WHERE (place // len) % 2 = 0 AND place < 2 * mu * len GROUP BY ALL),
br AS (SELECT series_id, len, sc, ra, mu, avg(m) AS risk, min(q2) AS q2 FROM bl WHERE mu >= 2 GROUP BY ALL),
bd2 AS (SELECT *, least(1.0, exp(-len / 1.5::DOUBLE)) AS env, 0.05::DOUBLE / 4 - 2.0 * (mu - 1) * least(1.0, exp(-len / 1.5::DOUBLE)) AS ed,
  greatest(0, 0.5 * (2 * (ln(1 / (ra * ra)) - 1 + ra * ra) + q2 / (sc * sc))) + ln(3::DOUBLE) + ln(2::DOUBLE) AS total FROM br),
ct AS (SELECT *, t, least(1.0, risk + t / 8 + (total + ln(2 / ed)) / (t * mu)) AS cert FROM bd2, (SELECT unnest([0.25, 1.0]::DOUBLE[]) AS t) WHERE ed > 0),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, len ORDER BY cert, total, risk, t, sc, ra) AS rn FROM ct) WHERE rn = 1),
fr AS (SELECT DISTINCT series_id, len, CAST(mu AS BIGINT) AS mu, least(1.0, exp(-len / 1.5::DOUBLE)) AS env, 0.05::DOUBLE / 4 - 2.0 * (mu - 1) * least(1.0, exp(-len / 1.5::DOUBLE)) AS ed FROM lo)
SELECT f.series_id, f.len AS block_length, CASE WHEN f.mu < 2 THEN 'INSUFFICIENT_BLOCKS' WHEN f.ed <= 0 THEN 'INFEASIBLE_CONFIDENCE' ELSE 'PASS' END AS status,
 CASE WHEN f.mu < 2 THEN 0 ELSE f.mu END AS effective_sample_size, CASE WHEN f.mu < 2 THEN 0 ELSE 2 * f.mu * f.len END AS used_observations,
 CASE WHEN f.mu >= 2 THEN round(f.env, 9) END AS assumed_beta_upper, CASE WHEN f.mu >= 2 THEN round(2.0 * (f.mu - 1) * f.env, 6) END AS mixing_residual, CASE WHEN f.mu >= 2 THEN round(f.ed, 6) END AS effective_delta,
 p.sc AS prior_scale, p.ra AS posterior_ratio, p.t AS temperature, round(p.risk, 6) AS block_risk, round(p.total, 6) AS total_kl, round(p.cert, 6) AS certificate
FROM fr f LEFT JOIN pk p ON p.series_id = f.series_id AND p.len = f.len"""),
    "odd_blocks": (odd_blocks, _SAMPLE + """,
lo AS (SELECT s.*, len, n // (2 * len) AS mu, least(1.0, (least(greatest(y, -bb), bb) - center) ** 2 / (4 * bb * bb)) AS loss FROM smp s, (SELECT unnest([1, 5, 24]) AS len)),
bl AS (SELECT series_id, len, mu, place // len AS blk, avg(loss) AS m FROM lo WHERE (place // len) % 2 = 0 AND place < 2 * mu * len GROUP BY ALL)
SELECT series_id, len AS block_length, mu AS blocks, CASE WHEN mu >= 2 THEN round(avg(m), 9) END AS block_risk, 2 * mu * len AS used_observations FROM bl GROUP BY series_id, len, mu"""),
    "recomputed_bounds": (recomputed_bounds, _CERT + " SELECT series_id, count(*) AS bounds, series_id <> 'error' AS agrees, round(max(value), 6) AS largest_bound FROM cand GROUP BY 1"),
    "paired_counts": (paired_counts, _DIFF + """
SELECT comparison, metric, count(*) AS pair_count, round(avg(d), 6) AS mean_difference, round(median(d), 6) AS median_difference, count(*) FILTER (d < 0) AS left_lower, count(*) FILTER (d > 0) AS left_higher,
 count(*) FILTER (abs(d) <= 1e-8) AS ties FROM df GROUP BY 1, 2"""),
    "signed_ranks": (signed_ranks, _EXACT + _RANKS.format(where="") + """,
s AS (SELECT comparison, metric, count(*) AS n, count(*) FILTER (d = 0) AS z, coalesce(sum(rk) FILTER (d > 0), 0) AS up, coalesce(sum(rk) FILTER (d < 0), 0) AS down,
  CAST(coalesce(sum(ties * ties - 1) FILTER (d <> 0), 0) AS BIGINT) AS tt FROM ra GROUP BY 1, 2),
v AS (SELECT *, sqrt((n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - tt / 2.0::DOUBLE) / 24.0::DOUBLE) AS sd, n * (n + 1) / 4.0::DOUBLE - z * (z + 1) / 4.0::DOUBLE AS mean FROM s)
SELECT comparison, metric, n AS pair_count, z AS zero_count, up AS rank_sum_positive, down AS rank_sum_negative, tt AS tie_term, round(CASE WHEN sd > 0 THEN (least(up, down) - mean) / sd ELSE 0 END, 6) AS z_score FROM v"""),
    "rank_biserial": (rank_biserial, _DIFF + _RANKS.format(where="WHERE abs(d) > 1e-8") + """
SELECT k.comparison, k.metric, round(coalesce(e, 0), 9) AS rank_biserial FROM (SELECT DISTINCT comparison, metric FROM df) k LEFT JOIN
 (SELECT comparison, metric, (coalesce(sum(rk) FILTER (d > 0), 0) - coalesce(sum(rk) FILTER (d < 0), 0)) / sum(rk) AS e FROM ra GROUP BY 1, 2) r ON r.comparison = k.comparison AND r.metric = k.metric"""),
    "holm": (holm, _DIFF + """,
p AS (SELECT comparison, metric, dataset, round((count(*) FILTER (d > 0) + 1) / (count(*) + 1), 9) AS p_value FROM df GROUP BY 1, 2, 3),
s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY comparison) - row_number() OVER (PARTITION BY comparison ORDER BY p_value) + 1) * p_value) AS st,
  row_number() OVER (PARTITION BY comparison ORDER BY p_value) AS rn FROM p)
SELECT comparison, metric, dataset, p_value, round(max(st) OVER (PARTITION BY comparison ORDER BY rn ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM s"""),
    "bootstrap_mean": (bootstrap_mean, _MEANS + f"""
SELECT s.comparison, s.metric, n AS pair_count, {_INTERVAL} FROM st s JOIN ci ON ci.comparison = s.comparison AND ci.metric = s.metric"""),
    "signed_rank_p": (signed_rank_p, _EXACT.replace("WITH ", "WITH RECURSIVE ", 1) + "," + _WAYS + """,
fw AS (SELECT comparison, metric, dataset || '|' || right(series_id, 1) AS part, d + """ + sql.digest_head("dataset || '|' || series_id") + """ / 1e14::DOUBLE AS d FROM df),
al AS (SELECT comparison, metric, 'all' AS part, d FROM df),""" + _p_sql("fw", "pf", "comparison, metric, part", "pratt") + "," + _p_sql("al", "pa_", "comparison, metric, part", "wilcox") + """
SELECT comparison, metric, part, coalesce(n, 0) AS pair_count, coalesce(z, 0) AS zero_count, coalesce(up, 0) AS rank_sum_positive, coalesce(down, 0) AS rank_sum_negative, coalesce(tt, 0) AS tie_term,
 round(coalesce(zs, 0), 6) AS z_score, round(p, 9) AS p_value FROM (SELECT * FROM pf UNION ALL BY NAME SELECT * FROM pa_)"""),
    "paired_statistics": (paired_statistics, _MEANS.replace("WITH ", "WITH RECURSIVE ", 1) + "," + _WAYS + "," + _p_sql("df", "pv", "comparison, metric", "pratt") + """,
rb AS (SELECT comparison, metric, (coalesce(sum(rk) FILTER (d > 0), 0) - coalesce(sum(rk) FILTER (d < 0), 0)) / sum(rk) AS e FROM (
  SELECT *, rank() OVER (PARTITION BY comparison, metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY comparison, metric, abs(d)) - 1) / 2.0::DOUBLE AS rk FROM df WHERE abs(d) > 1e-8) GROUP BY 1, 2),
ho AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY comparison) - row_number() OVER (PARTITION BY comparison ORDER BY p) + 1) * p) AS sp, row_number() OVER (PARTITION BY comparison ORDER BY p) AS rn FROM pv),
hx AS (SELECT comparison, metric, p, max(sp) OVER (PARTITION BY comparison ORDER BY rn ROWS UNBOUNDED PRECEDING) AS ph FROM ho),
ct AS (SELECT comparison, metric, median(d) AS md, count(*) FILTER (d < 0) AS lo_n, count(*) FILTER (d > 0) AS hi_n, count(*) FILTER (abs(d) <= 1e-8) AS ties FROM df GROUP BY 1, 2)
SELECT s.comparison, s.metric, n AS pair_count, """ + _INTERVAL + """, round(md, 6) AS median_difference, lo_n AS left_lower_count, hi_n AS left_higher_count, ties,
 round(hx.p, 9) AS p_value, round(hx.ph, 9) AS p_holm, round(coalesce(e, 0), 9) AS rank_biserial
FROM st s JOIN ci ON ci.comparison = s.comparison AND ci.metric = s.metric JOIN ct ON ct.comparison = s.comparison AND ct.metric = s.metric
 JOIN hx ON hx.comparison = s.comparison AND hx.metric = s.metric LEFT JOIN rb ON rb.comparison = s.comparison AND rb.metric = s.metric"""),
    "block_bootstrap": (block_bootstrap, _LAG + """,
pa AS (SELECT series_id, role_step AS at, role_size AS n, (value_imputed - seas) ** 2 AS bs, (value_imputed - last1) ** 2 AS ds,
  2 * greatest(value_imputed - seas, 0) + greatest(seas - value_imputed, 0) AS bc, 2 * greatest(value_imputed - last1, 0) + greatest(last1 - value_imputed, 0) AS dc FROM x WHERE role = 'test'),
ob AS (SELECT series_id, min(n) AS n, 1 - sqrt(avg(ds)) / sqrt(avg(bs)) AS orr, 1 - avg(dc) / avg(bc) AS oc FROM pa GROUP BY 1),
pr_ AS (SELECT series_id, n, len, rep, """ + sql.digest_head("'3|' || series_id || '|' || len") + f""" AS key FROM ob, (SELECT unnest([7, 24]) AS len), (SELECT unnest(range({REPLICATES})) AS rep)),""" + sql.mixed("pr_", "xor(key, rep)", "pm", "h") + """,
pl AS (SELECT series_id, n, len, rep, h, unnest(range(CAST(ceil(n / len) AS BIGINT))) AS j FROM pm),""" + sql.mixed("pl", "xor(h, j)", "px", "hash") + """,
dw AS (SELECT *, hash % n AS start FROM px),
ex AS (SELECT series_id, len, rep, n, (start + o) % n AS at FROM (SELECT *, unnest(range(len)) AS o FROM dw) WHERE j * len + o < n),
gn AS (SELECT e.series_id, len, rep, round(1 - sqrt(sum(ds)) / sqrt(sum(bs)), 9) AS g, round(1 - sum(dc) / sum(bc), 9) AS c FROM ex e JOIN pa ON pa.series_id = e.series_id AND pa.at = e.at GROUP BY ALL)
SELECT g.series_id, len AS block_length, round(quantile_cont(g, 0.025), 6) AS rmse_ci_low, round(quantile_cont(g, 0.975), 6) AS rmse_ci_high, round((count(*) FILTER (g <= 0) + 1) / 20001, 6) AS rmse_bootstrap_probability_nonpositive,
 round(quantile_cont(c, 0.025), 6) AS cost_ci_low, round(quantile_cont(c, 0.975), 6) AS cost_ci_high, round((count(*) FILTER (c <= 0) + 1) / 20001, 6) AS cost_bootstrap_probability_nonpositive, count(*) AS bootstrap_resamples,
 min(n) AS sample_size, round(min(orr), 6) AS observed_rmse_improvement, round(min(oc), 6) AS observed_cost_improvement, CASE WHEN len = 24 THEN 'primary' ELSE 'sensitivity' END AS analysis_role
FROM gn g JOIN ob ON ob.series_id = g.series_id GROUP BY g.series_id, len"""),
}
