"""Registered queries: rule models, summaries of candidate tables, bound functions, stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidefold.checks import sql
from tidefold.checks.comparison import _P as POOL
from tidefold.checks.models import _EVT, _FIT, SLOTS, _evt, _fits, rounded
from tidefold.checks.pools import pool
from tidefold.checks.studies import EVT, TWO_RULES
from tidefold.functions import metrics as m
from tidefold.operators import certify, compare, lags, quality, resample
from tidefold.operators.cover import parameter_counts
from tidefold.operators.sweep import Grid
from tidefold.plans import decide, develop
from tidefold.session import shared_folder, store
from tidefold.sources import files, panels

PAIR = Grid(families=("fixed_k_dense_tsk",), lags=(2,), ridge_alphas=(0.1, 1.0), max_rules=2, fixed_k=(2,))
MEASURES = ("validation_rmse", "validation_mae", "validation_rmse_clipped", "validation_weighted_cost")


def rule_candidates(spark, folder):
    """Two-rule models of two lags: consequents, errors, usage, size and bound of every penalty."""
    case = decide.Case(_evt(spark, folder), PAIR, EVT.season, "simple", max_len=SLOTS)
    got = case.candidates.withColumns(parameter_counts(F.col("rule_count"), F.col("lag")))
    out = got.select(
        "series_id", "candidate_id", "rule_count", "consequent_dimension", "antecedent_parameter_count", "total_parameter_count", "structure_kl", "clip_bound_scaled",
        *[F.get("coefficients", F.lit(i)).alias(f"b{i}") for i in range(6)], *MEASURES, "prior_scale", "posterior_ratio", "temperature", "empirical_gibbs_risk",
        "gaussian_kl", "total_kl", "certificate_untruncated", "certificate", "effective_rule_count", "minimum_hard_rule_support",
        m.rms_allowance(F.col("certificate"), F.col("clip_bound_scaled"), F.col("scaler_scale")).alias("rms_allowance"),
    )
    return rounded(out, structure_kl=6, clip_bound_scaled=6, **{f"b{i}": 5 for i in range(6)}, **{c: 6 for c in MEASURES}, empirical_gibbs_risk=6, gaussian_kl=4,
                   total_kl=4, certificate_untruncated=5, certificate=5, rms_allowance=4)


def rule_decisions(spark, folder):
    """The simple gate over two-rule models: decisions from validation, then the test role with the stored rules."""
    case = decide.Case(_evt(spark, folder), PAIR, EVT.season, "simple", max_len=SLOTS)
    out = case.outcomes(case.decisions()).select(
        "series_id", "deployment", "reason", "eligible_candidate_count", F.col("selected.candidate_id").alias("selected_candidate_id"), "seasonal_validation_rmse",
        "test_baseline_rmse", "test_deployed_rmse", "test_deployed_weighted_cost",
    )
    return rounded(out, seasonal_validation_rmse=6, test_baseline_rmse=6, test_deployed_rmse=5, test_deployed_weighted_cost=6)


# --- summaries over the pool ---------------------------------------------------------------


def _models(spark, folder):
    """The pool in the columns of a candidate table: lags as families, radii as rule counts, a made bound."""
    # Stored: its rows meet their own mean, which would make the pool twice.
    p = store(pool(spark, folder).filter(F.col("dataset") == "suppliers"))
    bound = F.round(F.col("rmse") / (2 * F.col("_mean")) + F.col("ridge_alpha") / 10, 9)
    mean = p.groupBy("dataset").agg(F.avg("rmse").alias("_mean"))
    rows = p.join(mean, "dataset")
    return store(rows.select(
        "series_id", F.concat(F.lit("lag_"), "lag_order").alias("family"), F.col("lag_order").alias("lag"), "radius", F.col("radius").cast("int").alias("wanted_k"),
        F.concat_ws("|", "lag_order", "radius", "ridge_alpha").alias("candidate_id"), "rule_count", F.col("total_parameter_count").alias("consequent_dimension"),
        F.col("rmse").alias("validation_rmse"), F.col("mae").alias("validation_mae"), "test_rmse", F.col("test_rmse").alias("test_rmse_clipped"), F.col("test_mae").alias("test_weighted_cost"),
        F.col("rule_count").cast("double").alias("gaussian_kl"), (F.col("rule_count") + F.col("ridge_alpha")).alias("total_kl"), bound.alias("certificate_untruncated"),
        F.least(F.lit(1.0), bound).alias("certificate"), F.col("radius_cap_reached").cast("double").alias("certification_target_clipping_rate"),
        F.when(F.col("ridge_alpha") == 0.1, "validation_rmse").otherwise("certificate").alias("selection_strategy"),
    ))


def strategy_summary(spark, folder):
    out = compare.strategy_summary(_models(spark, folder), ["family", "selection_strategy"])
    return rounded(out, **{c: 6 for c, t in out.dtypes if t == "double"})


def radius_chain(spark, folder):
    out = compare.radius_chain(_models(spark, folder))
    return rounded(out, **{c: 6 for c, t in out.dtypes if t == "double" and c != "radius"})


def family_summary(spark, folder):
    out = compare.family_summary(_models(spark, folder))
    return rounded(out, **{c: 6 for c, t in out.dtypes if t == "double"})


def families_side_by_side(spark, folder):
    rows = _models(spark, folder).filter((F.col("radius") == 1.5) & (F.col("selection_strategy") == "validation_rmse"))
    out = compare.side_by_side(rows, "lag_1", "lag_4", ["rule_count", "certificate", "test_rmse_clipped"])
    return rounded(out, **{c: 6 for c, t in out.dtypes if t == "double"})


def best_fixed_count(spark, folder):
    rows = _models(spark, folder).withColumn("family", F.when(F.col("lag") == 2, "fixed_k_dense_tsk").otherwise(F.col("family")))
    return develop.best_fixed_count(rows).select("series_id", "selection_strategy", "validation_rmse", "certificate_untruncated")


# --- bound and status functions ------------------------------------------------------------


def bound_functions(spark, folder):
    """Divergences of two diagonal Gaussians, structure codes of each family and error allowances, on the parts."""
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")
    part = panels.table(spark, folder, "part")
    kl = certify.gaussian_kl(
        F.array(size / 50, price / 1000), F.array(size / 25, price / 2000), F.array(F.lit(0.5), F.lit(1.0)), F.array(F.lit(1.0), price / 1500)
    )
    family = F.element_at(F.array(*[F.lit(f) for f in ("ridge", "fixed_k_dense_tsk", "dense_tsk", "sparse_tsk")]), (F.col("p_size") % 4 + 1).cast("int"))
    out = part.select(
        "p_partkey", kl.alias("divergence"), certify.structure_code(family, F.col("p_size") % 8 + 1, 4, 3, 6, 5, 8).alias("code"),
        m.rms_allowance(size / 40, price / 1000, F.lit(3.0)).alias("allowance"),
        *[m.gain(size, price / 37, how).alias(f"{how}_gain") for how in ("plain", "floored", "absolute")],
        develop.top_terms(F.array(size - 25, price / 100 - 10, (size % 7) - 3)).alias("terms"),
    )
    return rounded(out, divergence=6, code=9, allowance=6, plain_gain=6, floored_gain=6, absolute_gain=6)


def evidence_status(spark, folder):
    """Bounds with and without complete evidence, by customer segment, and the roll-up of their states."""
    c = panels.table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_custkey") % 5 == 0, "assumed").otherwise(certify.VERIFIED["stationarity_status"]).alias("stationarity_status"),
        F.when(F.col("c_custkey") % 7 == 0, "unknown").otherwise(certify.VERIFIED["frozen_feature_map_status"]).alias("frozen_feature_map_status"),
        F.lit(certify.VERIFIED["envelope_verification_status"]).alias("envelope_verification_status"),
        F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise("a source").alias("source_reference"),
    )
    parts = c.groupBy("segment").agg(F.count_if(certify.evidence_complete()).alias("complete"), F.count("*").alias("bounds"))
    state = F.when(F.col("complete") * 2 > F.col("bounds"), "PASS").when(F.col("complete") > 0, "SENSITIVITY_ONLY").otherwise("FAIL")
    rolled = quality.overall_status(parts.withColumn("status", state)).withColumn("_one", F.lit(1))
    return parts.withColumn("_one", F.lit(1)).join(rolled, "_one").drop("_one")


# --- stored tables -------------------------------------------------------------------------


def _place(spark) -> str:
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


def stored_wide_panel(spark, folder):
    """The hourly panel of all event types, written wide and read back under its contract."""
    p, path = panels.EVENT_HOURS, _place(spark)
    timed = resample.with_step(panels.evt_hour(spark, folder).withColumn("value", F.coalesce("value", F.lit(0.0)) + 1), p.start, p.step)
    names = resample.names_of(timed)
    files.write_new(resample.wide(timed, names).withColumnRenamed("ts", "timestamp"), path)
    back = files.read_wide_panel(spark, path, names, p.slots, p.step)
    return back.groupBy("series_id").agg(F.count("*").alias("rows"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 6).alias("top"))


def stored_lags(spark, folder):
    """Lag rows of two orders written by order and role; one order and two roles are read back."""
    path = _place(spark)
    for order in (1, 3):
        files.write_lagged(lags.with_lags(_evt(spark, folder), order, max_len=SLOTS), f"{path}/{order}", order)
    back = files.read_lagged(spark, f"{path}/3", 3, "bound", "test")
    return back.groupBy("series_id", "role").agg(
        F.count("*").alias("rows"), F.round(F.sum(F.col("features")[0]), 6).alias("first_lag"), F.round(F.sum(F.col("features")[2]), 6).alias("third_lag")
    )


def stored_models(spark, folder):
    """Ridge models written and loaded again; a second write to the same place is refused."""
    path = _place(spark)
    models = _fits(spark, folder, 1, "penalised_ridge")[1].withColumn("k", F.lit(0))
    files.write_models(models, None, path)
    try:
        files.write_models(models, None, path)
        again = "overwritten"
    except Exception:  # Spark reports an existing path by several exception classes
        again = "refused"
    back = files.read_models(spark, path, with_rules=False)
    return back.select("series_id", "ridge_alpha", F.round(F.col("coefficients")[0], 6).alias("b0"), F.round(F.col("coefficients")[1], 6).alias("b1"), F.lit(again).alias("second_write"))


# --- SQL -----------------------------------------------------------------------------------

_X = range(6)
_GRAM = ", ".join([f"sum(d{i} * d{j}) AS s{i}_{j}" for i in _X for j in range(i, 6)] + [f"sum(d{i} * y) AS t{i}" for i in _X])
_DOT = " + ".join(f"q{i} * d{i}" for i in _X)
_CUT = f"least(greatest({_DOT}, -bb), bb)"
_RULE_MODELS = TWO_RULES + """,
rw AS (SELECT x.series_id, x.step, x.role, x.role_step, x.role_size, x.value_scaled AS y, x.value_imputed, x.scaler_mean, x.scaler_scale, (l1 - m1) / s1 AS z1, (l2 - m2) / s2 AS z2, wd.* EXCLUDE (series_id)
  FROM x JOIN sd ON sd.series_id = x.series_id JOIN wd ON wd.series_id = x.series_id),
rl AS (SELECT *, -0.5 * (((z1 - a1) / ta1) ** 2 + ((z2 - a2) / ta2) ** 2) AS u, -0.5 * (((z1 - b1) / tb1) ** 2 + ((z2 - b2) / tb2) ** 2) AS v FROM rw),
rf AS (SELECT *, 1 / (1 + exp(v - u)) AS f1, 1 / (1 + exp(u - v)) AS f2 FROM rl),
ds AS (SELECT series_id, step, role, role_step, role_size, y, value_imputed, scaler_mean, scaler_scale, f1, f2, f1 AS d0, f1 * z1 AS d1, f1 * z2 AS d2, f2 AS d3, f2 * z1 AS d4, f2 * z2 AS d5 FROM rf),
gm AS (SELECT series_id, role, count(*) AS n, sum(y * y) AS yy, max(abs(y)) AS top, """ + _GRAM + """ FROM ds WHERE role IN ('prior', 'bound') GROUP BY 1, 2),
ga AS (SELECT *, a, """ + ", ".join(f"s{i}_{j}" + (" + a" if i == j else "") + f" AS g{i}_{j}" for i in _X for j in range(i, 6)) + """ FROM gm, (SELECT unnest([0.1::DOUBLE, 1.0::DOUBLE]) AS a)),""" + sql.inverted("ga", "sl", 6) + """,
pp AS (SELECT *, (yy - 2 * (""" + " + ".join(f"b{i} * t{i}" for i in _X) + ") + " + " + ".join(
    f"{1 if i == j else 2} * b{i} * b{j} * s{i}_{j}" for i in _X for j in range(i, 6)) + """) / n AS rss FROM sl WHERE role = 'prior'),
md AS (SELECT p.series_id, p.a, greatest(1.0::DOUBLE, 1.25::DOUBLE * p.top) AS bb, """ + ", ".join(
    [f"q.b{i} AS q{i}" for i in _X] + [f"p.b{i} AS p{i}" for i in _X] + [f"sqrt(least(greatest(greatest(1e-4, p.rss) * greatest(p.v{i}, 0), 1e-6), 100.0)) AS e{i}" for i in _X]) + """
  FROM pp p JOIN sl q ON q.series_id = p.series_id AND q.a = p.a AND q.role = 'bound'),
cm AS (SELECT *, """ + " + ".join(f"((q{i} - p{i}) / e{i}) ** 2" for i in _X) + """ AS loc FROM md),
cr AS (SELECT c.series_id, c.a, c.loc, c.bb, (least(greatest(y, -bb), bb) - (""" + _DOT + ")) ** 2 AS bias, " + " + ".join(f"d{i} * d{i} * e{i} * e{i}" for i in _X) + """ AS var, CAST(abs(y) > bb AS INT) AS clipped, f1, f2
  FROM ds JOIN cm c ON c.series_id = ds.series_id WHERE role IN ('bound', 'validation')),
gr AS (SELECT i, [0.5, 1, 2, 4, 8][i // 5 + 1]::DOUBLE AS sc, [0.01, 0.03, 0.1, 0.3, 1.0][i % 5 + 1]::DOUBLE AS ra FROM (SELECT unnest(range(25)) AS i)),
rk AS (SELECT series_id, a, i, sc, ra, min(loc) AS loc, min(bb) AS bb, count(*) AS n, avg(clipped::DOUBLE) AS clip, avg(least(1.0, (bias + (sc * ra) ** 2 * var) / (4 * bb * bb))) AS risk,
  count(*) FILTER (f1 >= f2) AS h1, count(*) FILTER (f1 < f2) AS h2 FROM cr, gr GROUP BY ALL),
kk AS (SELECT *, ln(2::DOUBLE) + 2 * ln(2::DOUBLE) + ln(0.75::DOUBLE) AS code, greatest(0, 0.5 * (6 * (ln(1 / (ra * ra)) - 1 + ra * ra) + loc / (sc * sc))) AS kl FROM rk),
tt AS (SELECT *, code + ln(5::DOUBLE) + kl AS total, t, risk + t / 8 + (code + ln(5::DOUBLE) + kl + ln(6 * (SELECT count(DISTINCT series_id) FROM x) / 0.05::DOUBLE)) / (t * n) AS value FROM kk, (SELECT unnest([0.125, 0.25, 0.5, 1, 2, 4]::DOUBLE[]) AS t)),
bst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, a ORDER BY value, i, t) AS rn FROM tt) WHERE rn = 1),
vl AS (SELECT ds.series_id, c.a, sqrt(avg((y - (""" + _DOT + """)) ** 2)) * min(scaler_scale) AS rmse, avg(abs(y - (""" + _DOT + """))) * min(scaler_scale) AS mae, sqrt(avg((y - """ + _CUT + """) ** 2)) * min(scaler_scale) AS crmse,
  avg(2 * greatest(y - """ + _CUT + ", 0) + greatest(" + _CUT + """ - y, 0)) * min(scaler_scale) AS ccost, min(scaler_scale) AS ss FROM ds JOIN cm c ON c.series_id = ds.series_id WHERE role = 'validation' GROUP BY ALL),
cand AS (SELECT b.*, v.* EXCLUDE (series_id, a), 'fixed_k_dense_tsk|p=2|r=none|a=' || printf('%.8g', b.a) || '|k=2' AS candidate_id, c.* EXCLUDE (series_id, a, bb, loc)
  FROM bst b JOIN vl v ON b.series_id = v.series_id AND b.a = v.a JOIN cm c ON c.series_id = b.series_id AND c.a = b.a)"""
_RULE_DECISIONS = _RULE_MODELS + """,
sn AS (SELECT *, lag(value_imputed, 24) OVER (PARTITION BY series_id ORDER BY step) AS seas FROM p),
sv AS (SELECT series_id, sqrt(avg((value_imputed - seas) ** 2)) AS srmse FROM sn WHERE role = 'validation' AND seas IS NOT NULL GROUP BY 1),
elig AS (SELECT * FROM cand WHERE value <= 0.20 AND clip <= 0.05),
sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY rmse, value, a) AS pick FROM elig) WHERE pick = 1),
dd AS (SELECT s.series_id, s.srmse, d.candidate_id, d.a, coalesce(e.k, 0) AS k, CASE WHEN d.series_id IS NULL THEN 'no_certificate_eligible_candidate' WHEN d.rmse > s.srmse THEN 'eligible_models_failed_seasonal_validation_gate'
  ELSE 'certificate_and_validation_gates_passed' END AS reason FROM sv s LEFT JOIN sel d ON d.series_id = s.series_id LEFT JOIN (SELECT series_id, count(*) AS k FROM elig GROUP BY 1) e ON e.series_id = s.series_id),
du AS (SELECT *, CASE WHEN reason LIKE 'certificate_and%' THEN a END AS use_a FROM dd),
ev AS (SELECT t.series_id, t.value_imputed AS y, t.seas, CASE WHEN u.use_a IS NULL THEN t.seas ELSE """ + _CUT + """ * d.scaler_scale + d.scaler_mean END AS f
  FROM sn t JOIN du u ON u.series_id = t.series_id JOIN cm c ON c.series_id = t.series_id AND c.a = coalesce(u.use_a, 1.0) JOIN ds d ON d.series_id = t.series_id AND d.step = t.step WHERE t.role = 'test' AND t.seas IS NOT NULL),
ms AS (SELECT series_id, sqrt(avg((y - seas) ** 2)) AS br, sqrt(avg((y - f) ** 2)) AS dr, avg(2 * greatest(y - f, 0) + greatest(f - y, 0)) AS dc FROM ev GROUP BY 1)
SELECT u.series_id, CASE WHEN use_a IS NULL THEN 'seasonal_naive' ELSE 'fixed_k_dense_tsk' END AS deployment, reason, k AS eligible_candidate_count, CASE WHEN use_a IS NOT NULL THEN candidate_id END AS selected_candidate_id,
 round(srmse, 6) AS seasonal_validation_rmse, round(br, 6) AS test_baseline_rmse, round(dr, 5) AS test_deployed_rmse, round(dc, 6) AS test_deployed_weighted_cost FROM du u JOIN ms ON ms.series_id = u.series_id"""
_MODELS = POOL + """,
mp AS (SELECT *, avg(rmse) OVER () AS mean_rmse FROM pool WHERE dataset = 'suppliers'),
mo AS (SELECT series_id, 'lag_' || lag_order AS family, lag_order AS lag, radius, ridge_alpha, lag_order || '|' || CAST(radius AS VARCHAR) || '|' || CAST(ridge_alpha AS VARCHAR) AS candidate_id, rule_count, total_parameter_count AS dim, rmse, mae, test_rmse, test_mae,
  round(rmse / (2 * mean_rmse) + ridge_alpha / 10, 9) AS cu, radius_cap_reached AS cap, CASE WHEN ridge_alpha = 0.1::DOUBLE THEN 'validation_rmse' ELSE 'certificate' END AS selection_strategy FROM mp)"""
_WIDE = "WITH " + sql.EVT_HOUR

CHECKS = {
    "rule_candidates": (rule_candidates, _RULE_MODELS + """
SELECT series_id, candidate_id, 2 AS rule_count, 6 AS consequent_dimension, 8 AS antecedent_parameter_count, 14 AS total_parameter_count, round(code, 6) AS structure_kl, round(bb, 6) AS clip_bound_scaled, """ + ", ".join(
        f"round(q{i}, 5) AS b{i}" for i in _X) + """, round(rmse, 6) AS validation_rmse, round(mae, 6) AS validation_mae, round(crmse, 6) AS validation_rmse_clipped, round(ccost, 6) AS validation_weighted_cost, sc AS prior_scale, ra AS posterior_ratio,
 t AS temperature, round(risk, 6) AS empirical_gibbs_risk, round(kl, 4) AS gaussian_kl, round(total, 4) AS total_kl, round(value, 5) AS certificate_untruncated, round(least(1.0, value), 5) AS certificate,
 CAST(h1 > 0 AS BIGINT) + CAST(h2 > 0 AS BIGINT) AS effective_rule_count, least(h1, h2) AS minimum_hard_rule_support, round(2 * bb * ss * sqrt(least(1.0, value)), 4) AS rms_allowance FROM cand"""),
    "rule_decisions": (rule_decisions, _RULE_DECISIONS),
    "strategy_summary": (strategy_summary, _MODELS + """
SELECT family, selection_strategy, count(*) AS series_count, round(avg(rmse), 6) AS mean_validation_rmse, round(stddev_samp(rmse), 6) AS sd_validation_rmse, round(avg(test_rmse), 6) AS mean_test_rmse, round(stddev_samp(test_rmse), 6) AS sd_test_rmse,
 round(avg(rule_count), 6) AS mean_rule_count, round(avg(dim), 6) AS mean_dimension, round(avg(least(1.0, cu)), 6) AS mean_certificate, round(stddev_samp(least(1.0, cu)), 6) AS sd_certificate, count(*) FILTER (least(1.0, cu) >= 1) AS vacuous,
 round(median(least(1.0, cu)), 6) AS median_certificate FROM mo GROUP BY 1, 2"""),
    "radius_chain": (radius_chain, _MODELS + """
SELECT family, lag, radius, count(*) AS candidates, round(avg(rule_count), 6) AS mean_rule_count, round(avg(dim), 6) AS mean_dimension, round(avg(rmse), 6) AS mean_validation_rmse, round(avg(rule_count), 6) AS mean_gaussian_kl,
 round(avg(rule_count + ridge_alpha), 6) AS mean_total_kl, round(avg(least(1.0, cu)), 6) AS mean_certificate FROM mo GROUP BY 1, 2, 3"""),
    "family_summary": (family_summary, _MODELS + """
SELECT family, count(*) AS series, round(avg(least(1.0, cu)), 6) AS mean_certificate, round(avg(rmse), 6) AS mean_validation_rmse, round(avg(test_rmse), 6) AS mean_test_rmse, round(avg(test_mae), 6) AS mean_test_weighted_cost,
 round(avg(rule_count + ridge_alpha), 6) AS mean_total_kl, round(avg(rule_count), 6) AS mean_rule_count, round(avg(dim), 6) AS mean_dimension, round(avg(CAST(cap AS INT)), 6) AS mean_certification_clipping FROM mo GROUP BY 1"""),
    "families_side_by_side": (families_side_by_side, _MODELS + """,
sb AS (SELECT * FROM mo WHERE radius = 1.5 AND selection_strategy = 'validation_rmse'),
sj AS (SELECT l.series_id, l.rule_count AS lk, r.rule_count AS rk, least(1.0, l.cu) AS lc, least(1.0, r.cu) AS rc, l.test_rmse AS lt, r.test_rmse AS rt FROM sb l JOIN sb r ON l.series_id = r.series_id AND l.family = 'lag_1' AND r.family = 'lag_4')
SELECT series_id, lk AS left_rule_count, rk AS right_rule_count, round(lc, 6) AS left_certificate, round(rc, 6) AS right_certificate, round(lt, 6) AS left_test_rmse_clipped, round(rt, 6) AS right_test_rmse_clipped, lk - rk AS rule_count_difference,
 round(lc - rc, 6) AS certificate_difference, round(lt - rt, 6) AS test_rmse_clipped_difference FROM sj"""),
    "best_fixed_count": (best_fixed_count, _MODELS + """
SELECT series_id, selection_strategy, rmse AS validation_rmse, cu AS certificate_untruncated FROM (SELECT *, row_number() OVER (PARTITION BY series_id, selection_strategy
  ORDER BY CASE WHEN selection_strategy = 'certificate' THEN cu ELSE rmse END, rmse, mae, dim, rule_count, radius) AS rn FROM mo WHERE lag = 2) WHERE rn = 1"""),
    "bound_functions": (bound_functions, """
WITH v AS (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice::DOUBLE AS r, ['ridge', 'fixed_k_dense_tsk', 'dense_tsk', 'sparse_tsk'][p_size % 4 + 1] AS f, p_size % 8 + 1 AS k FROM part),
w AS (SELECT *, 0.5 * (ln(1 / (s / 25) ** 2) - 1 + (s / 25) ** 2 + (s / 50 - 0.5) ** 2 + ln((r / 1500) ** 2 / (r / 2000) ** 2) - 1 + ((r / 2000) ** 2 + (r / 1000 - 1) ** 2) / (r / 1500) ** 2) AS kl,
  ln(4::DOUBLE) + ln(3::DOUBLE) + ln(5::DOUBLE) AS base, ln((SELECT sum(0.5::DOUBLE ** j) FROM (SELECT unnest(range(1, 9)) AS j))) AS norm, [s - 25, r / 100 - 10, s % 7 - 3] AS b FROM v),
o AS (SELECT *, list_sort(list_transform([1, 2, 3], lambda i: struct_pack(a := -abs(b[i]), i := i, v := b[i]))) AS t FROM w)
SELECT p_partkey, round(greatest(0, kl), 6) AS divergence, round(base + CASE WHEN f = 'ridge' THEN 0 ELSE ln(2::DOUBLE) * k + norm + CASE WHEN f = 'fixed_k_dense_tsk' THEN 0 ELSE ln(6::DOUBLE) END END, 9) AS code,
 round(2 * r / 1000 * 3 * sqrt(least(1.0, s / 40)), 6) AS allowance, round((s - r / 37) / s, 6) AS plain_gain, round((s - r / 37) / greatest(s, 1e-12), 6) AS floored_gain, round((s - r / 37) / greatest(abs(s), 1e-12), 6) AS absolute_gain,
 array_to_string(list_transform(t, lambda x: (CASE WHEN x.v < 0 THEN '-' ELSE '+' END) || printf('%.3f', abs(x.v)) || ' y(t-' || x.i || ')'), '; ') AS terms FROM o"""),
    "evidence_status": (evidence_status, """
WITH s AS (SELECT c_mktsegment AS segment, count(*) FILTER (c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 3 <> 0) AS complete, count(*) AS bounds FROM customer GROUP BY 1),
t AS (SELECT *, CASE WHEN complete * 2 > bounds THEN 'PASS' WHEN complete > 0 THEN 'SENSITIVITY_ONLY' ELSE 'FAIL' END AS status FROM s),
r AS (SELECT count(*) AS checks, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'SENSITIVITY_ONLY') AS qualified FROM t)
SELECT segment, complete, bounds, checks, failed, qualified, CASE WHEN failed > 0 THEN 'FAIL' WHEN qualified > 0 THEN 'PASS_WITH_QUALIFICATIONS' ELSE 'PASS' END AS overall FROM s, r"""),
    "stored_wide_panel": (stored_wide_panel, _WIDE + """
SELECT series_id, count(*) AS rows, round(sum(coalesce(value, 0) + 1), 4) AS total, round(max(coalesce(value, 0) + 1), 6) AS top FROM evt_hour GROUP BY 1"""),
    "stored_lags": (stored_lags, _EVT + """,
g AS (SELECT series_id, role, step, lag(value_scaled, 1) OVER w AS a, lag(value_scaled, 3) OVER w AS c FROM p WINDOW w AS (PARTITION BY series_id ORDER BY step))
SELECT series_id, role, count(*) AS rows, round(sum(a), 6) AS first_lag, round(sum(c), 6) AS third_lag FROM g WHERE step >= 3 AND role IN ('bound', 'test') GROUP BY 1, 2"""),
    "stored_models": (stored_models, _FIT + " SELECT series_id, a AS ridge_alpha, round(b0, 6) AS b0, round(b1, 6) AS b1, 'refused' AS second_write FROM bd_f"),
}
