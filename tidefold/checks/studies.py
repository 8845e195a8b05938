"""Registered queries: rule models, full studies, smoothing benchmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefold.checks import sql
from tidefold.checks.models import _EVT, rounded
from tidefold.operators import compare, smooth
from tidefold.operators.cover import as_rules, cover, design_row, firing_strengths, parameter_counts, rule_usage, standardize
from tidefold.operators.sweep import Grid, lag_context, sweep_rows
from tidefold.plans import decide, develop, prepare
from tidefold.session import store
from tidefold.sources import panels

EVT, SHIP = panels.EVENT_HOURS, panels.SHIP_WEEKS
SMALL = Grid(families=("ridge", "fixed_k_dense_tsk", "dense_tsk", "sparse_tsk"), lags=(3, 6), radii=(0.75, 1.5, 2.5),
             ridge_alphas=(0.001, 0.1), max_rules=6, fixed_k=(2, 4, 6), clip_multiplier=1.0)
CASE = Grid()


def _evt(spark, folder):
    return prepare.by_ratio_panel(panels.evt_hour(spark, folder), 24, max_len=EVT.slots)


def _case(spark, folder, gate):
    return decide.Case(_evt(spark, folder), CASE, EVT.season, gate, 5, max_len=EVT.slots)


def _sweep(spark, folder):
    return develop.Sweep(_evt(spark, folder), SMALL, 5, max_len=EVT.slots)


def rule_covers(spark, folder):
    """Refined rules of every cut, with their sizes."""
    sweep = _sweep(spark, folder)
    return sweep.covers.withColumns(parameter_counts(F.col("rule_count"), F.col("lag"))).drop("feature_mean", "feature_scale")


def firing_usage(spark, folder):
    """Rule weights and usage diagnostics of the four-rule covers on certification rows."""
    sweep = _sweep(spark, folder)
    rules = sweep.covers.filter(F.col("k") == 4)
    rows = sweep.lagged.filter(F.col("role").isin("bound", "validation")).select("series_id", "step", "features").join(rules, "series_id")
    lag, count = F.col("lag"), F.col("rule_count")
    z = standardize(F.slice("features", F.lit(1), lag), F.col("feature_mean"), F.col("feature_scale"))
    w = firing_strengths(z, as_rules(F.col("centers"), count, lag), as_rules(F.col("spreads"), count, lag), F.least(F.lit(3), count))
    fired = rows.filter(F.col("step") >= lag).select("series_id", "lag", w.alias("w"), F.size(design_row(z, w)).alias("width"))
    return rule_usage(fired, ["series_id", "lag", "width"], "w")


def _two_rules(spark, folder, max_len):
    """Two-lag covers cut at two rules: radii, supports and usage on certification rows."""
    grid = Grid(lags=(2,), max_rules=2)
    lagged = store(lag_context(_evt(spark, folder), 2, EVT.slots))
    covers = store(cover(sweep_rows(lagged, grid, max_len), (2,), 2, max_len).filter(F.col("k") == 2))
    rows = lagged.filter(F.col("role").isin("bound", "validation") & (F.col("step") >= 2)).select("series_id", "features").join(covers, "series_id")
    z = standardize(F.col("features"), F.col("feature_mean"), F.col("feature_scale"))
    w = firing_strengths(z, as_rules(F.col("centers"), F.lit(2), F.lit(2)), as_rules(F.col("spreads"), F.lit(2), F.lit(2)), F.lit(2))
    usage = rule_usage(rows.select("series_id", w.alias("w")), ["series_id"], "w")
    head = covers.select(
        "series_id", "n_prior", F.col("reach")[0].alias("reach_1"), F.col("reach")[1].alias("reach_2"), "realized",
        F.col("support")[0].alias("support_1"), F.col("support")[1].alias("support_2"),
    )
    return rounded(
        usage.join(head, "series_id"), reach_1=6, reach_2=6, realized=6, mean_active_rules=6, rule_usage_entropy=6,
    )


def two_rule_usage(spark, folder):
    return _two_rules(spark, folder, EVT.slots)


def two_rule_usage_rounds(spark, folder):
    """The same without a length bound: every pick is one pass over all series together."""
    return _two_rules(spark, folder, None)


def sweep_candidates(spark, folder):
    return _sweep(spark, folder).candidates.drop(
        "coefficients", "base_std", "risk", "hard", "weight", "block_sse", "block_cost"
    )


def sweep_selected(spark, folder):
    return _sweep(spark, folder).selected(per_count=True)


def sweep_summary(spark, folder):
    sweep = _sweep(spark, folder)
    return develop.summaries(store(sweep.selected()), sweep.candidates)[0]


def sweep_radius_chain(spark, folder):
    return compare.radius_chain(_sweep(spark, folder).candidates)


def sweep_best_count(spark, folder):
    return develop.best_fixed_count(_sweep(spark, folder).selected(per_count=True))


def sweep_audit(spark, folder):
    sweep = _sweep(spark, folder)
    return sweep.audit(store(sweep.selected()))


def rule_report(spark, folder):
    case = _case(spark, folder, "simple")
    won = decide.family_winners(case.candidates.filter(F.col("family") == "dense_tsk"), "rmse_then_certificate")
    summary, _detail = develop.rule_report(case.lagged, won.join(case.scale, "series_id"), case.covers)
    return summary


def rule_detail(spark, folder):
    case = _case(spark, folder, "simple")
    won = decide.family_winners(case.candidates.filter(F.col("family") == "dense_tsk"), "rmse_then_certificate")
    return develop.rule_report(case.lagged, won.join(case.scale, "series_id"), case.covers)[1]


def study_simple_gate(spark, folder):
    case = _case(spark, folder, "simple")
    out = case.outcomes(case.decisions())
    return out.withColumn("selected_candidate_id", F.col("selected.candidate_id")).drop("selected")


def study_robust_gate(spark, folder):
    case = _case(spark, folder, "robust")
    out = case.outcomes(case.decisions())
    return out.withColumn("selected_candidate_id", F.col("selected.candidate_id")).drop("selected")


def study_family_results(spark, folder):
    return _case(spark, folder, "simple").family_results()


def study_family_summary(spark, folder):
    return compare.family_summary(_case(spark, folder, "simple").family_results())


def study_structures(spark, folder):
    got = _case(spark, folder, "simple").family_results()
    return compare.side_by_side(got, "fixed_k_dense_tsk", "dense_tsk", ["rule_count", "certificate", "test_rmse_clipped"])


def study_build_report(spark, folder):
    return _case(spark, folder, "simple").build_report()


def study_alignment(spark, folder):
    """Deployed forecasts against a panel with rows left out and values moved: exactly these do not match."""
    case = _case(spark, folder, "simple")
    moved = F.col("value_imputed") + F.when(F.col("step") % 5 == 0, 1.0).otherwise(0.0)
    panel = case.shifted.filter((F.col("role") == "test") & (F.col("step") % 11 != 0)).withColumn("actual", moved)
    return compare.misaligned(case.predictions(case.decisions()), panel)


def many_series_decisions(spark, folder):
    """Every supplier decided with the robust gate: the wide study."""
    prepared = prepare.by_ratio_panel(panels.supplier_week(spark, folder), SHIP.season, max_len=SHIP.slots)
    case = decide.Case(prepared, Grid(lags=(3, 6), radii=(1.0, 1.5, 2.5), ridge_alphas=(0.01, 1.0), max_rules=4), SHIP.season,
                       "robust", max_len=SHIP.slots)
    return case.decisions().drop("selected")


def ets_level(spark, folder):
    """Simple smoothing on the event hours: best weight in sample and its validation errors."""
    prepared = _evt(spark, folder).withColumn("series_id", F.col("series_id").cast("string"))
    got = smooth.forecast(prepared, smooth.ETS[:1], EVT.season, ("prior", "bound"), "validation", EVT.slots)
    actual = prepared.select("series_id", "step", F.col("value_imputed").alias("actual"))
    out = smooth.candidate_scores(got, actual).withColumn("alpha", F.get_json_object("spec_json", "$.alpha").cast("double"))
    return rounded(
        out.select("series_id", "candidate", "status", "n_train", "points", "alpha", "aic", "validation_rmse", "validation_mae", "validation_weighted_cost"),
        aic=5, validation_rmse=6, validation_mae=8, validation_weighted_cost=8,
    )


def _forms(spark, folder, plan):
    """All five smoothing forms on the event hours: best weights in sample and validation errors."""
    prepared = _evt(spark, folder).withColumn("series_id", F.col("series_id").cast("string"))
    got = plan(prepared, smooth.ETS, EVT.season, ("prior", "bound"), "validation")
    out = smooth.candidate_scores(got, prepared.select("series_id", "step", F.col("value_imputed").alias("actual")))
    weights = [F.get_json_object("spec_json", f"$.{n}").cast("double").alias(n) for n in ("alpha", "beta", "gamma", "phi")]
    return rounded(
        out.select("series_id", "candidate", "status", "n_train", "points", *weights, "aic", "bic", "validation_rmse", "validation_mae", "validation_weighted_cost"),
        aic=4, bic=4, validation_rmse=6, validation_mae=6, validation_weighted_cost=6,
    )


def ets_forms(spark, folder):
    return _forms(spark, folder, lambda *a: smooth.forecast(*a, EVT.slots))


def ets_forms_long(spark, folder):
    """The same without a length bound: chunks of 100 hours, their maps carried over the borders."""
    return _forms(spark, folder, lambda *a: smooth.forecast_long(*a, chunk=100))


def _ship(spark, folder):
    return prepare.by_ratio_panel(panels.ship_week(spark, folder), 13, max_len=SHIP.slots)


def smoothing_candidates(spark, folder):
    return smooth.benchmark(_ship(spark, folder), 13, SHIP.slots)[0]


def smoothing_summary(spark, folder):
    return smooth.benchmark(_ship(spark, folder), 13, SHIP.slots)[1]


def _nearest(a: str, z: str = "z") -> str:
    return f"(({z}1 - {a}1) ** 2 + ({z}2 - {a}2) ** 2) / 2"


def _moved(new: str, old: str) -> str:
    """Centers after one assignment and averaging; a center without rows stays."""
    return f"""
{new} AS (SELECT p.series_id, coalesce(avg(z1) FILTER (g1 <= g2), min(a1)) AS a1, coalesce(avg(z2) FILTER (g1 <= g2), min(a2)) AS a2,
  coalesce(avg(z1) FILTER (g1 > g2), min(b1)) AS b1, coalesce(avg(z2) FILTER (g1 > g2), min(b2)) AS b2
  FROM (SELECT zp.*, c.a1, c.a2, c.b1, c.b2, {_nearest("c.a")} AS g1, {_nearest("c.b")} AS g2 FROM zp JOIN {old} c ON c.series_id = zp.series_id) p GROUP BY 1)"""


TWO_RULES = _EVT + """,
x AS (SELECT * FROM (SELECT *, lag(value_scaled, 1) OVER w AS l1, lag(value_scaled, 2) OVER w AS l2 FROM p WINDOW w AS (PARTITION BY series_id ORDER BY step)) WHERE step >= 2),
sd AS (SELECT series_id, count(*) AS n, avg(l1) AS m1, avg(l2) AS m2, stddev_pop(l1) AS s1, stddev_pop(l2) AS s2 FROM x WHERE role = 'prior' GROUP BY 1),
zz AS (SELECT x.series_id, step, role, (l1 - m1) / s1 AS z1, (l2 - m2) / s2 AS z2, n FROM x JOIN sd ON sd.series_id = x.series_id),
zp AS (SELECT * FROM zz WHERE role = 'prior'),
p1 AS (SELECT series_id, z1 AS a1, z2 AS a2 FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY z1 * z1 + z2 * z2, step) AS rn FROM zp) WHERE rn = 1),
f1 AS (SELECT zp.*, a1, a2, """ + _nearest("a") + """ AS g FROM zp JOIN p1 ON p1.series_id = zp.series_id),
p2 AS (SELECT series_id, a1, a2, z1 AS b1, z2 AS b2, sqrt(g) AS reach_1 FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY g DESC, step) AS rn FROM f1) WHERE rn = 1),
r2 AS (SELECT f.series_id, sqrt(max(least(g, """ + _nearest("p2.b", "f.z") + """))) AS reach_2 FROM f1 f JOIN p2 ON p2.series_id = f.series_id GROUP BY 1),""" + _moved("k1", "p2") + "," + _moved("k2", "k1") + """,
fin AS (SELECT zp.*, c.a1, c.a2, c.b1, c.b2, """ + _nearest("c.a") + " AS g1, " + _nearest("c.b") + """ AS g2 FROM zp JOIN k2 c ON c.series_id = zp.series_id),
w AS (SELECT series_id, stddev_pop(z1) AS w1, stddev_pop(z2) AS w2 FROM zp GROUP BY 1),
sp AS (SELECT f.series_id, min(f.n) AS n_prior, min(a1) AS a1, min(a2) AS a2, min(b1) AS b1, min(b2) AS b2, sqrt(max(least(g1, g2))) AS realized,
  count(*) FILTER (g1 <= g2) AS support_1, count(*) FILTER (g1 > g2) AS support_2, min(w1) AS w1, min(w2) AS w2,
  stddev_pop(z1) FILTER (g1 <= g2) AS sa1, stddev_pop(z2) FILTER (g1 <= g2) AS sa2, stddev_pop(z1) FILTER (g1 > g2) AS sb1, stddev_pop(z2) FILTER (g1 > g2) AS sb2
  FROM fin f JOIN w ON w.series_id = f.series_id GROUP BY 1),
wd AS (SELECT *, """ + ", ".join(
    f"least(greatest(CASE WHEN support_{i} >= 2 AND s{r}{j} > 1e-12 THEN s{r}{j} ELSE w{j} END, 0.15), 3.0) AS t{r}{j}" for i, r in ((1, "a"), (2, "b")) for j in (1, 2)
) + """ FROM sp),
lw AS (SELECT z.series_id, -0.5 * (((z1 - a1) / ta1) ** 2 + ((z2 - a2) / ta2) ** 2) AS u, -0.5 * (((z1 - b1) / tb1) ** 2 + ((z2 - b2) / tb2) ** 2) AS v
  FROM zz z JOIN wd ON wd.series_id = z.series_id WHERE role IN ('bound', 'validation')),
fr AS (SELECT series_id, 1 / (1 + exp(v - u)) AS w1, 1 / (1 + exp(u - v)) AS w2 FROM lw),
us AS (SELECT series_id, count(*) FILTER (w1 >= w2) AS h1, count(*) FILTER (w1 < w2) AS h2, avg(w1) AS m1, avg(w2) AS m2,
  avg(CAST(w1 > 1e-8 AS INT) + CAST(w2 > 1e-8 AS INT)) AS act, max(CAST(w1 > 1e-8 AS INT) + CAST(w2 > 1e-8 AS INT)) AS top FROM fr GROUP BY 1)"""
_TWO_RULES = TWO_RULES + """
SELECT u.series_id, 2::BIGINT AS rule_count, CAST(h1 > 0 AS BIGINT) + CAST(h2 > 0 AS BIGINT) AS effective_rule_count, least(h1, h2) AS minimum_hard_rule_support,
 greatest(h1, h2) AS maximum_hard_rule_support, round(act, 6) AS mean_active_rules, top AS maximum_active_rules, round(-(m1 * ln(m1) + m2 * ln(m2)) / ln(2::DOUBLE), 6) AS rule_usage_entropy,
 n_prior, round(reach_1, 6) AS reach_1, round(reach_2, 6) AS reach_2, round(realized, 6) AS realized, support_1, support_2
FROM us u JOIN wd ON wd.series_id = u.series_id JOIN p2 ON p2.series_id = u.series_id JOIN r2 ON r2.series_id = u.series_id"""

_FORMS = _EVT + """,
fm AS (SELECT * FROM (VALUES ('ets_level', false, false, false), ('ets_holt', true, false, false), ('ets_damped_holt', true, false, true), ('ets_seasonal', false, true, false), ('ets_holt_winters', true, true, false)) AS v(candidate, tr, se, da)),
gw AS (SELECT candidate, tr, se, a AS alpha, b AS beta, g AS gamma, f AS phi FROM fm, (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS a), (SELECT unnest([0.0, 0.01, 0.05, 0.1, 0.3]::DOUBLE[]) AS b),
  (SELECT unnest([0.0, 0.01, 0.05, 0.1, 0.3]::DOUBLE[]) AS g), (SELECT unnest([0.8, 0.9, 0.98, 1.0]::DOUBLE[]) AS f) WHERE (b > 0) = tr AND (g > 0) = se AND (f < 1) = da),
iv AS (SELECT series_id, max(value_imputed) FILTER (step = 0) AS y0, max(value_imputed) FILTER (step = 1) AS y1, avg(value_imputed) FILTER (step < 24) AS m1, avg(value_imputed) FILTER (step >= 24) AS m2,
  list(value_imputed ORDER BY step) FILTER (step < 24) AS ys FROM p WHERE step < 48 GROUP BY 1),
rs(series_id, candidate, alpha, beta, gamma, phi, step, level, slope, cycle, f, y, role) AS (
  SELECT series_id, candidate, alpha, beta, gamma, phi, CASE WHEN se THEN 23 ELSE 0 END::BIGINT, CASE WHEN se THEN m1 ELSE y0 END, CASE WHEN NOT tr THEN 0 WHEN se THEN (m2 - m1) / 24 ELSE y1 - y0 END::DOUBLE,
    CASE WHEN se THEN list_transform(ys, lambda v: v - m1) ELSE [0.0::DOUBLE] END, NULL::DOUBLE, NULL::DOUBLE, 'none' FROM iv, gw
  UNION ALL
  SELECT series_id, candidate, alpha, beta, gamma, phi, step, level + phi * slope + alpha * (y - f), phi * slope + beta * (y - f), cycle[1 : slot - 1] || [cycle[slot] + gamma * (y - f)] || cycle[slot + 1 : len(cycle)], f, y, role
  FROM (SELECT r.series_id, candidate, alpha, beta, gamma, phi, p.step, level, slope, cycle, (p.step % len(cycle) + 1)::BIGINT AS slot, level + phi * slope + cycle[p.step % len(cycle) + 1] AS f, p.value_imputed AS y, p.role
    FROM rs r JOIN p ON p.series_id = r.series_id AND p.step = r.step + 1 AND p.role <> 'test')),
ss AS (SELECT series_id, candidate, alpha, beta, gamma, phi, sum((y - f) ** 2) AS sse, count(f) AS n FROM rs WHERE role IN ('prior', 'bound') GROUP BY ALL),
bs AS (SELECT *, CAST(alpha <> 0 AS INT) + CAST(beta <> 0 AS INT) + CAST(gamma <> 0 AS INT) + CAST(phi <> 0 AS INT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY series_id, candidate ORDER BY sse, alpha, beta, gamma, phi) AS rn FROM ss) WHERE rn = 1)
SELECT b.series_id, b.candidate, 'ok' AS status, b.n + CASE WHEN b.gamma > 0 THEN 24 ELSE 1 END AS n_train, count(*) AS points, b.alpha, b.beta, b.gamma, b.phi, round(min(b.n * ln(b.sse / b.n) + 2 * k), 4) AS aic, round(min(b.n * ln(b.sse / b.n) + k * ln(b.n)), 4) AS bic,
 round(sqrt(avg((y - f) ** 2)), 6) AS validation_rmse, round(avg(abs(y - f)), 6) AS validation_mae, round(avg(2 * greatest(y - f, 0) + greatest(f - y, 0)), 6) AS validation_weighted_cost
FROM bs b JOIN rs l ON l.series_id = b.series_id AND l.candidate = b.candidate AND l.alpha = b.alpha AND l.beta = b.beta AND l.gamma = b.gamma AND l.phi = b.phi AND l.role = 'validation'
GROUP BY b.series_id, b.candidate, b.n, b.sse, b.k, b.alpha, b.beta, b.gamma, b.phi"""

CHECKS = {
    "ets_forms": (ets_forms, _FORMS),
    "ets_forms_long": (ets_forms_long, _FORMS),
    "two_rule_usage": (two_rule_usage, _TWO_RULES),
    "two_rule_usage_rounds": (two_rule_usage_rounds, _TWO_RULES),
    "rule_covers": (rule_covers, None),
    "firing_usage": (firing_usage, None),
    "sweep_candidates": (sweep_candidates, None),
    "sweep_selected": (sweep_selected, None),
    "sweep_summary": (sweep_summary, None),
    "sweep_radius_chain": (sweep_radius_chain, None),
    "sweep_best_count": (sweep_best_count, None),
    "sweep_audit": (sweep_audit, None),
    "rule_report": (rule_report, None),
    "rule_detail": (rule_detail, None),
    "study_simple_gate": (study_simple_gate, None),
    "study_robust_gate": (study_robust_gate, None),
    "study_family_results": (study_family_results, None),
    "study_family_summary": (study_family_summary, None),
    "study_structures": (study_structures, None),
    "study_build_report": (study_build_report, None),
    "study_alignment": (study_alignment, "WITH " + sql.prepared(sql.EVT_HOUR, "evt_hour", 24) + """
SELECT CAST(series_id AS VARCHAR) AS series_id, step, value_imputed AS _a, CASE WHEN step % 11 <> 0 THEN value_imputed + 1 END AS _b
FROM p WHERE role = 'test' AND (step % 11 = 0 OR step % 5 = 0)"""),
    "many_series_decisions": (many_series_decisions, None),
    "ets_level": (ets_level, _EVT + """,
al AS (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS alpha),
lv(series_id, step, alpha, level, f, y, role) AS (
  SELECT series_id, step, alpha, value_imputed, NULL::DOUBLE, value_imputed, role FROM p, al WHERE step = 0
  UNION ALL SELECT p.series_id, p.step, l.alpha, l.level + l.alpha * (p.value_imputed - l.level), l.level, p.value_imputed, p.role
  FROM lv l JOIN p ON p.series_id = l.series_id AND p.step = l.step + 1 AND p.role <> 'test'),
ss AS (SELECT series_id, alpha, sum((y - f) ** 2) AS sse, count(f) AS n FROM lv WHERE role IN ('prior', 'bound') GROUP BY 1, 2),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY sse, alpha) AS rn FROM ss) WHERE rn = 1)
SELECT b.series_id, 'ets_level' AS candidate, 'ok' AS status, b.n + 1 AS n_train, count(*) AS points, b.alpha, round(min(b.n * ln(b.sse / b.n) + 4), 5) AS aic,
 round(sqrt(avg((y - f) ** 2)), 6) AS validation_rmse, round(avg(abs(y - f)), 8) AS validation_mae, round(avg(2 * greatest(y - f, 0) + greatest(f - y, 0)), 8) AS validation_weighted_cost
FROM bs b JOIN lv l ON l.series_id = b.series_id AND l.alpha = b.alpha AND l.role = 'validation' GROUP BY b.series_id, b.n, b.sse, b.alpha"""),
    "smoothing_candidates": (smoothing_candidates, None),
    "smoothing_summary": (smoothing_summary, None),
}
