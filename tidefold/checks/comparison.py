"""Registered queries: selection, run comparison, leaderboards, unions, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefold.checks.pools import CAPS, MODES, POOL_SQL, PREDICTIVE_SQL, picked, picked_sql, pool, predictive
from tidefold.checks.preparation import SEG
from tidefold.functions.text import digest, parse_boolean, parse_lags, plain_number, safe_name
from tidefold.operators import compare, quality, select
from tidefold.session import store
from tidefold.sources import panels


def rounded(df, **digits):
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


def candidate_pool(spark, folder):
    return pool(spark, folder)


def best_candidate(spark, folder):
    return picked(pool(spark, folder))


def best_per_key(spark, folder):
    """Every selection key on one pool: which candidate wins under each order."""
    p = store(
        pool(spark, folder).filter(F.col("status") == "PASS").withColumns(
            {
                "validation_rmse": F.col("rmse"), "validation_mae": F.col("mae"), "lag": F.col("lag_order"),
                "consequent_dimension": F.col("total_parameter_count"), "family": F.lit("shrunk_lag"),
                "validation_weighted_cost": F.round(1.5 * F.col("mae"), 4), "validation_rmse_clipped": F.col("rmse"),
                "certificate_untruncated": F.round(F.col("mae") / (F.col("rmse") + F.col("mae")), 6),
                "aic": F.round(F.col("rmse") + 2 * F.col("rule_count"), 4),
            }
        )
    )
    out = None
    for key in ("rmse", "certificate", "rmse_then_certificate", "cost", "smallest_radius", "cost_then_rmse"):
        names = select.KEYS[key] + (["radius", "ridge_alpha", "lag"] if key == "cost_then_rmse" else [])
        won = select.best(p, ["dataset", "series_id"], names).select(
            "dataset", "series_id", F.lit(key).alias("selection_key"), "lag_order", "radius", "ridge_alpha"
        )
        out = won if out is None else out.unionByName(won)
    return out


def relative_to_naive(spark, folder):
    p = store(pool(spark, folder))
    chosen = picked(p, caps=(4,), modes=("uncapped_only",))
    once = compare.relative_to_baseline(chosen, predictive(p))
    return rounded(
        compare.relative_to_baseline(once, predictive(p)).select(*compare.SERIES, "rmse", "naive_rmse", "relative_rmse_to_naive"),
        relative_rmse_to_naive=9,
    )


def _two_runs(spark, folder):
    p = store(pool(spark, folder))
    new = picked(p, caps=(4,), modes=("uncapped_only",))
    old = picked(p, caps=(4,), modes=("uncapped_only",), max_radius=1.0)
    return p, new, old


def run_compare(spark, folder):
    _p, new, old = _two_runs(spark, folder)
    return rounded(
        compare.compare_runs(new, old).select(
            *compare.SERIES, "selected_radius", "old_selected_radius", "lag_change", "radius_change", "alpha_change",
            "validation_rmse_change", "validation_mae_change", "rule_change", "parameter_change", "test_rmse_ratio_to_old",
            "test_mase_ratio_to_old", "selection_changed", "exact_validation_plateau", "radius_reduced_on_plateau",
        ),
        alpha_change=6, validation_rmse_change=4, validation_mae_change=4, test_rmse_ratio_to_old=9, test_mase_ratio_to_old=6,
    )


def selection_changes(spark, folder):
    _p, new, old = _two_runs(spark, folder)
    return rounded(
        compare.selection_changes(store(compare.compare_runs(new, old))),
        mean_old_radius=9, mean_new_radius=9, mean_old_rules=9, mean_new_rules=9, mean_test_rmse_ratio=9, median_test_rmse_ratio=9,
    )


def grid_extension(spark, folder):
    """Boundary summary and decision after widening the grid of one dataset; means are of decimals, so no order of rows shows in their ninth place."""
    p = store(pool(spark, folder))
    chosen = store(compare.analysis_rows(picked(p), "suppliers", "uncapped_only", 4))
    before = compare.analysis_rows(picked(p, max_radius=1.5), "suppliers", "uncapped_only", 4)
    summary = compare.boundary_summary(chosen, store(compare.compare_grids(chosen, before)), 2.0)
    out = compare.grid_decision(summary)
    return rounded(out, **{c: 9 for c, t in out.dtypes if t == "double"})


def value_distribution(spark, folder):
    chosen = compare.analysis_rows(picked(pool(spark, folder)), "suppliers", "uncapped_only", 4)
    return rounded(compare.value_distribution(chosen, 2.0), rate=9)


def nearest_lower_grid(spark, folder):
    p = store(pool(spark, folder))
    chosen = picked(p, caps=(4,), modes=("uncapped_only",))
    return rounded(
        compare.lower_neighbour(chosen, p, 2.0).select(
            *compare.SERIES, "selected_lag", "selected_radius", "previous_radius", "selected_validation_rmse", "previous_rmse",
            "rmse_improvement", "mae_improvement", "classification", "effective_upper_boundary",
        ),
        rmse_improvement=4, mae_improvement=4,
    )


def setting_summary(spark, folder):
    out = compare.setting_summary(store(picked(pool(spark, folder))))
    return rounded(out, **{c: 6 for c, t in out.dtypes if t == "double"})


def recommend_setting(spark, folder):
    out = compare.recommendation(compare.setting_summary(store(picked(pool(spark, folder)))))
    return rounded(out, **{c: 6 for c, t in out.dtypes if t == "double"})


def eligibility_audit(spark, folder):
    return compare.eligibility_audit(pool(spark, folder).withColumn("validation_source", F.lit("baseline_grid")))


def leaderboard(spark, folder):
    out = compare.leaderboard(store(predictive(pool(spark, folder))))
    return rounded(out, mean_rmse=7, median_rmse=6, mean_mase=9, average_rank=6)


def complete_series(spark, folder):
    return compare.complete_series(picked(pool(spark, folder)), CAPS, MODES)


def pool_union(spark, folder):
    """Replace one dataset of the pool by its extended run and count what each source brought."""
    p = store(pool(spark, folder))
    base = p.filter(F.col("radius") <= 1.0)
    merged = compare.consolidated_pool(base, {("real", "suppliers"): (p, None)})
    return merged.groupBy("dataset", "validation_source").agg(
        F.count("*").alias("candidates"), F.countDistinct("series_id").alias("series"), F.max("radius").alias("max_radius")
    )


def grid_union(spark, folder):
    p = store(pool(spark, folder))
    both = compare.union_grids(p.filter(F.col("radius") <= 1.0), p.filter(F.col("radius") > 1.0))
    return both.groupBy("dataset", "radius").agg(F.count("*").alias("candidates"), F.round(F.min("rmse"), 4).alias("best_rmse"))


def replaced_dataset(spark, folder):
    p = store(pool(spark, folder))
    old = picked(p, caps=(4,), modes=("uncapped_only",), max_radius=1.0)
    fresh = picked(p, caps=(4,), modes=("uncapped_only",)).filter(F.col("dataset") == "suppliers")
    # Series without a candidate on the small grid are not part of the old table.
    fresh = fresh.join(old.select(*compare.SERIES), compare.SERIES, "left_semi")
    return compare.replace_dataset(old, fresh, "suppliers").select(*compare.SERIES, "selected_radius", "rmse")


def _manifests(spark, folder):
    """Users and their statuses; those with errors or purchases count as used before."""
    users = panels.events(spark, folder, "user_id").join(
        panels.table(spark, folder, "events").select("event_id", "event_type"), "event_id"
    )
    per = users.groupBy("series_id").agg(
        F.count("*").alias("length"), F.round(F.sum("value"), 2).alias("total"),
        F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("purchases"),
    )
    return per.select(
        F.when(F.col("errors") > F.col("purchases"), "left").otherwise("right").alias("dataset"),
        F.col("series_id").cast("string").alias("series_id"), "length", "errors", "purchases",
        F.when(F.col("length") > 75, "rejected").otherwise("pass").alias("status"),
    )


def unused_series(spark, folder):
    full = store(_manifests(spark, folder))
    first, second = full.filter("errors >= 16"), full.filter("purchases >= 18")
    return compare.unused_series(select.accepted_if_any(full), first, second).select("dataset", "series_id", "length")


def key_overlap(spark, folder):
    full = store(_manifests(spark, folder))
    return compare.key_sets(full.filter("errors >= 14"), full.filter("purchases >= 14"))


def overlap_guard(spark, folder):
    """Fresh series against the used ones; some used ones are planted among the fresh and have to be found."""
    full = store(_manifests(spark, folder))
    used = full.filter("errors >= 16")
    return compare.overlap(compare.unused_series(full, used).unionByName(used.filter("purchases % 2 = 0")), used)


def hash_sample(spark, folder):
    counts = {"left": 3, "right": 4}
    return select.first_by_hash(_manifests(spark, folder), counts, "study-v2").select("dataset", "series_id", "selection_hash")


def hash_sample_lines(spark, folder):
    """Thousands of order lines of each return flag in hash order."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.col("l_returnflag").alias("dataset"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("series_id")
    )
    return select.first_by_hash(lines, {"A": 10_000, "N": 20_000, "R": 1_000}, "lines", strict=False)


def length_strata(spark, folder):
    return select.length_strata(_manifests(spark, folder), 3).select("dataset", "series_id", "length", "length_rank", "stratum")


def stratified_sample(spark, folder):
    return select.stratified_sample(_manifests(spark, folder), 10, 42).select("dataset", "series_id", "stratum")


def reconcile_counts(spark, folder):
    p = store(pool(spark, folder))
    expected = p.select("dataset", "series_id").distinct().groupBy("dataset").agg((F.count("*") * 36).alias("expected"))
    return quality.reconcile_counts(p, ["dataset"], expected)


def selection_lock(spark, folder):
    chosen = picked(pool(spark, folder), caps=(4,), modes=("uncapped_only",)).withColumns(
        {"model": F.lit("shrunk_lag"), "tie_break_policy": F.lit("smallest_radius")}
    )
    return quality.without_test_columns(compare.selection_lock(chosen))


def final_audit(spark, folder):
    chosen = picked(pool(spark, folder), caps=(4,), modes=("unconstrained",)).withColumns(
        {"model": F.lit("sparse_tsk"), "tie_break_policy": F.lit("smallest_radius"), "smape": F.col("mase")}
    )
    return compare.final_issues(chosen, 100)


def text_functions(spark, folder):
    """Parsing and naming functions over the part and supplier texts."""
    part = panels.table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    lags = F.concat_ws("|", (F.col("p_size") % 7 + 1).cast("string"), F.lit("5"), (F.col("p_size") % 3 + 1).cast("string"))
    return part.select(
        "p_partkey", F.concat_ws(",", parse_lags(lags)).alias("lags"), safe_name(F.concat(F.lit("."), "p_name", F.lit(" #"), "p_brand", F.lit("_"))).alias("safe"),
        parse_boolean(F.when(F.col("p_size") % 2 == 0, " Yes ").otherwise("0")).alias("flag"),
        digest(F.lit("ns"), F.col("p_brand"), F.col("p_partkey")).alias("score"),
        plain_number(F.col("p_size") / 8.0).alias("eighths"),
    )


_P = "WITH " + POOL_SQL
_TWO = _P + "," + picked_sql("new", (4,), ("uncapped_only",)) + "," + picked_sql("old", (4,), ("uncapped_only",), 1.0)
_CMP = _TWO + """,
cmp AS (SELECT n.*, o.selected_radius AS old_selected_radius, o.rule_count AS old_rule_count,
  n.selected_lag - o.selected_lag AS lag_change, n.selected_radius - o.selected_radius AS radius_change,
  n.selected_ridge_alpha - o.selected_ridge_alpha AS alpha_change, n.selected_validation_rmse - o.selected_validation_rmse AS validation_rmse_change,
  n.selected_validation_mae - o.selected_validation_mae AS validation_mae_change, n.rule_count - o.rule_count AS rule_change,
  n.total_parameter_count - o.total_parameter_count AS parameter_change, n.rmse / o.rmse AS test_rmse_ratio_to_old, n.mase / o.mase AS test_mase_ratio_to_old,
  n.selected_lag IS DISTINCT FROM o.selected_lag OR n.selected_radius IS DISTINCT FROM o.selected_radius OR n.selected_ridge_alpha IS DISTINCT FROM o.selected_ridge_alpha AS selection_changed,
  coalesce(abs(n.selected_validation_rmse - o.selected_validation_rmse) <= 1e-12, false) AND coalesce(abs(n.selected_validation_mae - o.selected_validation_mae) <= 1e-12, o.series_id IS NULL)
   AND coalesce(n.rule_count = o.rule_count, false) AND coalesce(n.total_parameter_count = o.total_parameter_count, false) AS exact_validation_plateau
  FROM new n LEFT JOIN old o ON n.dataset = o.dataset AND n.series_id = o.series_id)"""
_ALL = _P + "," + picked_sql("res")
_MAN = """WITH per AS (SELECT user_id, count(*) AS length, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY 1),
man AS (SELECT CASE WHEN errors > purchases THEN 'left' ELSE 'right' END AS dataset, CAST(user_id AS VARCHAR) AS series_id, length, errors, purchases,
  CASE WHEN length > 75 THEN 'rejected' ELSE 'pass' END AS status FROM per)"""
_STRATA = _MAN + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY length, series_id) AS length_rank, count(*) OVER (PARTITION BY dataset) AS n FROM man),
st AS (SELECT *, CAST(greatest(ceil((length_rank - 1) * least(3, n)::DOUBLE / greatest(n - 1, 1)) - 1, 0) AS INTEGER) AS stratum FROM rk)"""
_ORDERS = {
    "rmse": "rmse, mae, total_parameter_count, rule_count, radius, ridge_alpha, lag_order",
    "certificate": "cert, rmse, mae, total_parameter_count, rule_count, radius, ridge_alpha, lag_order",
    "rmse_then_certificate": "rmse, cert, total_parameter_count, rule_count, radius, ridge_alpha, lag_order",
    "cost": "cost, rmse, cert, total_parameter_count, rule_count, radius, ridge_alpha, lag_order",
    "smallest_radius": "rmse, mae, total_parameter_count, rule_count, radius, ridge_alpha, lag_order",
    "cost_then_rmse": "cost, rmse, aic, radius, ridge_alpha, lag_order",
}
_SETTING = _ALL + """,
setting AS (SELECT source, dataset, max_rules, selection_mode, count(*) AS series, count(*) AS pass_count, 0::BIGINT AS failure_count, 0.0::DOUBLE AS failure_rate,
  count(*) FILTER (radius_cap_reached) AS selected_cap_count, count(*) FILTER (radius_cap_reached) / count(*) AS selected_cap_rate,
  avg(rmse) AS mean_rmse, median(rmse) AS median_rmse, avg(mase) AS mean_mase, median(mase) AS median_mase, avg(rule_count) AS mean_rule_count,
  median(rule_count) AS median_rule_count, avg(total_parameter_count) AS mean_total_parameters, median(total_parameter_count) AS median_total_parameters
  FROM res GROUP BY ALL)"""
_SETTING_COLS = "selected_cap_rate mean_rmse median_rmse mean_mase median_mase mean_rule_count median_rule_count mean_total_parameters median_total_parameters".split()

CHECKS = {
    "candidate_pool": (candidate_pool, _P + " SELECT * FROM pool"),
    "best_candidate": (best_candidate, _ALL + " SELECT * FROM res"),
    "best_per_key": (best_per_key, _P + """,
k AS (SELECT *, round(1.5 * mae, 4) AS cost, round(mae / (rmse + mae), 6) AS cert, round(rmse + 2 * rule_count, 4) AS aic FROM pool WHERE status = 'PASS')
""" + " UNION ALL ".join(f"""SELECT dataset, series_id, '{k}' AS selection_key, lag_order, radius, ridge_alpha FROM
 (SELECT *, row_number() OVER (PARTITION BY dataset, series_id ORDER BY {o}) AS rn FROM k) WHERE rn = 1""" for k, o in _ORDERS.items())),
    "relative_to_naive": (relative_to_naive, _P + "," + picked_sql("res", (4,), ("uncapped_only",)) + "," + PREDICTIVE_SQL + """
SELECT r.source, r.dataset, r.series_id, r.rmse, p.rmse AS naive_rmse, round(r.rmse / p.rmse, 9) AS relative_rmse_to_naive
FROM res r LEFT JOIN predictive p ON r.dataset = p.dataset AND r.series_id = p.series_id AND p.model = 'naive'"""),
    "run_compare": (run_compare, _CMP + """
SELECT source, dataset, series_id, selected_radius, old_selected_radius, lag_change, radius_change, round(alpha_change, 6) AS alpha_change,
 round(validation_rmse_change, 4) AS validation_rmse_change, round(validation_mae_change, 4) AS validation_mae_change, rule_change, parameter_change,
 round(test_rmse_ratio_to_old, 9) AS test_rmse_ratio_to_old, round(test_mase_ratio_to_old, 6) AS test_mase_ratio_to_old, selection_changed,
 exact_validation_plateau, selection_changed AND coalesce(radius_change < 0, false) AND exact_validation_plateau AS radius_reduced_on_plateau FROM cmp"""),
    "selection_changes": (selection_changes, _CMP + """
SELECT source, dataset, count(DISTINCT series_id) AS series, count(*) FILTER (selection_changed) AS changed_selections, count(*) FILTER (radius_change < 0) AS reduced_radius,
 count(*) FILTER (radius_change > 0) AS increased_radius, count(*) FILTER (selection_changed AND radius_change < 0 AND exact_validation_plateau) AS plateau_radius_reductions,
 round(avg(old_selected_radius), 9) AS mean_old_radius, round(avg(selected_radius), 9) AS mean_new_radius, round(avg(old_rule_count), 9) AS mean_old_rules,
 round(avg(rule_count), 9) AS mean_new_rules, round(avg(test_rmse_ratio_to_old), 9) AS mean_test_rmse_ratio, round(median(test_rmse_ratio_to_old), 9) AS median_test_rmse_ratio
FROM cmp GROUP BY 1, 2"""),
    "grid_extension": (grid_extension, _ALL + "," + picked_sql("prev", max_radius=1.5) + """,
a AS (SELECT * FROM res WHERE dataset = 'suppliers' AND selection_mode = 'uncapped_only' AND max_rules = 4),
b AS (SELECT * FROM prev WHERE dataset = 'suppliers' AND selection_mode = 'uncapped_only' AND max_rules = 4),
r AS (SELECT a.rmse / b.rmse AS q FROM a LEFT JOIN b ON a.series_id = b.series_id),
s AS (SELECT count(*) AS series, count(*) AS pass_count, 0::BIGINT AS failure_count, 0.0::DOUBLE AS failure_rate, count(*) FILTER (selected_radius = 2.0) AS upper_boundary_count,
  count(*) FILTER (selected_radius = 2.0) / count(*) AS upper_boundary_rate, count(*) FILTER (radius_cap_reached) AS selected_cap_count,
  count(*) FILTER (radius_cap_reached) / count(*) AS selected_cap_rate, avg(selected_radius) AS mean_selected_radius, median(selected_radius) AS median_selected_radius,
  sum(rmse::DECIMAL(28, 9))::DOUBLE / count(rmse) AS mean_rmse, median(rmse) AS median_rmse, sum(mase::DECIMAL(28, 9))::DOUBLE / count(mase) AS mean_mase, median(mase) AS median_mase, avg(rule_count) AS mean_rule_count, median(rule_count) AS median_rule_count,
  avg(total_parameter_count) AS mean_total_parameters, (SELECT count(q) FROM r) AS matched_previous_series, (SELECT sum(q::DECIMAL(28, 12))::DOUBLE / count(q) FROM r) AS mean_rmse_ratio_to_previous,
  (SELECT median(q) FROM r) AS median_rmse_ratio_to_previous, 2.0::DOUBLE AS maximum_radius FROM a),
d AS (SELECT *, upper_boundary_rate <= 0.05 AS boundary_ok, failure_rate <= 0 AS failures_ok, selected_cap_rate <= 0 AS caps_ok,
  mean_rmse_ratio_to_previous - 1 AS mean_rmse_penalty_vs_previous, mean_rmse_ratio_to_previous - 1 <= 0 AS performance_ok FROM s),
g AS (SELECT *, boundary_ok AND failures_ok AND caps_ok AND performance_ok AS grid_sufficient FROM d)
SELECT series, pass_count, failure_count, upper_boundary_count, selected_cap_count, matched_previous_series, boundary_ok, failures_ok, caps_ok, performance_ok, grid_sufficient,
 """ + ", ".join(f"round({c}, 9) AS {c}" for c in "failure_rate upper_boundary_rate selected_cap_rate mean_selected_radius median_selected_radius mean_rmse median_rmse mean_mase median_mase mean_rule_count median_rule_count mean_total_parameters mean_rmse_ratio_to_previous median_rmse_ratio_to_previous maximum_radius mean_rmse_penalty_vs_previous".split()) + """,
 CASE WHEN grid_sufficient THEN 'ACCEPT_RADIUS_GRID' ELSE 'EXTEND_RADIUS_GRID' END AS decision,
 CASE WHEN grid_sufficient THEN maximum_radius ELSE maximum_radius + 1.0 END AS suggested_next_maximum_radius FROM g"""),
    "value_distribution": (value_distribution, _ALL + """
SELECT selected_radius, count(DISTINCT series_id) AS series, round(count(DISTINCT series_id) / sum(count(DISTINCT series_id)) OVER (), 9) AS rate, selected_radius = 2.0 AS at_upper_boundary
FROM res WHERE dataset = 'suppliers' AND selection_mode = 'uncapped_only' AND max_rules = 4 GROUP BY 1"""),
    "nearest_lower_grid": (nearest_lower_grid, _P + "," + picked_sql("res", (4,), ("uncapped_only",)) + """,
low AS (SELECT *, row_number() OVER (PARTITION BY dataset, series_id, lag_order, ridge_alpha ORDER BY radius DESC, rmse, mae) AS rn FROM pool WHERE status = 'PASS' AND NOT radius_cap_reached AND radius < 2.0),
j AS (SELECT r.*, l.radius AS previous_radius, l.rmse AS previous_rmse, l.rmse - r.selected_validation_rmse AS ri, l.mae - r.selected_validation_mae AS mi,
  l.total_parameter_count AS lp, l.rule_count AS lr
  FROM res r LEFT JOIN low l ON l.rn = 1 AND l.dataset = r.dataset AND l.series_id = r.series_id AND l.lag_order = r.selected_lag AND l.ridge_alpha = r.selected_ridge_alpha WHERE r.selected_radius = 2.0),
c AS (SELECT *, CASE WHEN previous_radius IS NULL THEN 'unresolved_missing_lower_comparator' WHEN ri > 1e-10 THEN 'true_rmse_improvement'
  WHEN abs(ri) <= 1e-10 AND mi > 1e-10 THEN 'mae_improvement_on_rmse_tie' WHEN abs(ri) <= 1e-10 AND abs(mi) <= 1e-10 AND (total_parameter_count < lp OR rule_count < lr) THEN 'complexity_reduction_on_performance_tie'
  WHEN abs(ri) <= 1e-10 AND abs(mi) <= 1e-10 AND total_parameter_count = lp AND rule_count = lr THEN 'exact_plateau' ELSE 'other_boundary_selection' END AS classification FROM j)
SELECT source, dataset, series_id, selected_lag, selected_radius, previous_radius, selected_validation_rmse, previous_rmse, round(ri, 4) AS rmse_improvement, round(mi, 4) AS mae_improvement,
 classification, classification NOT IN ('complexity_reduction_on_performance_tie', 'exact_plateau') AS effective_upper_boundary FROM c"""),
    "setting_summary": (setting_summary, _SETTING + "\nSELECT * EXCLUDE (" + ", ".join(_SETTING_COLS) + "), " + ", ".join(f"round({c}, 6) AS {c}" for c in _SETTING_COLS) + " FROM setting"),
    "recommend_setting": (recommend_setting, _SETTING + """,
m AS (SELECT coalesce(a.max_rules, b.max_rules) AS max_rules, coalesce(a.dataset, b.dataset) AS dataset, a.selected_cap_rate AS cap, b.failure_rate AS fail,
  b.mean_rmse / a.mean_rmse - 1 AS pen, b.mean_rule_count AS rc, b.mean_total_parameters AS tp
  FROM (SELECT * FROM setting WHERE selection_mode = 'unconstrained') a FULL JOIN (SELECT * FROM setting WHERE selection_mode = 'uncapped_only') b ON a.dataset = b.dataset AND a.max_rules = b.max_rules),
g AS (SELECT max_rules, count(DISTINCT dataset) AS datasets, max(cap) AS c, max(fail) AS f, max(pen) AS p, avg(rc) AS rc, avg(tp) AS tp FROM m GROUP BY 1),
h AS (SELECT *, coalesce(c <= 0.10 AND f <= 0 AND p <= 0.02, false) AS acceptable FROM g)
SELECT max_rules, datasets, round(c, 6) AS max_dataset_natural_selected_cap_rate, round(f, 6) AS max_dataset_uncapped_failure_rate, round(p, 6) AS max_dataset_uncapped_rmse_penalty,
 round(rc, 6) AS mean_uncapped_rule_count, round(tp, 6) AS mean_uncapped_total_parameters, acceptable,
 coalesce(max_rules = min(CASE WHEN acceptable THEN max_rules END) OVER (), false) AS recommended FROM h"""),
    "eligibility_audit": (eligibility_audit, _P + """
SELECT source, dataset, series_id, count(*) AS validation_candidates, count(*) FILTER (status = 'PASS') AS pass_candidates, count(*) FILTER (status = 'PASS' AND radius_cap_reached) AS capped_pass_candidates,
 count(*) FILTER (status = 'PASS' AND NOT radius_cap_reached) AS uncapped_pass_candidates, max(radius) AS maximum_candidate_radius, 1::BIGINT AS validation_source_count,
 count(*) FILTER (status = 'PASS' AND NOT radius_cap_reached) > 0 AS has_uncapped_candidate FROM pool GROUP BY ALL"""),
    "leaderboard": (leaderboard, _P + "," + PREDICTIVE_SQL + """,
r AS (SELECT *, rank() OVER (PARTITION BY dataset, series_id ORDER BY rmse) + (count(*) OVER (PARTITION BY dataset, series_id, rmse) - 1) / 2.0 AS rk FROM predictive)
SELECT source, dataset, model, count(DISTINCT series_id) AS series, round(avg(rmse), 7) AS mean_rmse, round(median(rmse), 6) AS median_rmse, round(avg(mase), 9) AS mean_mase,
 round(avg(rk)::DOUBLE, 6) AS average_rank FROM r GROUP BY 1, 2, 3"""),
    "complete_series": (complete_series, _ALL + " SELECT source, dataset, series_id FROM res GROUP BY ALL HAVING count(DISTINCT (max_rules, selection_mode)) = 4"),
    "pool_union": (pool_union, _P + """
SELECT dataset, CASE WHEN dataset = 'suppliers' THEN 'suppliers_extension' ELSE 'baseline_grid' END AS validation_source, count(*) AS candidates, count(DISTINCT series_id) AS series, max(radius) AS max_radius
FROM pool WHERE dataset = 'suppliers' OR radius <= 1.0 GROUP BY 1, 2"""),
    "grid_union": (grid_union, _P + " SELECT dataset, radius, count(*) AS candidates, round(min(rmse), 4) AS best_rmse FROM pool GROUP BY 1, 2"),
    "replaced_dataset": (replaced_dataset, _TWO + """
SELECT source, dataset, series_id, selected_radius, rmse FROM old WHERE dataset <> 'suppliers' UNION ALL
SELECT source, dataset, series_id, selected_radius, rmse FROM new n WHERE dataset = 'suppliers' AND EXISTS (SELECT 1 FROM old o WHERE o.dataset = n.dataset AND o.series_id = n.series_id)"""),
    "unused_series": (unused_series, _MAN + """
SELECT dataset, series_id, length FROM man WHERE status = 'pass' AND errors < 16 AND purchases < 18"""),
    "key_overlap": (key_overlap, _MAN + """
SELECT dataset, count(*) FILTER (a OR b) AS in_either, count(*) FILTER (a AND b) AS in_both, count(*) FILTER (a AND NOT b) AS left_only, count(*) FILTER (b AND NOT a) AS right_only
FROM (SELECT dataset, errors >= 14 AS a, purchases >= 14 AS b FROM man) WHERE a OR b GROUP BY 1"""),
    "overlap_guard": (overlap_guard, _MAN + " SELECT DISTINCT dataset, series_id FROM man WHERE errors >= 16 AND purchases % 2 = 0"),
    "hash_sample": (hash_sample, _MAN + """,
h AS (SELECT dataset, series_id, sha256('study-v2|' || dataset || '|' || series_id) AS selection_hash FROM man)
SELECT dataset, series_id, selection_hash FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY selection_hash, series_id) AS rn FROM h)
WHERE rn <= CASE dataset WHEN 'left' THEN 3 ELSE 4 END"""),
    "hash_sample_lines": (hash_sample_lines, """
WITH h AS (SELECT l_returnflag AS dataset, l_orderkey || '-' || l_linenumber AS series_id, sha256('lines|' || l_returnflag || '|' || l_orderkey || '-' || l_linenumber) AS selection_hash FROM lineitem)
SELECT dataset, series_id, selection_hash FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY selection_hash, series_id) AS rn FROM h)
WHERE rn <= CASE dataset WHEN 'A' THEN 10000 WHEN 'N' THEN 20000 WHEN 'R' THEN 1000 END"""),
    "length_strata": (length_strata, _STRATA + " SELECT dataset, series_id, length, length_rank, stratum FROM st"),
    "stratified_sample": (stratified_sample, _STRATA + """,
h AS (SELECT *, sha256('42|' || dataset || '|' || series_id) AS hsh FROM st),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, stratum ORDER BY hsh, series_id) <= 10 // least(3, n) + CAST(stratum < 10 % least(3, n) AS INT) AS early FROM h)
SELECT dataset, series_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY early DESC, hsh, series_id) AS place FROM r) WHERE place <= 10"""),
    "reconcile_counts": (reconcile_counts, _P + " SELECT dataset, count(*) AS found, count(DISTINCT series_id) * 36 AS expected, count(*) = count(DISTINCT series_id) * 36 AS matches FROM pool GROUP BY 1"),
    "selection_lock": (selection_lock, _P + "," + picked_sql("res", (4,), ("uncapped_only",)) + """
SELECT source, dataset, series_id, 'shrunk_lag' AS model, selection_mode, 'smallest_radius' AS tie_break_policy, selected_lag, selected_radius, selected_ridge_alpha, rule_count, radius_cap_reached,
 total_parameter_count, sha256(concat_ws('|', source, dataset, series_id, selected_lag, printf('%.12g', selected_radius), printf('%.12g', selected_ridge_alpha), rule_count, total_parameter_count)) AS frozen_model_id,
 true AS frozen, 'exploratory_development_only' AS certificate_status FROM res"""),
    "final_audit": (final_audit, _P + "," + picked_sql("res", (4,), ("unconstrained",)) + """,
c AS (SELECT abs(count(*) - 100) AS row_count, count(*) FILTER (radius_cap_reached) AS capped_selections, count(*) FILTER (selection_mode <> 'uncapped_only') AS wrong_mode FROM res)
SELECT issue, count FROM (SELECT 'row_count' AS issue, row_count AS count FROM c UNION ALL SELECT 'capped_selections', capped_selections FROM c UNION ALL SELECT 'wrong_mode', wrong_mode FROM c) WHERE count > 0"""),
    "text_functions": (text_functions, """
SELECT p_partkey, array_to_string(list_sort(list_distinct([p_size % 7 + 1, 5, p_size % 3 + 1])), ',') AS lags,
 trim(regexp_replace('.' || p_name || ' #' || p_brand || '_', '[^\\p{L}\\p{N}\\-_.]', '_', 'g'), '._') AS safe, p_size % 2 = 0 AS flag,
 sha256('ns|' || p_brand || '|' || p_partkey) AS score, printf('%.8g', p_size / 8.0) AS eighths FROM part"""),
}
