"""Candidate pools, selections and forecasts computed from the weekly panels.

A candidate here is a shrunk and clipped lag forecast: z(t) is forecast by
(1 - alpha) * z(t - lag), clipped to [-radius, radius]. It gives every selection
and comparison operator a real pool that SQL can build too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.checks import sql
from tidefold.operators.lags import with_lags
from tidefold.operators.ordered import per_group
from tidefold.operators.select import best, usable
from tidefold.plans.prepare import by_ratio_panel
from tidefold.session import spread_keys
from tidefold.sources import panels

LAGS = (1, 2, 4)
RADII = (0.5, 1.0, 1.5, 2.0)
ALPHAS = (0.1, 0.3, 0.6)
CAPS = (2, 4)
MODES = ("unconstrained", "uncapped_only")
DATASETS = {
    "segments": (panels.seg_week, panels.ORDER_WEEKS.slots, sql.SEG_WEEK, "seg_week"),
    "suppliers": (panels.supplier_week, panels.SHIP_WEEKS.slots, sql.SUPPLIER_WEEK, "supplier_week"),
}


def lagged(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for name, (build, slots, _sql, _table) in DATASETS.items():
        # Few bytes become much work below: whole series are dealt out once, and every window and sum stays where its series is.
        prepared = by_ratio_panel(spread_keys(build(spark, folder), "series_id"), 52, max_len=slots)
        rows = with_lags(prepared, max(LAGS), max_len=slots)
        # In-sample mean step of the series, in the same shuffle as the lags.
        step = F.when(F.col("role").isin("prior", "bound"), F.abs(F.col("value_scaled") - F.col("features")[0]))
        rows = per_group(rows, {"_step": F.avg(step)}, max_len=slots).select(
            F.lit("real").alias("source"), F.lit(name).alias("dataset"), F.col("series_id").cast("string").alias("series_id"),
            "step", "role", F.col("value_scaled").alias("z"), "features", "scaler_scale", "role_step", "role_size",
            (F.col("scaler_scale") * F.col("_step")).alias("mase_scale"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def pool(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    rows = lagged(spark, folder) if rows is None else rows
    combos = F.array(
        *[F.struct(F.lit(p).alias("lag_order"), F.lit(r).alias("radius"), F.lit(a).alias("ridge_alpha"))
          for p in LAGS for r in RADII for a in ALPHAS]
    )
    # A series lies in one task, so its partial sums are the sums: 36 rows of it are moved, whatever its length.
    spread = rows.filter(F.col("role").isin("validation", "test")).select("*", F.inline(combos))
    raw = (1 - F.col("ridge_alpha")) * F.get("features", F.col("lag_order") - 1)
    cut = F.least(F.greatest(raw, -F.col("radius")), F.col("radius"))
    err = F.col("scaler_scale") * (F.col("z") - cut)
    val, test = F.col("role") == "validation", F.col("role") == "test"
    stats = spread.withColumns({"_e": err, "_cut": (F.abs(raw) > F.col("radius")).cast("double")}).groupBy(
        "source", "dataset", "series_id", "lag_order", "radius", "ridge_alpha"
    ).agg(
        F.round(F.sqrt(F.avg(F.when(val, F.col("_e") * F.col("_e")))), 4).alias("rmse"),
        F.round(F.avg(F.when(val, F.abs("_e"))), 4).alias("mae"),
        F.round(F.sqrt(F.avg(F.when(test, F.col("_e") * F.col("_e")))), 4).alias("test_rmse"),
        F.round(F.avg(F.when(test, F.abs("_e"))), 4).alias("test_mae"),
        (F.avg(F.when(val, F.col("_cut"))) > 0.25).alias("radius_cap_reached"),
        F.first("scaler_scale").alias("_scale"), F.first("mase_scale").alias("mase_scale"),
    )
    return stats.select(
        "source", "dataset", "series_id", "lag_order", "radius", "ridge_alpha",
        F.when(F.col("rmse") <= 1.75 * F.col("_scale"), "PASS").otherwise("FAIL").alias("status"),
        "radius_cap_reached", "rmse", "mae", "test_rmse", "test_mae",
        F.round(F.col("test_mae") / F.col("mase_scale"), 6).alias("test_mase"),
        F.col("lag_order").alias("rule_count"), (F.col("lag_order") * (3 * F.col("lag_order") + 1)).alias("total_parameter_count"),
    )


def picked(candidates: DataFrame, caps=CAPS, modes=MODES, max_radius: float = 9.0) -> DataFrame:
    """Selected candidate per series, rule cap and mode, with its test errors."""
    # One pass: each candidate is offered to every rule cap and mode that admits it.
    rows = usable(candidates.filter(F.col("radius") <= max_radius), True, ("rmse", "mae"))
    offers = F.array(
        *[F.struct(F.lit(c).alias("max_rules"), F.lit(mode).alias("selection_mode")) for c in caps for mode in modes]
    )
    admitted = rows.select("*", F.inline(offers)).filter(
        (F.col("rule_count") <= F.col("max_rules"))
        & ((F.col("selection_mode") == "unconstrained") | ~F.col("radius_cap_reached"))
    )
    out = best(admitted, ["source", "dataset", "series_id", "max_rules", "selection_mode"], "smallest_radius")
    return out.select(
        "source", "dataset", "series_id", "max_rules", "selection_mode", F.lit("PASS").alias("status"),
        F.col("lag_order").alias("selected_lag"), F.col("radius").alias("selected_radius"),
        F.col("ridge_alpha").alias("selected_ridge_alpha"), F.col("rmse").alias("selected_validation_rmse"),
        F.col("mae").alias("selected_validation_mae"), "rule_count", "total_parameter_count", "radius_cap_reached",
        F.col("test_rmse").alias("rmse"), F.col("test_mae").alias("mae"), F.col("test_mase").alias("mase"),
    )


def predictive(candidates: DataFrame) -> DataFrame:
    """Test errors of a few fixed models per series."""
    wide = F.col("radius") == max(RADII)
    names = {"naive": (1, 0.1), "lag_2": (2, 0.1), "lag_4": (4, 0.1), "shrunk": (1, 0.6)}
    label = F.lit(None).cast("string")
    for name, (lag, alpha) in names.items():
        label = F.when(wide & (F.col("lag_order") == lag) & (F.col("ridge_alpha") == alpha), name).otherwise(label)
    return candidates.withColumn("model", label).filter(F.col("model").isNotNull()).select(
        "source", "dataset", "series_id", "model", F.lit("PASS").alias("status"),
        F.col("test_rmse").alias("rmse"), F.col("test_mase").alias("mase"),
    )


# --- the same in SQL ---------------------------------------------------------------------


def _rows(dataset: str) -> str:
    _build, _slots, panel, table = DATASETS[dataset]
    lags = ", ".join(f"lag(value_scaled, {p}) OVER w AS l{p}" for p in range(1, max(LAGS) + 1))
    tag = dataset[:3]
    body = ",".join([panel, sql.imputed(table, 52), sql.roles(f"{table}_i", f"pr_{tag}"), sql.scaled(f"pr_{tag}", f"p_{tag}")])
    return body + f""",
rows_{tag} AS (SELECT 'real' AS source, '{dataset}' AS dataset, CAST(series_id AS VARCHAR) AS series_id, step, role, role_step, role_size, value_scaled AS z, scaler_scale, l1, l2, l4
  FROM (SELECT *, {lags} FROM p_{tag} WINDOW w AS (PARTITION BY series_id ORDER BY step)) WHERE step >= {max(LAGS)})"""


ROWS_SQL = ",".join(_rows(d) for d in DATASETS) + """,
lrows AS (SELECT * FROM rows_seg UNION ALL SELECT * FROM rows_sup)"""

POOL_SQL = ROWS_SQL + f""",
spread AS (
  SELECT r.*, g.lag_order, rr.radius, aa.ridge_alpha,
    (1 - aa.ridge_alpha) * CASE g.lag_order WHEN 1 THEN l1 WHEN 2 THEN l2 ELSE l4 END AS raw
  FROM lrows r, (SELECT unnest([{', '.join(map(str, LAGS))}]) AS lag_order) g,
       (SELECT unnest([{', '.join(f'{r}::DOUBLE' for r in RADII)}]) AS radius) rr,
       (SELECT unnest([{', '.join(f'{a}::DOUBLE' for a in ALPHAS)}]) AS ridge_alpha) aa
  WHERE role IN ('validation', 'test')),
stats AS (
  SELECT source, dataset, series_id, lag_order, radius, ridge_alpha,
    round(sqrt(avg(e * e) FILTER (role = 'validation')), 4) AS rmse, round(avg(abs(e)) FILTER (role = 'validation'), 4) AS mae,
    round(sqrt(avg(e * e) FILTER (role = 'test')), 4) AS test_rmse, round(avg(abs(e)) FILTER (role = 'test'), 4) AS test_mae,
    avg(CASE WHEN abs(raw) > radius THEN 1.0::DOUBLE ELSE 0 END) FILTER (role = 'validation') > 0.25 AS radius_cap_reached, min(scaler_scale) AS scale
  FROM (SELECT *, scaler_scale * (z - least(greatest(raw, -radius), radius)) AS e FROM spread) GROUP BY ALL),
gaps AS (SELECT source, dataset, series_id, min(scaler_scale) * avg(abs(z - l1)) AS mase_scale FROM lrows WHERE role IN ('prior', 'bound') GROUP BY ALL),
pool AS (
  SELECT s.source, s.dataset, s.series_id, lag_order, radius, ridge_alpha, CASE WHEN rmse <= 1.75::DOUBLE * scale THEN 'PASS' ELSE 'FAIL' END AS status,
    radius_cap_reached, rmse, mae, test_rmse, test_mae, round(test_mae / mase_scale, 6) AS test_mase,
    lag_order AS rule_count, lag_order * (3 * lag_order + 1) AS total_parameter_count
  FROM stats s JOIN gaps g ON s.source = g.source AND s.dataset = g.dataset AND s.series_id = g.series_id)"""


def picked_sql(name: str, caps=CAPS, modes=MODES, max_radius: float = 9.0) -> str:
    parts = []
    for mode in modes:
        capped = "" if mode == "unconstrained" else "AND NOT radius_cap_reached"
        parts.append(
            f"""SELECT *, '{mode}' AS selection_mode, row_number() OVER (PARTITION BY dataset, series_id, max_rules
              ORDER BY rmse, mae, total_parameter_count, rule_count, radius, ridge_alpha, lag_order) AS rn
            FROM pool, (SELECT unnest([{', '.join(map(str, caps))}]) AS max_rules)
            WHERE status = 'PASS' AND rule_count <= max_rules AND radius <= {max_radius} {capped}"""
        )
    return f"""
{name} AS (SELECT source, dataset, series_id, max_rules, selection_mode, 'PASS' AS status, lag_order AS selected_lag, radius AS selected_radius,
  ridge_alpha AS selected_ridge_alpha, rmse AS selected_validation_rmse, mae AS selected_validation_mae, rule_count, total_parameter_count, radius_cap_reached,
  test_rmse AS rmse, test_mae AS mae, test_mase AS mase FROM ({' UNION ALL '.join(parts)}) WHERE rn = 1)"""


PREDICTIVE_SQL = """
predictive AS (SELECT source, dataset, series_id, model, 'PASS' AS status, test_rmse AS rmse, test_mase AS mase FROM (
  SELECT *, CASE WHEN lag_order = 1 AND ridge_alpha = 0.1::DOUBLE THEN 'naive' WHEN lag_order = 2 AND ridge_alpha = 0.1::DOUBLE THEN 'lag_2'
    WHEN lag_order = 4 AND ridge_alpha = 0.1::DOUBLE THEN 'lag_4' WHEN lag_order = 1 AND ridge_alpha = 0.6::DOUBLE THEN 'shrunk' END AS model
  FROM pool WHERE radius = 2.0) WHERE model IS NOT NULL)"""
