"""Registered queries: sources, quality, filling, roles, scaling, lags and errors."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.checks import sql
from tidefold.functions import metrics as m
from tidefold.functions.clock import epoch_seconds, slot_start, text
from tidefold.operators import impute, lags, quality, resample, roles
from tidefold.operators.ordered import number_rows, per_group
from tidefold.plans import prepare
from tidefold.sources import panels

SLOTS = panels.EVENT_HOURS.slots
WEEKS = panels.ORDER_WEEKS.slots


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


def _evt(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.by_ratio_panel(panels.evt_hour(spark, folder), 24, max_len=SLOTS)


def _seg(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.by_ratio_panel(panels.seg_week(spark, folder), 52, max_len=WEEKS)


EVT = sql.prepared(sql.EVT_HOUR, "evt_hour", 24)
SEG = sql.prepared(sql.SEG_WEEK, "seg_week", 52)


def bucket_mean_hour(spark, folder):
    p = panels.EVENT_HOURS
    got = resample.buckets(panels.events(spark, folder), p.start, p.end, p.step)
    return resample.with_step(got, p.start, p.step).select(
        "series_id", text(F.col("ts")).alias("hour"), F.round("value", 6).alias("mean_value"), "readings"
    )


def duplicate_collapse(spark, folder):
    """Orders of one day and segment are repeated readings of one timestamp."""
    return resample.duplicate_report(panels.orders_by_segment(spark, folder)).orderBy("series_id")


def collapsed_daily_mean(spark, folder):
    """Collapse repeats by mean, then average the hours of a day that has enough of them."""
    p = panels.EVENT_DAYS
    hourly = resample.buckets(panels.events(spark, folder), p.start, p.end, 3600)
    hours = resample.with_step(hourly, p.start, 3600).select("series_id", "ts", "value")
    return (
        resample.buckets(hours, p.start, p.end, p.step)
        .select("series_id", "pos", F.round("value", 9).alias("day_mean"), F.col("readings").alias("hours"),
                (F.col("readings") >= 23).alias("complete"))
    )


def bucket_completeness(spark, folder):
    return resample.completeness(panels.evt_hour(spark, folder), 1)


def wide_panel(spark, folder):
    """Weeks as rows and segments as columns, aligned on time, gaps as NULL."""
    p = panels.ORDER_WEEKS
    long = resample.with_step(panels.seg_week(spark, folder), p.start, p.step)
    got = resample.wide(long.withColumn("value", F.round("value", 4)))
    return got.select(text(F.col("ts")).alias("week"), *[F.col(n).alias(n.lower()) for n in got.columns if n != "ts"])


def panel_period(spark, folder):
    """The fixed periods against the tables: rows outside each of them, and the period that would hold all rows."""
    sources = {
        "events": (panels.events(spark, folder), panels.EVENT_HOURS), "orders": (panels.orders_by_segment(spark, folder), panels.ORDER_WEEKS),
        "shipments": (panels.shipments(spark, folder), panels.SHIP_WEEKS),
        # Half a year as the period: rows on both sides are counted, not lost in silence.
        "half_year": (panels.shipments(spark, folder), panels.Period(datetime(1998, 1, 5), datetime(1998, 7, 6), panels.WEEK, 52)),
    }
    out = None
    for name, (rows, p) in sources.items():
        own = panels.observed_period(rows, p.step, p.season, p.start)
        part = panels.outside(rows, p).select(F.lit(name).alias("source"), "*", F.lit(own.slots).alias("observed_slots"))
        out = part if out is None else out.unionByName(part)
    return out


def observed_panel(spark, folder):
    """Weeks of shipments over the period that the rows themselves span."""
    p = panels.observed_period(panels.shipments(spark, folder), panels.WEEK, 52, panels.SHIP_WEEKS.start)
    got = panels.ship_week(spark, folder, p)
    return resample.with_step(got, p.start, p.step).select("series_id", text(F.col("ts")).alias("week"), F.round("value", 4).alias("value"), "readings")


def preparation_status(spark, folder):
    """Users with all values missing, with too few days and with enough: every one has a row with its reason."""
    raw = panels.user_day(spark, folder)
    planted = raw.withColumn(
        "value", F.when(F.col("series_id") % 7 == 0, F.lit(None).cast("double")).when((F.col("series_id") % 5 == 0) & (F.col("pos") < 15), F.lit(None).cast("double")).otherwise(F.col("value"))
    )
    return prepare.horizon_status(planted, F.lit(7))


def series_quality(spark, folder):
    """Contract report on the raw events in arrival order."""
    raw = panels.events(spark, folder).withColumn("t", F.col("ts"))
    arrived = number_rows(raw, ["series_id"], [F.col("event_id")], F.floor(F.col("event_id") / 65536))
    return quality.series_quality(arrived)


def step_check(spark, folder):
    p = panels.ORDER_WEEKS
    weekly = resample.buckets(panels.orders_by_segment(spark, folder), p.start, p.end, p.step)
    timed = weekly.withColumn("ts", slot_start(F.col("pos"), p.start, p.step))
    return quality.step_report(timed, p.step, epoch_seconds(F.col("ts")), max_len=WEEKS)


def causal_impute(spark, folder):
    """The unbounded plan: chunks carry their last values across borders."""
    filled = impute.seasonal_fill(panels.evt_hour(spark, folder), 24)
    return filled.select("series_id", "pos", "step", r6("value_imputed"), "imputation_source", "was_imputed")


def imputation_report(spark, folder):
    return impute.imputation_report(impute.seasonal_fill(panels.evt_hour(spark, folder), 24, max_len=SLOTS))


def ratio_split(spark, folder):
    return roles.role_counts(_seg(spark, folder))


def role_boundaries(spark, folder):
    return roles.boundaries(_seg(spark, folder))


def _horizon(spark, folder, variant):
    raw = panels.user_day(spark, folder)
    filled = impute.seasonal_fill(raw, 7, max_len=30)
    split = roles.by_horizon(filled, F.lit(7), 0.30, variant=variant, max_len=30, on_short="drop")
    return roles.role_counts(split)


def horizon_split(spark, folder):
    return _horizon(spark, folder, "capped")


def horizon_split_strict(spark, folder):
    return _horizon(spark, folder, "strict")


def prior_zscore(spark, folder):
    got = _evt(spark, folder)
    back = roles.unscale(F.col("value_scaled"), F.col("scaler_mean"), F.col("scaler_scale"))
    return got.select(
        "series_id", "pos", "role", r6("value_scaled"), F.round("scaler_mean", 8).alias("scaler_mean"), r6("scaler_scale"), "scaler_fallback",
        F.round(back, 6).alias("value_back"),
    )


def preparation_metadata(spark, folder):
    return prepare.metadata(_evt(spark, folder)).select(
        "series_id", "processed_length", "original_length", "prior_n", "bound_n", "validation_n", "test_n",
        "prior_start_time", "test_end_time", "seasonal_fills", "last_observation_fills", "leading_values_dropped",
        F.round("scaler_mean", 8).alias("scaler_mean"), r6("scaler_scale"), "scaler_fallback",
    )


def processed_contract(spark, folder):
    return quality.processed_contract(_evt(spark, folder))


def _lag_rows(spark, folder, history, max_len=None):
    prepared = _evt(spark, folder)
    return lags.with_lags(prepared, 3, history=history, max_len=max_len)


def lag_features(spark, folder):
    rows = _lag_rows(spark, folder, "past_context")
    return rows.select(
        "series_id", "step", "role",
        *[F.round(F.col("features")[k - 1], 6).alias(f"lag_{k}") for k in (1, 2, 3)],
        F.round("value_scaled", 6).alias("y_scaled"), F.round("value_imputed", 6).alias("y_raw"),
        F.round("value", 6).alias("y_original"), "target_observed", "context_imputed_count",
    )


def lag_features_same_split(spark, folder):
    rows = _lag_rows(spark, folder, "same_split_only", SLOTS)
    return rows.groupBy("series_id", "role").agg(
        F.count("*").alias("rows"), F.min("step").alias("first_step"), F.max("step").alias("last_step"),
        F.count_if("target_observed").alias("observed_rows"),
        F.count_if(F.col("context_imputed_count") > 0).alias("imputed_context_rows"),
    )


def lagged_contract(spark, folder):
    return quality.lagged_contract(_lag_rows(spark, folder, "past_context", SLOTS), 3)


def observed_targets(spark, folder):
    rows = _lag_rows(spark, folder, "past_context", SLOTS)
    return roles.role_view(rows, "validation", "test").groupBy("series_id", "role").agg(F.count("*").alias("rows"))


def leakage_guard(spark, folder):
    """A training view must not hold later roles; rows of both are planted in it and have to be found."""
    every = _evt(spark, folder)
    planted = every.filter(((F.col("role") == "validation") & (F.col("step") % 7 == 0)) | ((F.col("role") == "test") & (F.col("step") % 11 == 0)))
    return roles.forbidden_roles(roles.role_view(every, "prior", "bound").unionByName(planted), ("prior", "bound"))


def _seasonal(spark, folder):
    return lags.with_shift(_evt(spark, folder), 24, "value_imputed", "forecast", max_len=SLOTS).filter(
        F.col("forecast").isNotNull()
    )


def seasonal_naive_metrics(spark, folder):
    """All errors of the seasonal forecast per role, scaled by the in-sample seasonal gap."""
    y, f = F.col("value_imputed"), F.col("forecast")
    rows = lags.with_seasonal_gap(
        lags.with_shift(_evt(spark, folder), 24, "value_imputed", "forecast", max_len=SLOTS), 24, max_len=SLOTS
    )
    scale = m.mase_scale(F.first("mean_gap"))
    return rows.filter(f.isNotNull()).groupBy("series_id", "role").agg(
        F.count("*").alias("n_observations"), F.round(m.mae(y, f), 8).alias("mae"), F.round(m.rmse(y, f), 6).alias("rmse"),
        F.round(m.smape(y, f), 6).alias("smape"), F.round(scale, 8).alias("mase_scale"),
        F.first("mase_scale_pairs").alias("mase_scale_pairs"), F.round(m.mae(y, f) / scale, 6).alias("mase"),
    )


def persistence_metrics(spark, folder):
    rows = lags.with_shift(_evt(spark, folder), 1, "value_imputed", "forecast", max_len=SLOTS)
    y, f = F.col("value_imputed"), F.col("forecast")
    return rows.filter(f.isNotNull()).groupBy("series_id", "role").agg(
        F.round(m.mae(y, f), 8).alias("mae"), F.round(m.rmse(y, f), 6).alias("rmse")
    )


def asymmetric_cost(spark, folder):
    rows = _seasonal(spark, folder).filter(F.col("role").isin("validation", "test"))
    y, f = F.col("value_imputed"), F.col("forecast")
    return rows.groupBy("series_id", "role").agg(
        F.round(m.weighted_cost(y, f), 8).alias("cost"), F.round(m.normalized_cost(y, f), 6).alias("normalized_cost")
    )


def clipping(spark, folder):
    """Bound from the first role, clipping rates of targets and the mean of clipped values."""
    y = F.col("value_scaled")
    rows = _evt(spark, folder)
    # The bound is a window value in the shuffle of the preparation.
    with_bound = per_group(rows, {"_top": F.max(F.when(F.col("role") == "prior", F.abs(y)))}, max_len=SLOTS).withColumn(
        "bound", m.clip_bound(F.col("_top"), 1.25)
    )
    return with_bound.filter(F.col("role") != "prior").groupBy("series_id", "role").agg(
        F.round(F.first("bound"), 6).alias("clip_bound"), F.round(m.clipping_rate(y, F.col("bound")), 6).alias("clipping_rate"),
        F.round(F.avg(m.clip(y, F.col("bound"))), 6).alias("mean_clipped"),
    )


def last_points(spark, folder):
    """The last 84 hours of every series."""
    return _evt(spark, folder).filter(F.col("step") >= F.col("n_rows") - 84).select(
        "series_id", "pos", r6("value_imputed")
    )


_SEASONAL_SQL = EVT + """,
f AS (SELECT * FROM (SELECT *, lag(value_imputed, 24) OVER (PARTITION BY series_id ORDER BY step) AS forecast FROM p) WHERE forecast IS NOT NULL)"""

_LAG_SQL = EVT + """,
l AS (SELECT * FROM (SELECT *, lag(value_scaled, 1) OVER w AS l1, lag(value_scaled, 2) OVER w AS l2, lag(value_scaled, 3) OVER w AS l3,
   lag(role, 3) OVER w AS oldest,
   CAST(coalesce(sum(CAST(was_imputed AS INT)) OVER (PARTITION BY series_id ORDER BY step ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS ctx
   FROM p WINDOW w AS (PARTITION BY series_id ORDER BY step)) WHERE step >= 3)"""

_HORIZON_SQL = "WITH " + sql.USER_DAY + "," + sql.imputed("user_day", 7) + """,
h AS (SELECT series_id, count(*) AS n FROM user_day_i GROUP BY 1),
z AS (SELECT series_id, n - 14 AS prefix, {prior} AS prior FROM h)
SELECT series_id, prior AS prior_n, prefix - prior AS bound_n, 7::BIGINT AS validation_n, 7::BIGINT AS test_n
FROM z WHERE prior >= 4 AND prefix - prior >= 4"""
_PRIOR = "greatest(4, CAST(floor((n - 14) * 0.30::DOUBLE) AS BIGINT))"

CHECKS = {
    "bucket_mean_hour": (bucket_mean_hour, "WITH " + sql.EVT_HOUR + """
SELECT series_id, strftime(TIMESTAMP '2024-01-01' + to_hours(pos), '%Y-%m-%d %H:%M:%S') AS hour, round(value, 6) AS mean_value, readings FROM evt_hour_b"""),
    "duplicate_collapse": (duplicate_collapse, """
SELECT series_id, CAST(sum(c) AS BIGINT) AS raw_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows, count(*) AS unique_rows
FROM (SELECT c_mktsegment AS series_id, o_orderdate, count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1"""),
    "collapsed_daily_mean": (collapsed_daily_mean, """
WITH h AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS hour, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT series_id, CAST(date_diff('day', DATE '2024-01-01', CAST(hour AS DATE)) AS BIGINT) AS pos, round(avg(v), 9) AS day_mean, count(*) AS hours, count(*) >= 23 AS complete
FROM h GROUP BY 1, 2"""),
    "bucket_completeness": (bucket_completeness, "WITH " + sql.EVT_HOUR + """
SELECT series_id, min(readings) AS min_readings, max(readings) AS max_readings, count(*) FILTER (readings < 1) AS short_buckets, min(readings) >= 1 AS complete
FROM evt_hour GROUP BY 1"""),
    "wide_panel": (wide_panel, "WITH " + sql.SEG_WEEK + """
SELECT strftime(TIMESTAMP '1994-12-26' + to_days(CAST(pos * 7 AS INT)), '%Y-%m-%d %H:%M:%S') AS week,
""" + ", ".join(f"round(max(value) FILTER (series_id = '{n}'), 4) AS {n.lower()}" for n in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + """
FROM seg_week GROUP BY pos"""),
    "panel_period": (panel_period, " UNION ALL ".join(
        f"SELECT '{n}' AS source, series_id, count(*) AS rows, count(*) FILTER (ts < TIMESTAMP '{lo}') AS rows_before, count(*) FILTER (ts >= TIMESTAMP '{hi}') AS rows_behind, 0::BIGINT AS rows_without_time, "
        f"(SELECT CAST(floor((epoch(max({t})) - epoch(TIMESTAMP '{lo}')) / {st}) - floor((epoch(min({t})) - epoch(TIMESTAMP '{lo}')) / {st}) + 1 AS BIGINT) FROM {tab}) AS observed_slots FROM {src} GROUP BY ALL"
        for n, src, tab, t, lo, hi, st in (
            ("events", "(SELECT event_type AS series_id, ts FROM events)", "events", "ts", "2024-01-01", "2024-01-31", 3600),
            ("orders", "(SELECT c_mktsegment AS series_id, o_orderdate AS ts FROM orders JOIN customer ON o_custkey = c_custkey)", "orders", "o_orderdate", "1994-12-26", "2001-08-06", 604800),
            ("shipments", "(SELECT l_returnflag AS series_id, l_shipdate AS ts FROM lineitem)", "lineitem", "l_shipdate", "1995-01-02", "2001-11-05", 604800),
            ("half_year", "(SELECT l_returnflag AS series_id, l_shipdate AS ts FROM lineitem)", "lineitem", "l_shipdate", "1998-01-05", "1998-07-06", 604800),
        ))),
    "observed_panel": (observed_panel, """
WITH b AS (SELECT l_returnflag AS series_id, CAST(floor((epoch(l_shipdate) - epoch(TIMESTAMP '1995-01-02')) / 604800) AS BIGINT) AS w, sum(l_extendedprice * (1 - l_discount)) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2),
g AS (SELECT series_id, unnest(range((SELECT min(w) FROM b), (SELECT max(w) + 1 FROM b))) AS w FROM (SELECT DISTINCT series_id FROM b))
SELECT g.series_id, strftime(TIMESTAMP '1995-01-02' + to_days(CAST(g.w * 7 AS INT)), '%Y-%m-%d %H:%M:%S') AS week, round(v, 4) AS value, coalesce(n, 0) AS readings
FROM g LEFT JOIN b ON b.series_id = g.series_id AND b.w = g.w"""),
    "preparation_status": (preparation_status, "WITH " + sql.USER_DAY + """,
q AS (SELECT series_id, pos, CASE WHEN series_id % 7 = 0 THEN NULL WHEN series_id % 5 = 0 AND pos < 15 THEN NULL ELSE value END AS value FROM user_day),
s AS (SELECT series_id, count(*) AS original_length, count(*) FILTER (value IS NULL) AS missing_values, coalesce(max(pos) - min(pos) FILTER (value IS NOT NULL) + 1, 0) AS usable_length FROM q GROUP BY 1),
z AS (SELECT *, least(greatest(4, CAST(floor((usable_length - 14) * 0.30::DOUBLE) AS BIGINT)), usable_length - 14 - 4) AS prior_n FROM s),
r AS (SELECT *, usable_length - 14 - prior_n AS bound_n, 7::BIGINT AS validation_n, 7::BIGINT AS test_n FROM z)
SELECT *, CASE WHEN usable_length = 0 THEN 'no observed value' WHEN prior_n < 4 THEN 'prior role below 4 rows' WHEN bound_n < 4 THEN 'bound role below 4 rows' END AS reason,
 CASE WHEN usable_length > 0 AND prior_n >= 4 AND bound_n >= 4 THEN 'PASS' ELSE 'SKIPPED' END AS status FROM r"""),
    "series_quality": (series_quality, """
WITH a AS (SELECT event_type AS series_id, ts, value, coalesce(ts > lag(ts) OVER (PARTITION BY event_type ORDER BY event_id), true) AS rises FROM events),
q AS (SELECT series_id, count(*) AS n_rows, count(*) FILTER (value IS NULL OR isnan(value)) + count(*) FILTER (ts IS NULL) AS missing_value_count,
 count(*) FILTER (value IS NULL OR NOT isfinite(value)) AS nonfinite_value_count, count(*) - count(DISTINCT ts) AS duplicate_time_count,
 bool_and(rises) AS time_strictly_increasing FROM a GROUP BY 1)
SELECT *, i AS issues, CASE WHEN i = '' THEN 'PASS' ELSE 'FAIL' END AS status FROM (
SELECT *, concat_ws('; ', CASE WHEN missing_value_count > 0 THEN 'missing_values=' || missing_value_count END,
 CASE WHEN nonfinite_value_count > 0 THEN 'nonfinite_values=' || nonfinite_value_count END,
 CASE WHEN duplicate_time_count > 0 THEN 'duplicate_times=' || duplicate_time_count END,
 CASE WHEN NOT time_strictly_increasing THEN 'time_not_strictly_increasing' END) AS i FROM q)""".replace("SELECT *, i AS issues", "SELECT * EXCLUDE (i), i AS issues")),
    "step_check": (step_check, "WITH " + sql.SEG_WEEK + """
SELECT series_id, count(*) AS n_rows, CAST(coalesce(min(g), 604800) AS BIGINT) AS min_step, CAST(coalesce(max(g), 604800) AS BIGINT) AS max_step,
 count(*) FILTER (g <> 604800) AS irregular_steps, coalesce(bool_and(g > 0), true) AS strictly_increasing
FROM (SELECT *, (pos - lag(pos) OVER (PARTITION BY series_id ORDER BY pos)) * 604800 AS g FROM seg_week_b) GROUP BY 1"""),
    "causal_impute": (causal_impute, "WITH " + sql.EVT_HOUR + "," + sql.imputed("evt_hour", 24) + """
SELECT series_id, pos, step, round(value_imputed, 6) AS value_imputed, imputation_source, was_imputed FROM evt_hour_i"""),
    "imputation_report": (imputation_report, "WITH " + sql.EVT_HOUR + "," + sql.imputed("evt_hour", 24) + """
SELECT series_id, count(*) FILTER (was_imputed) + min(dropped) AS original_missing, count(*) FILTER (imputation_source = 'seasonal_past') AS seasonal_fills,
 count(*) FILTER (imputation_source = 'last_observation') AS last_observation_fills, min(dropped) AS leading_values_dropped,
 count(*) FILTER (value_imputed IS NULL) AS remaining_missing FROM evt_hour_i GROUP BY 1"""),
    "ratio_split": (ratio_split, "WITH " + SEG + """
SELECT series_id, """ + ", ".join(f"count(*) FILTER (role = '{r}') AS {r}_n" for r in sql.RATIO) + " FROM p GROUP BY 1"),
    "role_boundaries": (role_boundaries, "WITH " + SEG + """
SELECT series_id, """ + ", ".join(
        f"min(step) FILTER (role = '{r}') AS {r}_start_index, max(step) FILTER (role = '{r}') AS {r}_end_index, "
        f"min(pos) FILTER (role = '{r}') AS {r}_start_time, max(pos) FILTER (role = '{r}') AS {r}_end_time, "
        f"count(*) FILTER (role = '{r}') AS {r}_n" for r in sql.RATIO) + " FROM p GROUP BY 1"),
    "horizon_split": (horizon_split, _HORIZON_SQL.format(prior=f"least({_PRIOR}, n - 14 - 4)")),
    "horizon_split_strict": (horizon_split_strict, _HORIZON_SQL.format(prior=_PRIOR)),
    "prior_zscore": (prior_zscore, "WITH " + EVT + """
SELECT series_id, pos, role, round(value_scaled, 6) AS value_scaled, round(scaler_mean, 8) AS scaler_mean, round(scaler_scale, 6) AS scaler_scale, scaler_fallback,
 round(value_imputed, 6) AS value_back FROM p"""),
    "preparation_metadata": (preparation_metadata, "WITH " + EVT + """
SELECT series_id, count(*) AS processed_length, count(*) + min(dropped) AS original_length, count(*) FILTER (role = 'prior') AS prior_n,
 count(*) FILTER (role = 'bound') AS bound_n, count(*) FILTER (role = 'validation') AS validation_n, count(*) FILTER (role = 'test') AS test_n,
 min(pos) FILTER (role = 'prior') AS prior_start_time, max(pos) FILTER (role = 'test') AS test_end_time,
 count(*) FILTER (imputation_source = 'seasonal_past') AS seasonal_fills, count(*) FILTER (imputation_source = 'last_observation') AS last_observation_fills,
 min(dropped) AS leading_values_dropped, round(min(scaler_mean), 8) AS scaler_mean, round(min(scaler_scale), 6) AS scaler_scale, bool_and(scaler_fallback) AS scaler_fallback
FROM p GROUP BY 1"""),
    "processed_contract": (processed_contract, "WITH " + EVT + """
SELECT series_id, count(*) AS n_rows, count(DISTINCT role) AS role_count, count(*) FILTER (NOT isfinite(value_imputed) OR value_imputed IS NULL) AS nonfinite_count,
 count(*) FILTER (was_imputed <> (value IS NULL)) AS flag_mismatch_count, true AS roles_in_order, 'PASS' AS status FROM p GROUP BY 1"""),
    "lag_features": (lag_features, "WITH " + _LAG_SQL + """
SELECT series_id, step, role, round(l1, 6) AS lag_1, round(l2, 6) AS lag_2, round(l3, 6) AS lag_3, round(value_scaled, 6) AS y_scaled,
 round(value_imputed, 6) AS y_raw, round(value, 6) AS y_original, NOT was_imputed AS target_observed, ctx AS context_imputed_count FROM l"""),
    "lag_features_same_split": (lag_features_same_split, "WITH " + _LAG_SQL + """
SELECT series_id, role, count(*) AS rows, min(step) AS first_step, max(step) AS last_step, count(*) FILTER (NOT was_imputed) AS observed_rows,
 count(*) FILTER (ctx > 0) AS imputed_context_rows FROM l WHERE oldest = role GROUP BY 1, 2"""),
    "lagged_contract": (lagged_contract, "WITH " + _LAG_SQL + """
SELECT series_id, count(*) AS n_rows, 0::BIGINT AS wrong_width, count(*) FILTER (l1 + l2 + l3 IS NULL) AS nonfinite_rows, count(*) - count(DISTINCT step) AS duplicate_targets,
 count(*) FILTER (ctx > 0) AS imputed_context_rows, count(*) FILTER (NOT was_imputed) AS observed_targets, min(step) AS first_target, 'PASS' AS status FROM l GROUP BY 1"""),
    "observed_targets": (observed_targets, "WITH " + _LAG_SQL + """
SELECT series_id, role, count(*) AS rows FROM l WHERE NOT was_imputed AND role IN ('validation', 'test') GROUP BY 1, 2"""),
    "leakage_guard": (leakage_guard, "WITH " + EVT + """
SELECT role, count(*) AS rows FROM p WHERE (role = 'validation' AND step % 7 = 0) OR (role = 'test' AND step % 11 = 0) GROUP BY 1"""),
    "seasonal_naive_metrics": (seasonal_naive_metrics, "WITH " + _SEASONAL_SQL + """,
g AS (SELECT series_id, avg(d) AS mean_gap, count(d) AS pairs FROM (
  SELECT series_id, CASE WHEN NOT was_imputed AND NOT lag(was_imputed, 24) OVER w THEN abs(value_imputed - lag(value_imputed, 24) OVER w) END AS d
  FROM p WHERE role IN ('prior', 'bound') WINDOW w AS (PARTITION BY series_id ORDER BY step)) GROUP BY 1)
SELECT f.series_id, role, count(*) AS n_observations, round(avg(abs(value_imputed - forecast)), 8) AS mae,
 round(sqrt(avg((value_imputed - forecast) ** 2)), 6) AS rmse,
 round(100 * avg(CASE WHEN abs(value_imputed) + abs(forecast) > 1e-12 THEN 2 * abs(value_imputed - forecast) / (abs(value_imputed) + abs(forecast)) ELSE 0 END), 6) AS smape,
 round(CASE WHEN min(mean_gap) > 1e-12 THEN min(mean_gap) END, 8) AS mase_scale, min(pairs) AS mase_scale_pairs,
 round(avg(abs(value_imputed - forecast)) / CASE WHEN min(mean_gap) > 1e-12 THEN min(mean_gap) END, 6) AS mase
FROM f JOIN g ON f.series_id = g.series_id GROUP BY 1, 2"""),
    "persistence_metrics": (persistence_metrics, "WITH " + EVT + """
SELECT series_id, role, round(avg(abs(value_imputed - b)), 8) AS mae, round(sqrt(avg((value_imputed - b) ** 2)), 6) AS rmse
FROM (SELECT *, lag(value_imputed) OVER (PARTITION BY series_id ORDER BY step) AS b FROM p) WHERE b IS NOT NULL GROUP BY 1, 2"""),
    "asymmetric_cost": (asymmetric_cost, "WITH " + _SEASONAL_SQL + """
SELECT series_id, role, round(avg(2 * greatest(value_imputed - forecast, 0) + greatest(forecast - value_imputed, 0)), 8) AS cost,
 round(avg(2 * greatest(value_imputed - forecast, 0) + greatest(forecast - value_imputed, 0)) / greatest(1e-12, avg(abs(value_imputed))), 6) AS normalized_cost
FROM f WHERE role IN ('validation', 'test') GROUP BY 1, 2"""),
    "clipping": (clipping, "WITH " + EVT + """,
b AS (SELECT series_id, greatest(1.0, 1.25::DOUBLE * max(abs(value_scaled)) FILTER (role = 'prior')) AS bound FROM p GROUP BY 1)
SELECT p.series_id, role, round(min(bound), 6) AS clip_bound, round(avg(CASE WHEN abs(value_scaled) > bound THEN 1.0::DOUBLE ELSE 0 END), 6) AS clipping_rate,
 round(avg(least(greatest(value_scaled, -bound), bound)), 6) AS mean_clipped FROM p JOIN b ON p.series_id = b.series_id WHERE role <> 'prior' GROUP BY 1, 2"""),
    "last_points": (last_points, "WITH " + EVT + """
SELECT series_id, pos, round(value_imputed, 6) AS value_imputed FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY step DESC) AS back FROM p) WHERE back <= 84"""),
}
