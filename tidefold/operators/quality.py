"""Contract checks as report tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.functions.arrays import finite
from tidefold.operators.ordered import CHUNK, look_back


def require_columns(df: DataFrame, required: Iterable[str], name: str = "table") -> DataFrame:
    """Schema check before any plan is built on the frame."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{name} is missing columns: {missing}")
    return df


def exact_columns(df: DataFrame, expected: list[str], name: str = "table") -> DataFrame:
    if df.columns != list(expected):
        raise ValueError(f"{name} must have the columns {expected}, found {df.columns}")
    return df


# Columns that must not reach a selection table.
TEST_COLUMNS = (
    "mae", "rmse", "mase", "smape", "y_true", "y_pred",
    "test_mean_active_rules", "test_rule_usage_entropy",
)


def without_test_columns(df: DataFrame) -> DataFrame:
    found = sorted(set(TEST_COLUMNS) & set(df.columns))
    if found:
        raise ValueError(f"The selection table holds test metrics: {found}")
    return df


def unique_keys(df: DataFrame, keys: list[str], name: str = "table") -> DataFrame:
    """Pass the rows through; a repeated key fails the job when it is read.

    The copies of a key are counted beside its rows, so ``df`` is worked out once.
    """
    once = F.when(F.col("_copies") == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"{name} has duplicate keys")).cast("boolean"))
    return df.withColumn("_copies", F.count("*").over(Window.partitionBy(*keys))).filter(once).drop("_copies")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def series_quality(
    df: DataFrame,
    expected_length: int | None = None,
    max_len: int | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """One row per series for ``series_id, pos, t, value`` in arrival order ``pos``.

    Order is checked between neighbours and times are counted by (series, t),
    so neither needs a whole series in one task.
    """
    stepped = look_back(
        df, 1, lambda w: {"_rises": F.col("t") > F.lag("t", 1).over(w)}, max_len=max_len, chunk=chunk
    )
    value = F.col("value")
    per_time = stepped.groupBy("series_id", "t").agg(
        F.count("*").alias("rows"),
        F.count_if(value.isNull() | F.isnan(value)).alias("missing"),
        F.count_if(~finite(value)).alias("nonfinite"),
        F.coalesce(F.bool_and("_rises"), F.lit(True)).alias("rises"),
    )
    out = per_time.groupBy("series_id").agg(
        F.sum("rows").alias("n_rows"),
        (F.sum("missing") + F.sum(F.when(F.col("t").isNull(), F.col("rows")).otherwise(0))).alias(
            "missing_value_count"
        ),
        F.sum("nonfinite").alias("nonfinite_value_count"),
        F.sum(F.col("rows") - 1).alias("duplicate_time_count"),
        (F.bool_and("rises") & F.bool_and(F.col("t").isNotNull())).alias("time_strictly_increasing"),
    )
    length_ok = F.lit(True) if expected_length is None else F.col("n_rows") == expected_length
    parts = [
        F.when(F.col("missing_value_count") > 0, F.concat(F.lit("missing_values="), F.col("missing_value_count"))),
        F.when(F.col("nonfinite_value_count") > 0, F.concat(F.lit("nonfinite_values="), F.col("nonfinite_value_count"))),
        F.when(F.col("duplicate_time_count") > 0, F.concat(F.lit("duplicate_times="), F.col("duplicate_time_count"))),
        F.when(~F.col("time_strictly_increasing"), F.lit("time_not_strictly_increasing")),
        F.when(~length_ok, F.concat(F.lit("unexpected_length="), F.col("n_rows"), F.lit(f";expected={expected_length}"))),
    ]
    return out.withColumn("issues", F.concat_ws("; ", *parts)).withColumn(
        "status", F.when(F.col("issues") == "", "PASS").otherwise("FAIL")
    )


def step_report(
    df: DataFrame, step_seconds: int, seconds: Column, max_len: int | None = None, chunk: int = CHUNK
) -> DataFrame:
    """Per series: is time strictly increasing with one fixed step and no gap."""
    timed = df.withColumn("_sec", seconds)
    stepped = look_back(
        timed, 1, lambda w: {"_gap": F.col("_sec") - F.lag("_sec", 1).over(w)}, max_len=max_len, chunk=chunk
    )
    gap = F.col("_gap")
    return stepped.groupBy("series_id").agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.min(gap), F.lit(step_seconds)).alias("min_step"),
        F.coalesce(F.max(gap), F.lit(step_seconds)).alias("max_step"),
        F.count_if(gap != step_seconds).alias("irregular_steps"),
        F.coalesce(F.bool_and(gap > 0), F.lit(True)).alias("strictly_increasing"),
    )


def processed_contract(df: DataFrame) -> DataFrame:
    """Checks on a prepared panel: finite values, scaler recoverable, roles in order."""
    role_number = (
        F.when(F.col("role") == "prior", 0).when(F.col("role") == "bound", 1)
        .when(F.col("role") == "validation", 2).when(F.col("role") == "test", 3)
    )
    # Roles are in order when the last step of a role precedes the first of the next.
    per_role = df.withColumn("_r", role_number).groupBy("series_id", "_r").agg(
        F.min("step").alias("lo"),
        F.max("step").alias("hi"),
        F.count("*").alias("rows"),
        F.count_if(~finite(F.col("value_imputed")) | ~finite(F.col("value_scaled"))).alias("nonfinite"),
        F.count_if(F.col("was_imputed") != F.col("value").isNull()).alias("flag_mismatch"),
        F.max(
            F.abs(F.col("value_scaled") * F.col("scaler_scale") + F.col("scaler_mean") - F.col("value_imputed"))
        ).alias("scale_error"),
    )
    by_role = Window.partitionBy("series_id").orderBy("_r")
    ordered = per_role.withColumn("_prev", F.lag("hi").over(by_role))
    report = ordered.groupBy("series_id").agg(
        F.sum("rows").alias("n_rows"),
        F.count("_r").alias("role_count"),
        F.sum("nonfinite").alias("nonfinite_count"),
        F.sum("flag_mismatch").alias("flag_mismatch_count"),
        F.coalesce(F.bool_and(F.col("lo") > F.col("_prev")), F.lit(True)).alias("roles_in_order"),
        F.max("scale_error").alias("_scale_error"),
    )
    passed = (
        (F.col("role_count") == 4) & (F.col("nonfinite_count") == 0) & (F.col("flag_mismatch_count") == 0)
        & F.col("roles_in_order") & (F.col("_scale_error") < 1e-6)
    )
    return report.withColumn("status", F.when(passed, "PASS").otherwise("FAIL")).drop("_scale_error")


def lagged_contract(df: DataFrame, order: int) -> DataFrame:
    """Checks on lag rows: width, finite features, positive steps, targets unique."""
    bad = F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    per_step = df.groupBy("series_id", "step").agg(
        F.count("*").alias("rows"),
        F.count_if(F.size("features") != order).alias("width"),
        F.count_if(bad).alias("bad"),
        F.sum("context_imputed_count").alias("imputed"),
        F.count_if("target_observed").alias("observed"),
    )
    out = per_step.groupBy("series_id").agg(
        F.sum("rows").alias("n_rows"),
        F.sum("width").alias("wrong_width"),
        F.sum("bad").alias("nonfinite_rows"),
        F.count_if(F.col("rows") > 1).alias("duplicate_targets"),
        F.count_if(F.col("imputed") > 0).alias("imputed_context_rows"),
        F.sum("observed").alias("observed_targets"),
        F.min("step").alias("first_target"),
    )
    ok = (
        (F.col("wrong_width") == 0) & (F.col("nonfinite_rows") == 0)
        & (F.col("duplicate_targets") == 0) & (F.col("first_target") >= order)
    )
    return out.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def reconcile_counts(df: DataFrame, keys: list[str], expected: DataFrame) -> DataFrame:
    """Observed against expected row counts; a missing side counts as zero."""
    seen = df.groupBy(*keys).agg(F.count("*").alias("found"))
    return (
        seen.join(expected, keys, "full")
        .withColumns({"found": F.coalesce("found", F.lit(0)), "expected": F.coalesce("expected", F.lit(0))})
        .withColumn("matches", F.col("found") == F.col("expected"))
    )


# Check states that pass with a remark.
QUALIFIED = ("PASS_WITH_QUALIFICATION", "SENSITIVITY_ONLY")


def overall_status(checks: DataFrame) -> DataFrame:
    """Roll up a check table with ``status``: FAIL, PASS_WITH_QUALIFICATIONS or PASS."""
    failed = F.count_if(F.col("status") == "FAIL")
    qualified = F.count_if(F.col("status").isin(*QUALIFIED))
    return checks.agg(
        F.count("*").alias("checks"),
        failed.alias("failed"),
        qualified.alias("qualified"),
        F.when(failed > 0, "FAIL").when(qualified > 0, "PASS_WITH_QUALIFICATIONS").otherwise("PASS").alias("overall"),
    )
