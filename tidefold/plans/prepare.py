"""From a raw panel to model-ready rows in one plan for all series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions.arrays import or_null
from tidefold.operators.impute import seasonal_fill
from tidefold.operators.ordered import CHUNK
from tidefold.operators.roles import boundary_stats, by_horizon, by_ratio, horizon_sizes, with_scaler

# The usual role shares.
RATIO = {"prior": 0.20, "bound": 0.45, "validation": 0.15, "test": 0.20}


def by_ratio_panel(
    panel: DataFrame,
    season: int,
    fractions: dict[str, float] | None = None,
    strict: bool = False,
    on_short: str = "fail",
    max_len: int | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Fill from the past, split by shares, scale on the first role."""
    filled = seasonal_fill(panel, season, max_len=max_len, chunk=chunk)
    split = by_ratio(filled, fractions or RATIO, max_len=max_len, chunk=chunk, on_short=on_short)
    return with_scaler(split, strict=strict, max_len=max_len, chunk=chunk)


def by_horizon_panel(
    panel: DataFrame,
    season: int,
    horizon: Column,
    prior_fraction: float = 0.30,
    variant: str = "capped",
    on_short: str = "fail",
    max_len: int | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Same with the last ``horizon`` rows as test and the ones before as validation."""
    filled = seasonal_fill(panel, season, max_len=max_len, chunk=chunk)
    split = by_horizon(
        filled, horizon, prior_fraction, variant=variant, max_len=max_len, chunk=chunk, on_short=on_short
    )
    return with_scaler(split, max_len=max_len, chunk=chunk)


def metadata(prepared: DataFrame) -> DataFrame:
    """One row per series: length, role borders, fills and scaler."""
    source = F.col("imputation_source")
    return prepared.groupBy("series_id").agg(
        *boundary_stats(),
        F.count("*").alias("processed_length"),
        (F.count("*") + F.first("dropped")).alias("original_length"),
        F.count_if(source == "seasonal_past").alias("seasonal_fills"),
        F.count_if(source == "last_observation").alias("last_observation_fills"),
        F.first("dropped").alias("leading_values_dropped"),
        F.first("scaler_mean").alias("scaler_mean"),
        F.first("scaler_scale").alias("scaler_scale"),
        F.first("scaler_fallback").alias("scaler_fallback"),
    )


def horizon_status(
    panel: DataFrame, horizon: Column, prior_fraction: float = 0.30, variant: str = "capped", min_prior: int = 4, min_bound: int = 4
) -> DataFrame:
    """One row for every series of the raw panel: its length behind the missing start, role sizes, and why it is left out.

    The side table of :func:`by_horizon_panel` with ``on_short='drop'``: what that
    plan drops has a row with a reason here, so no series is lost in silence. One
    aggregation, whatever the length of a series.
    """
    value = or_null(F.col("value"))
    found = panel.groupBy("series_id").agg(
        F.count("*").alias("original_length"), F.count_if(value.isNull()).alias("missing_values"),
        F.min(F.when(value.isNotNull(), F.col("pos"))).alias("_first"), F.max("pos").alias("_last"),
    )
    length = F.coalesce(F.col("_last") - F.col("_first") + 1, F.lit(0)).cast("long")
    sizes = horizon_sizes(F.col("usable_length"), horizon, prior_fraction, min_prior, min_bound, variant)
    need = {"prior": min_prior, "bound": min_bound, "validation": 1, "test": 1}
    reason = F.when(F.col("usable_length") == 0, "no observed value")
    for role, least in need.items():
        reason = reason.when(F.col(f"{role}_n") < least, f"{role} role below {least} rows")
    return (
        found.withColumn("usable_length", length)
        .withColumns({f"{role}_n": n.cast("long") for role, n in sizes.items()})
        .withColumn("reason", reason)
        .withColumn("status", F.when(F.col("reason").isNull(), "PASS").otherwise("SKIPPED"))
        .drop("_first", "_last")
    )
