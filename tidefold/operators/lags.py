"""Lag features and simple forecasts read off the past."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.operators.ordered import CHUNK, look_back, per_group


def with_lags(
    df: DataFrame,
    order: int,
    value: str = "value_scaled",
    history: str = "past_context",
    max_len: int | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """``features`` = [newest .. oldest] of the last ``order`` values; rows without them go.

    ``same_split_only`` also drops a target whose oldest lag lies in another
    role (roles are contiguous, so the oldest one decides).
    """
    if order <= 0:
        raise ValueError("The lag order must be positive.")
    if history not in ("past_context", "same_split_only"):
        raise ValueError(f"Unknown history policy {history}.")
    imputed = "was_imputed" in df.columns

    def columns(window) -> dict[str, Column]:
        out = {"features": F.array(*[F.lag(value, k).over(window) for k in range(1, order + 1)])}
        if history == "same_split_only":
            out["_oldest"] = F.lag("role", order).over(window)
        if imputed:
            past = window.rowsBetween(-order, -1)
            out["context_imputed_count"] = F.coalesce(
                F.sum(F.col("was_imputed").cast("int")).over(past), F.lit(0)
            ).cast("int")
        return out

    out = look_back(df, order, columns, pos="step", max_len=max_len, chunk=chunk).filter(
        F.col("step") >= order
    )
    if history == "same_split_only":
        out = out.filter(F.col("_oldest") == F.col("role")).drop("_oldest")
    if imputed:
        out = out.withColumn("target_observed", ~F.col("was_imputed"))
    return out


def with_shift(
    df: DataFrame, lag: int, value: str, name: str, max_len: int | None = None, chunk: int = CHUNK
) -> DataFrame:
    """Value ``lag`` rows earlier: persistence for 1, the seasonal forecast for a season."""
    return look_back(
        df, lag, lambda w: {name: F.lag(value, lag).over(w)}, pos="step", max_len=max_len, chunk=chunk
    )


def with_seasonal_gap(
    df: DataFrame,
    season: int,
    roles: Sequence[str] = ("prior", "bound"),
    value: str = "value_imputed",
    max_len: int | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """``mean_gap``: mean absolute seasonal difference inside the given roles, both ends observed.

    The roles must be the first ones of a series, so that both ends lie in them.
    """
    inside = F.col("role").isin(*roles)
    shifted = look_back(
        df, season,
        lambda w: {"_back": F.lag(value, season).over(w), "_back_filled": F.lag("was_imputed", season).over(w)},
        pos="step", max_len=max_len, chunk=chunk,
    )
    both = inside & F.col("_back").isNotNull() & ~F.col("was_imputed") & ~F.col("_back_filled")
    gap = F.when(both, F.abs(F.col(value) - F.col("_back")))
    return per_group(
        shifted, {"mean_gap": F.avg(gap), "mase_scale_pairs": F.count(gap)}, max_len=max_len, chunk=chunk
    ).drop("_back", "_back_filled")
