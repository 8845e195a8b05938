"""Forecast errors as aggregate expressions, usable in any groupBy or window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_round(value: Column, digits: int, given: int = 6) -> Column:
    """``value``, a whole multiple of 10^-given but for noise, to ``digits`` places: halves go away from zero.

    The rounding is done on whole numbers, so the noise of a difference does not decide a half.
    """
    units = F.round(value * 10.0**given).cast("long")
    step = 10 ** (given - digits)
    return F.signum(units) * F.floor((F.abs(units) + step // 2) / step) / 10.0**digits


def exact_mean(value: Column, digits: int = 9) -> Column:
    """Mean of the values to ``digits`` places, summed as decimals: the order of the rows cannot change it.

    Where a value has no decimal (not finite, or beyond 10^18) this is the plain mean.
    """
    parts = value.try_cast(f"decimal(28,{digits})")
    return F.when(F.count(parts) == F.count(value), F.sum(parts).cast("double") / F.count(value)).otherwise(F.avg(value))


def mae(actual: Column, forecast: Column) -> Column:
    return F.avg(F.abs(actual - forecast))


def rmse(actual: Column, forecast: Column) -> Column:
    return F.sqrt(F.avg((actual - forecast) * (actual - forecast)))


def smape(actual: Column, forecast: Column, epsilon: float = 1e-12) -> Column:
    """Scale 0-200; a term with a tiny denominator counts as zero but stays in n."""
    size = F.abs(actual) + F.abs(forecast)
    term = F.when(size > epsilon, 2.0 * F.abs(actual - forecast) / size).otherwise(0.0)
    return 100.0 * F.avg(F.when(actual.isNotNull() & forecast.isNotNull(), term))


def asymmetric_loss(actual: Column, forecast: Column, under: float = 2.0, over: float = 1.0) -> Column:
    return under * F.greatest(actual - forecast, F.lit(0.0)) + over * F.greatest(
        forecast - actual, F.lit(0.0)
    )


def weighted_cost(actual: Column, forecast: Column, under: float = 2.0, over: float = 1.0) -> Column:
    return F.avg(asymmetric_loss(actual, forecast, under, over))


def normalized_cost(actual: Column, forecast: Column, under: float = 2.0, over: float = 1.0) -> Column:
    return weighted_cost(actual, forecast, under, over) / F.greatest(
        F.lit(1e-12), F.avg(F.abs(actual))
    )


def mase_scale(mean_gap: Column, epsilon: float = 1e-12) -> Column:
    """Mean seasonal difference, NULL where it cannot scale anything."""
    return F.when(mean_gap > epsilon, mean_gap)


def gain(base: Column, new: Column, variant: str = "plain") -> Column:
    """Relative improvement. The denominator is the base, its floor, or the floor of its size."""
    floor = F.lit(1e-12)
    below = {
        "plain": base,
        "floored": F.greatest(base, floor),
        "absolute": F.greatest(F.abs(base), floor),
    }[variant]
    return (base - new) / below


def clip(value: Column, bound: Column) -> Column:
    return F.least(F.greatest(value, -bound), bound)


def clipping_rate(value: Column, bound: Column) -> Column:
    return F.avg(F.when(F.abs(value) > bound, 1.0).otherwise(0.0))


def clip_bound(prior_values_max: Column, multiplier: float = 1.0) -> Column:
    return F.greatest(F.lit(1.0), F.lit(float(multiplier)) * prior_values_max)


def rms_allowance(certificate: Column, bound: Column, scale: Column) -> Column:
    """A risk bound in [0, 1] expressed as a root mean square error in source units."""
    return 2.0 * bound * scale * F.sqrt(F.least(F.lit(1.0), certificate))
