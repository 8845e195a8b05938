"""Small array expressions used by models and bounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once.

    Inside a lambda Spark evaluates a repeated expression again at every use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a * b))


def mean_square_gap(left: Column, right: Column) -> Column:
    """Squared distance divided by the number of coordinates."""
    return total(F.zip_with(left, right, lambda a, b: (a - b) * (a - b))) / F.size(left)


def literal_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def finite(value: Column) -> Column:
    """True for a value that is neither NULL, NaN nor infinite."""
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def or_null(value: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(finite(value), value.cast("double"))
