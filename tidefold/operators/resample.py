"""Duplicate collapse, tumbling buckets, completeness and densifying."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions.clock import slot_of, slot_start, slots_between


def collapse_duplicates(df: DataFrame) -> DataFrame:
    """One row per (series, ts) with the mean value and how many rows it stands for."""
    return df.groupBy("series_id", "ts").agg(
        F.avg("value").alias("value"), F.count("*").alias("copies")
    )


def duplicate_report(df: DataFrame) -> DataFrame:
    return (
        collapse_duplicates(df)
        .groupBy("series_id")
        .agg(
            F.sum("copies").alias("raw_rows"),
            F.sum(F.col("copies") - 1).alias("duplicate_rows"),
            F.count("*").alias("unique_rows"),
        )
    )


def in_period(df: DataFrame, start: datetime, end: datetime, ts: str = "ts") -> DataFrame:
    """Rows of the common period [start, end); the filter reaches the scan."""
    # Text literals: a datetime literal would pass through a session zone.
    low, high = (F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz") for t in (start, end))
    return df.filter((F.col(ts) >= low) & (F.col(ts) < high))


def buckets(
    df: DataFrame,
    start: datetime,
    end: datetime,
    step: int,
    value: Column | None = None,
    how: str = "mean",
) -> DataFrame:
    """Tumbling buckets of ``step`` seconds: one row per non-empty (series, slot)."""
    measure = F.col("value") if value is None else value
    combine = {"mean": F.avg, "sum": F.sum}[how]
    return (
        in_period(df, start, end)
        .withColumn("pos", slot_of(F.col("ts"), start, step))
        .groupBy("series_id", "pos")
        .agg(combine(measure).alias("value"), F.count("*").alias("readings"))
    )


def with_step(df: DataFrame, start: datetime, step: int) -> DataFrame:
    return df.withColumn("ts", slot_start(F.col("pos"), start, step))


def densify(bucketed: DataFrame, start: datetime, end: datetime, step: int, series: DataFrame | None = None) -> DataFrame:
    """Every slot of the period for every series; empty slots hold NULL.

    The grid is generated by ``sequence`` per series, so its size is known and
    nothing is crossed. ``series`` may give the rows that name the series of
    ``bucketed``, so that the buckets are not made a second time for their names.
    """
    slots = slots_between(start, end, step)
    grid = (
        (bucketed if series is None else series).select("series_id")
        .distinct()
        .select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("pos"))
    )
    return grid.join(bucketed, ["series_id", "pos"], "left").withColumn(
        "readings", F.coalesce("readings", F.lit(0))
    )


def completeness(dense: DataFrame, minimum: int) -> DataFrame:
    """Per series: how full the buckets are against a required reading count."""
    return dense.groupBy("series_id").agg(
        F.min("readings").alias("min_readings"),
        F.max("readings").alias("max_readings"),
        F.count_if(F.col("readings") < minimum).alias("short_buckets"),
        (F.min("readings") >= minimum).alias("complete"),
    )


def require_complete(dense: DataFrame, minimum: int) -> DataFrame:
    """Pass the rows through, failing the job at a bucket with too few readings."""
    return dense.filter(
        F.when(F.col("readings") >= minimum, F.lit(True)).otherwise(
            F.raise_error(
                F.format_string("incomplete bucket %d of series %s", F.col("pos"), F.col("series_id").cast("string"))
            ).cast("boolean")
        )
    )


def panel(
    df: DataFrame,
    start: datetime,
    end: datetime,
    step: int,
    value: Column | None = None,
    how: str = "mean",
) -> DataFrame:
    """Regular panel ``series_id, pos, value, readings`` over the whole period."""
    return densify(buckets(df, start, end, step, value, how), start, end, step, in_period(df, start, end))


def names_of(df: DataFrame, key: str = "series_id") -> list[str]:
    """The distinct keys that become columns, in order; a wide table has few of them."""
    return sorted(str(r[0]) for r in df.select(key).filter(F.col(key).isNotNull()).distinct().collect())


def wide(df: DataFrame, names: list[str] | None = None, value: str = "value") -> DataFrame:
    """One column per series, aligned on time; used for output only. Without ``names`` every series of the rows has its column."""
    return df.groupBy("ts").pivot("series_id", names or names_of(df)).agg(F.first(value))


def long(df: DataFrame, ts: str, names: list[str]) -> DataFrame:
    return df.unpivot(ts, names, "series_id", "value").withColumnRenamed(ts, "ts")

