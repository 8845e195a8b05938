"""Filling gaps from the past only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefold.functions.arrays import or_null
from tidefold.operators.ordered import CHUNK, chunk_of, fits, per_group


def trim_leading(
    df: DataFrame, value: str = "value", max_len: int | None = None, chunk: int = CHUNK
) -> DataFrame:
    """Drop the missing start of each series and add ``dropped`` and ``step`` (from 0).

    A series without any value has no start and disappears, see
    :func:`tidefold.operators.quality.series_quality` for finding those.
    """
    present = df.withColumn(value, or_null(F.col(value)))
    first = F.min(F.when(F.col(value).isNotNull(), F.col("pos")))
    return (
        per_group(present, {"dropped": first}, max_len=max_len, chunk=chunk)
        .filter(F.col("pos") >= F.col("dropped"))
        .withColumn("step", F.col("pos") - F.col("dropped"))
    )


def seasonal_fill(
    df: DataFrame, season: int, max_len: int | None = None, chunk: int = CHUNK
) -> DataFrame:
    """Causal fill: the value one season back (itself possibly filled), else the last one.

    In the first season a gap takes the last observation. From then on a gap
    takes the latest value of its own season slot ``step mod season``, whose
    first element is already filled, so no row-by-row loop is needed.
    """
    if season <= 0:
        raise ValueError("The season must be positive.")
    if season > chunk:
        raise ValueError("The season must fit in one chunk.")
    bounded = fits(max_len, chunk)
    trimmed = trim_leading(df, max_len=max_len, chunk=chunk)
    part = ["series_id"]
    if not bounded:
        trimmed = trimmed.withColumn("_chunk", chunk_of(F.col("step"), chunk))
        part = ["series_id", "_chunk"]
    so_far = Window.partitionBy(*part).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    seeded = trimmed.withColumn(
        "_seed",
        F.when(F.col("step") < season, F.last("value", ignorenulls=True).over(so_far)).otherwise(
            F.col("value")
        ),
    ).withColumn("_slot", F.col("step") % season)
    same_slot = (
        Window.partitionBy(*part, "_slot").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    )
    filled = seeded.withColumn("_filled", F.last("_seed", ignorenulls=True).over(same_slot))
    if not bounded:
        # The last value of each (series, slot, chunk) walks to the later chunks.
        ends = seeded.groupBy("series_id", "_slot", "_chunk").agg(
            F.max_by("_seed", F.when(F.col("_seed").isNotNull(), F.col("step"))).alias("_end")
        )
        before = (
            Window.partitionBy("series_id", "_slot")
            .orderBy("_chunk")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
        filled = filled.join(carried, ["series_id", "_slot", "_chunk"], "left").withColumn(
            "_filled", F.coalesce("_filled", "_carry")
        )
    source = (
        F.when(F.col("value").isNotNull(), "observed")
        .when(F.col("step") >= season, "seasonal_past")
        .otherwise("last_observation")
    )
    return (
        filled.withColumns(
            {
                "value_imputed": F.col("_filled"),
                "imputation_source": source,
                "was_imputed": F.col("value").isNull(),
            }
        )
        .drop("_seed", "_slot", "_filled", "_chunk", "_carry")
    )


def imputation_report(filled: DataFrame) -> DataFrame:
    source = F.col("imputation_source")
    return filled.groupBy("series_id").agg(
        (F.count_if(F.col("was_imputed")) + F.first("dropped")).alias("original_missing"),
        F.count_if(source == "seasonal_past").alias("seasonal_fills"),
        F.count_if(source == "last_observation").alias("last_observation_fills"),
        F.first("dropped").alias("leading_values_dropped"),
        F.count_if(F.col("value_imputed").isNull()).alias("remaining_missing"),
    )
