"""Ordered work inside a series without giving one task a whole series.

A series may hold a third of all rows, so windows run over ``(series, chunk)``
where a chunk is a fixed run of positions. Rows near a chunk border are copied
into the next chunk (a halo) when an operator looks back, and running values
cross borders through one small row per chunk.

Where the caller can prove that a series fits in one chunk (a gridded period
has a known number of slots) the chunk is a constant and the plan is a plain
window with one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.session import cut_lineage

CHUNK = 65_536
KEYS = ("series_id",)


def fits(max_len: int | None, chunk: int = CHUNK) -> bool:
    return max_len is not None and max_len <= chunk


def chunk_of(pos: Column, chunk: int) -> Column:
    return F.floor(pos / F.lit(chunk)).cast("long")


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str = "pos"
) -> DataFrame:
    """Zero-based position in each group.

    ``bucket`` must not decrease along ``order``. Rows are numbered inside a
    bucket and shifted by the count of the earlier buckets.
    """
    tagged = df.withColumn("_bucket", bucket)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        tagged.groupBy(*keys, "_bucket")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        tagged.join(starts, [*keys, "_bucket"])
        .withColumn(name, (F.row_number().over(inside) - 1 + F.col("_start")).cast("long"))
        .drop("_bucket", "_start")
    )


def with_cuts(df: DataFrame, keys: Sequence[str], value: str, cuts: int = 64) -> DataFrame:
    """Add ``_bucket``: the quantile bucket of ``value`` in its group.

    The cut points are approximate; any cut points give right ranks, good ones
    give even buckets.
    """
    marks = [(i + 1) / cuts for i in range(cuts - 1)]
    bounds = df.groupBy(*keys).agg(F.percentile_approx(value, marks, 1000).alias("_cuts"))
    return (
        df.join(bounds, list(keys))
        .withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c < F.col(value))))
        .drop("_cuts")
    )


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Average rank of ``value`` in its group (ties share the mean rank).

    Equal values are counted once before ranking, so a huge tie is one row,
    and distinct values are ranked bucket by bucket.
    """
    distinct = cut_lineage(df.groupBy(*keys, value).agg(F.count("*").alias("_ties")))
    bucketed = with_cuts(distinct, keys, value)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.sum("_ties").alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    ranks = (
        bucketed.join(starts, [*keys, "_bucket"])
        .withColumn("_before", F.coalesce(F.sum("_ties").over(inside), F.lit(0)) + F.col("_start"))
        .select(
            *keys,
            value,
            (F.col("_before") + (F.col("_ties") + 1) / 2.0).alias(name),
            F.col("_ties").alias(f"{name}_ties"),
        )
    )
    return df.join(ranks, [*keys, value])


def global_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """One-based place of each row in its group by ``order`` (a unique order).

    A range shuffle cuts the sorted rows into even pieces whatever the keys
    look like; the piece number is stored with the rows, so counting the pieces
    and numbering inside them always see the same cut.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = cut_lineage(
        df.repartitionByRange(parts, *keys, *order).withColumn("_piece", F.spark_partition_id())
    )
    numbered = number_rows(pieces, keys, [F.col(c) for c in order], F.col("_piece"), name)
    return numbered.withColumn(name, F.col(name) + 1).drop("_piece")


def medians(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Exact medians per group, NULLs left out, without holding a group in one task.

    Distinct values are counted, the counts are summed up bucket by bucket, and
    the one or two middle values are picked by their place. NULL keys are kept.
    """
    keys = list(keys)
    entries = F.array(*[F.struct(F.lit(n).alias("_name"), v.cast("double").alias("_value")) for n, v in values.items()])
    long = df.select(*keys, F.inline(entries)).filter(F.col("_value").isNotNull() & ~F.isnan("_value"))
    group = F.struct(*[F.col(k) for k in keys], F.col("_name"))
    # The whole key as one text, so NULL keys meet in the joins.
    counted = cut_lineage(
        long.withColumn("_g", F.to_json(group, {"ignoreNullFields": "false"}))
        .groupBy("_g", *keys, "_name", "_value")
        .agg(F.count("*").alias("_ties"))
    )
    bucketed = with_cuts(counted, ["_g"], "_value")
    earlier = Window.partitionBy("_g").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        bucketed.groupBy("_g", "_bucket")
        .agg(F.sum("_ties").alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .withColumn("_n", F.sum("_rows").over(Window.partitionBy("_g")))
        .drop("_rows")
    )
    inside = Window.partitionBy("_g", "_bucket").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed.join(starts, ["_g", "_bucket"]).withColumn(
        "_before", F.coalesce(F.sum("_ties").over(inside), F.lit(0)) + F.col("_start")
    )

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_before") < place) & (place <= F.col("_before") + F.col("_ties")), F.col("_value")))

    low, high = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    middle = placed.groupBy("_g", *keys, "_name").agg(((at(low) + at(high)) / 2.0).alias("_median"))
    return middle.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_median"))).alias(n) for n in values]
    )


def with_medians(summary: DataFrame, df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Attach medians to a summary table with the same keys."""
    keys = list(keys)
    if not keys:
        right = medians(df.withColumn("_one", F.lit(1)), ["_one"], values)
        return summary.withColumn("_one", F.lit(1)).join(right, "_one", "left").drop("_one")
    right = medians(df, keys, values)
    on = F.lit(True)
    for k in keys:
        on = on & summary[k].eqNullSafe(right[k])
    return summary.join(right, on, "left").select(summary["*"], *[right[n] for n in values])


def look_back(
    df: DataFrame,
    back: int,
    columns: Callable[[Window], dict[str, Column]],
    keys: Sequence[str] = KEYS,
    pos: str = "pos",
    max_len: int | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Add window columns that read at most ``back`` rows before the current one."""
    if fits(max_len, chunk):
        window = Window.partitionBy(*keys).orderBy(pos)
        return df.withColumns(columns(window))
    if back > chunk:
        raise ValueError(f"The look-back {back} must not exceed the chunk of {chunk} rows.")
    home = chunk_of(F.col(pos), chunk)
    reach = chunk_of(F.col(pos) + back, chunk)
    window = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    return (
        df.withColumn("_home", home)
        .withColumn("_chunk", F.explode(F.array_distinct(F.array(home, reach))))
        .withColumns(columns(window))
        .filter(F.col("_chunk") == F.col("_home"))
        .drop("_chunk", "_home")
    )


def per_group(
    df: DataFrame,
    stats: dict[str, Column],
    keys: Sequence[str] = KEYS,
    max_len: int | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Attach group aggregates to every row.

    A bounded group uses a window (same shuffle as its neighbours); otherwise a
    map-side combined aggregate is joined back.
    """
    if fits(max_len, chunk):
        window = Window.partitionBy(*keys)
        return df.withColumns({name: value.over(window) for name, value in stats.items()})
    small = df.groupBy(*keys).agg(*[value.alias(name) for name, value in stats.items()])
    return df.join(small, list(keys))
