"""Choosing one row per group by a fixed key, samples by hash, and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.functions.arrays import finite
from tidefold.functions.text import digest
from tidefold.operators.ordered import global_rank
from tidefold.session import cut_lineage


def radius_last(name: str = "radius") -> Column:
    """A missing radius sorts after every radius (Spark would put NULL first)."""
    return F.coalesce(F.col(name), F.lit(float("inf"))).alias(name)


# Selection keys, compared left to right.
KEYS = {
    "rmse": ["validation_rmse", "validation_mae", "consequent_dimension", "rule_count", "radius", "ridge_alpha", "lag"],
    "certificate": [
        "certificate_untruncated", "validation_rmse", "validation_mae", "consequent_dimension", "rule_count",
        "radius", "ridge_alpha", "lag",
    ],
    "rmse_then_certificate": [
        "validation_rmse", "certificate_untruncated", "consequent_dimension", "rule_count", "family", "radius",
        "ridge_alpha", "lag",
    ],
    "cost": [
        "validation_weighted_cost", "validation_rmse_clipped", "certificate_untruncated", "consequent_dimension",
        "rule_count", "family", "radius", "ridge_alpha", "lag",
    ],
    "smallest_radius": [
        "rmse", "mae", "total_parameter_count", "rule_count", "radius", "ridge_alpha", "lag_order",
    ],
    "cost_then_rmse": ["validation_weighted_cost", "validation_rmse", "aic"],
    "rmse_then_cost": ["validation_rmse", "validation_weighted_cost", "aic"],
}


def key_of(names: Sequence[str]) -> Column:
    return F.struct(*[radius_last() if n == "radius" else F.col(n) for n in names])


def best(pool: DataFrame, groups: Sequence[str], key: str | Sequence[str]) -> DataFrame:
    """The row with the smallest key in each group; map-side combined, so group size does not matter."""
    names = KEYS[key] if isinstance(key, str) else list(key)
    row = F.struct(*[F.col(c) for c in pool.columns if c not in groups])
    return pool.groupBy(*groups).agg(F.min_by(row, key_of(names)).alias("_row")).select(*groups, "_row.*")


def usable(pool: DataFrame, allow_capped: bool, finite_fields: Sequence[str] = ()) -> DataFrame:
    """Passed candidates, without capped ones unless allowed, with finite selection fields."""
    out = pool.filter(F.col("status") == "PASS")
    if not allow_capped:
        out = out.filter(~F.col("radius_cap_reached"))
    for name in finite_fields:
        out = out.filter(finite(F.col(name)))
    return out


def accepted_if_any(df: DataFrame, status: str = "status") -> DataFrame:
    """Keep accepted statuses, but only where some row has one (else keep all rows)."""
    # Statuses that count as accepted.
    words = ("PASS", "SELECTED", "ELIGIBLE", "OK", "PROCESSED")
    accepted = F.coalesce(F.upper(status).isin(*words), F.lit(False))
    # One row for the whole table, attached as a literal column of a broadcast-size side.
    flag = df.agg(F.coalesce(F.bool_or(accepted), F.lit(False)).alias("_any")).withColumn("_one", F.lit(1))
    return (
        df.withColumn("_one", F.lit(1))
        .join(F.broadcast(flag), "_one")
        .filter(~F.col("_any") | accepted)
        .drop("_any", "_one")
    )


DIGITS = 4


def lowest_hashes(
    df: DataFrame, keys: Sequence[str], wanted: Column, hash_column: str, strict: bool = False, tie: str = "series_id"
) -> DataFrame:
    """The ``wanted`` rows of each group with the lowest hexadecimal hashes, for any number of rows.

    Rows are counted by the first digits of their hash, with partial sums; running
    counts over the at most 65,536 prefixes of a group give the prefix at which
    the wanted number is reached. Rows below it are taken by a join, and only rows of that
    one prefix are put in order. ``wanted`` is one value for each group;
    with ``strict`` a group that has fewer rows is an error.
    """
    keys = list(keys)
    marked = df.withColumn("_prefix", F.substring(hash_column, 1, DIGITS))
    groups = Window.partitionBy(*keys)
    counts = (
        marked.groupBy(*keys, "_prefix").agg(F.count("*").alias("_rows"), F.first(wanted).cast("long").alias("_wanted"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(groups.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    if strict:
        have = F.sum("_rows").over(groups)
        counts = counts.withColumn("_have", have).filter(
            F.when(F.col("_have") >= F.col("_wanted"), F.lit(True)).otherwise(
                F.raise_error(F.lit("too few fresh series remain")).cast("boolean")
            )
        )
    marks = counts.select(*keys, "_prefix", "_rows", (F.col("_wanted") - F.col("_before")).alias("_need")).filter("_need > 0")
    met = marked.join(marks, [*keys, "_prefix"])
    order = Window.partitionBy(*keys).orderBy(hash_column, tie)
    whole = met.filter(F.col("_need") >= F.col("_rows"))
    last = met.filter(F.col("_need") < F.col("_rows")).withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= F.col("_need"))
    return whole.unionByName(last.drop("_rn")).drop("_prefix", "_rows", "_need")


def first_by_hash(
    df: DataFrame, counts: dict[str, int], namespace: str, strict: bool = True
) -> DataFrame:
    """The first N series of each dataset in hash order: a repeatable sample of any size."""
    wanted = F.lit(None).cast("int")
    for dataset, n in counts.items():
        wanted = F.when(F.col("dataset") == dataset, n).otherwise(wanted)
    scored = df.filter(F.col("dataset").isin(*counts)).withColumn(
        "selection_hash", digest(F.lit(namespace), F.col("dataset"), F.col("series_id"))
    )
    return lowest_hashes(scored, ["dataset"], wanted, "selection_hash", strict)


def length_strata(df: DataFrame, strata: int, length: str = "length", groups: Sequence[str] = ("dataset",)) -> DataFrame:
    """Stratum 0..strata-1 by the rank of the length (ties by id) on an even grid of ranks."""
    keys = list(groups)
    ranked = global_rank(df, keys, [length, "series_id"], "length_rank")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n_series"))
    out = ranked.join(sizes, keys)
    bins = F.least(F.lit(strata), F.col("n_series"))
    # A rank r lies in stratum k when r <= 1 + (n-1)(k+1)/bins.
    k = F.ceil((F.col("length_rank") - 1) * bins / F.greatest(F.col("n_series") - 1, F.lit(1))) - 1
    return out.withColumn("stratum", F.greatest(k, F.lit(0)).cast("int"))


def stratified_sample(
    df: DataFrame, target: int, seed: int, strata: int = 3, length: str = "length"
) -> DataFrame:
    """``target`` series per dataset spread over length strata, filled up by hash order."""
    keyed = cut_lineage(
        length_strata(df, strata, length).withColumn("_hash", digest(F.lit(seed), F.col("dataset"), F.col("series_id")))
    )
    bins = F.least(F.lit(strata), F.col("n_series"))
    take = F.floor(F.lit(target) / bins) + (F.col("stratum") < F.lit(target) % bins).cast("int")
    first = cut_lineage(lowest_hashes(keyed, ["dataset", "stratum"], take, "_hash"))
    # What the strata could not give comes from the other rows, again by hash.
    missing = first.groupBy("dataset").agg((target - F.count("*")).alias("_missing")).filter("_missing > 0")
    other = keyed.join(first.select("dataset", "series_id"), ["dataset", "series_id"], "left_anti").join(missing, "dataset")
    fill = lowest_hashes(other, ["dataset"], F.col("_missing"), "_hash").drop("_missing")
    return first.unionByName(fill).drop("_hash")


def simple_gate(certificate_limit: float = 0.20, clipping_limit: float = 0.05) -> Column:
    return (F.col("certificate_untruncated") <= certificate_limit) & (
        F.col("certification_target_clipping_rate") <= clipping_limit
    )


def robust_gate(
    certificate_limit: float = 0.10,
    clipping_limit: float = 0.02,
    rmse_gain: float = 0.05,
    cost_gain: float = 0.05,
    good_blocks: int = 3,
    worst_loss: float = 0.05,
) -> Column:
    return (
        (F.col("certificate_untruncated") <= certificate_limit)
        & (F.col("certification_target_clipping_rate") <= clipping_limit)
        & (F.col("validation_rmse_improvement_vs_fallback") >= rmse_gain)
        & (F.col("validation_cost_improvement_vs_fallback") >= cost_gain)
        & (F.col("validation_rmse_nonnegative_blocks") >= good_blocks)
        & (F.col("validation_cost_nonnegative_blocks") >= good_blocks)
        & (F.col("validation_worst_block_rmse_improvement") >= -worst_loss)
        & (F.col("validation_worst_block_cost_improvement") >= -worst_loss)
    )
