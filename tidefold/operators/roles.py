"""Four chronological roles, the scaler fitted on the first one, and leakage guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.operators.ordered import CHUNK, per_group

# Role names in time order.
ROLES = ("prior", "bound", "validation", "test")


def ratio_sizes(n: Column, fractions: dict[str, float]) -> dict[str, Column]:
    """Largest-remainder sizes; equal remainders go to the earlier role."""
    if tuple(fractions) != ROLES:
        raise ValueError(f"Fractions must be given in the order {ROLES}.")
    if any(f <= 0 for f in fractions.values()) or abs(sum(fractions.values()) - 1) > 1e-8:
        raise ValueError("Fractions must be positive and sum to one.")
    raw = {r: n * F.lit(float(f)) for r, f in fractions.items()}
    floor = {r: F.floor(raw[r]).cast("long") for r in ROLES}
    rest = {r: raw[r] - floor[r] for r in ROLES}
    left = n - sum((floor[r] for r in ROLES[1:]), floor[ROLES[0]])
    sizes = {}
    for i, role in enumerate(ROLES):
        ahead = F.lit(0)
        for j, other in enumerate(ROLES):
            if j != i:
                wins = rest[other] > rest[role] if j > i else rest[other] >= rest[role]
                ahead = ahead + wins.cast("int")
        sizes[role] = floor[role] + (ahead < left).cast("long")
    return sizes


def horizon_sizes(
    n: Column,
    horizon: Column,
    prior_fraction: float,
    min_prior: int = 4,
    min_bound: int = 4,
    variant: str = "capped",
) -> dict[str, Column]:
    """Last ``horizon`` rows are test, the ones before validation, the rest prior and bound.

    ``capped`` limits prior so that bound keeps its minimum; ``strict`` leaves
    bound short, which :func:`assign_roles` reports.
    """
    prefix = n - 2 * horizon
    prior = F.greatest(F.lit(min_prior), F.floor(prefix * F.lit(float(prior_fraction)))).cast("long")
    if variant == "capped":
        prior = F.least(prior, prefix - F.lit(min_bound))
    elif variant != "strict":
        raise ValueError(f"Unknown variant {variant}.")
    return {"prior": prior, "bound": prefix - prior, "validation": horizon, "test": horizon}


def with_roles(
    df: DataFrame,
    sizes,
    step: str = "step",
    max_len: int | None = None,
    chunk: int = CHUNK,
    on_short: str = "fail",
    minimum: dict[str, int] | None = None,
) -> DataFrame:
    """Label every row with its role.

    ``sizes`` maps the row count column to role sizes. A series with a role
    below its minimum (one row) fails the job, or is left out with
    ``on_short='drop'`` (its rows stay in the quality report).
    """
    counted = per_group(df, {"n_rows": F.count("*")}, max_len=max_len, chunk=chunk)
    plan = sizes(F.col("n_rows"))
    need = {role: 1 for role in ROLES} | (minimum or {})
    # ``inline`` works the sizes out once per row; a plain projection would be
    # copied into every later use of a size.
    sized = counted.select("*", F.inline(F.array(F.struct(*[plan[r].cast("long").alias(f"_{r}") for r in ROLES]))))
    short = F.lit(False)
    for role in ROLES:
        short = short | (F.col(f"_{role}") < need[role])
    if on_short == "drop":
        sized = sized.filter(~short)
    else:
        sized = sized.filter(
            F.when(~short, F.lit(True)).otherwise(
                F.raise_error(
                    F.format_string("series %s is too short for four roles", F.col("series_id").cast("string"))
                ).cast("boolean")
            )
        )
    first = F.col("_prior")
    second = first + F.col("_bound")
    third = second + F.col("_validation")
    at = F.col(step)
    role = (
        F.when(at < first, "prior").when(at < second, "bound").when(at < third, "validation").otherwise("test")
    )
    start = (
        F.when(at < first, F.lit(0)).when(at < second, first).when(at < third, second).otherwise(third)
    )
    return sized.withColumns(
        {"role": role, "role_step": (at - start).cast("long"),
         "role_size": F.when(at < first, F.col("_prior")).when(at < second, F.col("_bound"))
         .when(at < third, F.col("_validation")).otherwise(F.col("_test"))}
    ).drop(*[f"_{r}" for r in ROLES])


def by_ratio(df: DataFrame, fractions: dict[str, float], **kwargs) -> DataFrame:
    return with_roles(df, lambda n: ratio_sizes(n, fractions), **kwargs)


def by_horizon(
    df: DataFrame,
    horizon: Column,
    prior_fraction: float = 0.30,
    min_prior: int = 4,
    min_bound: int = 4,
    variant: str = "capped",
    **kwargs,
) -> DataFrame:
    return with_roles(
        df,
        lambda n: horizon_sizes(n, horizon, prior_fraction, min_prior, min_bound, variant),
        minimum={"prior": min_prior, "bound": min_bound},
        **kwargs,
    )


def role_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("series_id").agg(*[F.count_if(F.col("role") == r).alias(f"{r}_n") for r in ROLES])


def with_scaler(
    df: DataFrame,
    value: str = "value_imputed",
    role: str = "prior",
    epsilon: float = 1e-12,
    strict: bool = False,
    max_len: int | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Z-score from one role only: population deviation, scale 1 when it vanishes.

    ``strict`` fails instead of falling back.
    """
    inside = F.when(F.col("role") == role, F.col(value))
    out = per_group(
        df, {"scaler_mean": F.avg(inside), "_std": F.stddev_pop(inside)}, max_len=max_len, chunk=chunk
    )
    usable = F.col("_std").isNotNull() & ~F.isnan("_std") & (F.col("_std") > epsilon)
    if strict:
        scale = F.when(usable, F.col("_std")).otherwise(
            F.raise_error(F.lit("the prior role has no spread")).cast("double")
        )
    else:
        scale = F.when(usable, F.col("_std")).otherwise(F.lit(1.0))
    return (
        out.withColumn("scaler_scale", scale)
        .withColumn("scaler_fallback", ~usable)
        .withColumn("value_scaled", (F.col(value) - F.col("scaler_mean")) / F.col("scaler_scale"))
        .drop("_std")
    )


def unscale(value: Column, mean: Column, scale: Column) -> Column:
    checked = F.when(scale > 0, scale).otherwise(F.raise_error(F.lit("the scale must be positive")).cast("double"))
    return value * checked + mean


def role_view(df: DataFrame, *roles: str, observed_only: bool = True) -> DataFrame:
    """Rows of the given roles; originally missing targets are left out by default."""
    out = df.filter(F.col("role").isin(*roles))
    if observed_only and "target_observed" in df.columns:
        out = out.filter("target_observed")
    return out


def forbidden_roles(df: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Roles present in the rows but not allowed there; must be empty."""
    return df.filter(~F.col("role").isin(*allowed)).groupBy("role").agg(F.count("*").alias("rows"))


def boundary_stats(time: str = "pos") -> list[Column]:
    """First and last step and time and the row count of each role, as aggregates."""
    columns = []
    for role in ROLES:
        inside = F.col("role") == role
        columns += [
            F.min(F.when(inside, F.col("step"))).alias(f"{role}_start_index"),
            F.max(F.when(inside, F.col("step"))).alias(f"{role}_end_index"),
            F.min(F.when(inside, F.col(time))).alias(f"{role}_start_time"),
            F.max(F.when(inside, F.col(time))).alias(f"{role}_end_time"),
            F.count_if(inside).alias(f"{role}_n"),
        ]
    return columns


def boundaries(df: DataFrame, time: str = "pos") -> DataFrame:
    return df.groupBy("series_id").agg(*boundary_stats(time))
