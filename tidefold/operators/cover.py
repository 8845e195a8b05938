"""Rule geometry: farthest-first covers of lag space and their Gaussian rules.

The order in which centers are picked does not depend on the radius or the
wanted rule count; both only say where to stop. So one traversal per
(series, lag) serves every radius and every fixed count.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions import blocks
from tidefold.functions.arrays import dot, let, mean_square_gap, total
from tidefold.functions.batches import TOO_LONG, Lists, lists, starts, whole_groups
from tidefold.operators.ordered import CHUNK, fits
from tidefold.session import cut_lineage, spread_keys

# Limits of the rule widths and the smallest usable deviation.
SPREAD_FLOOR, SPREAD_CEILING, EPSILON = 0.15, 3.0, 1e-12
REFINEMENTS = 2
KEYS = ("series_id", "lag")

# One row per (series, lag, k). Centers and spreads are row-major, ``rule_count`` x ``lag``.
COVER_SCHEMA = (
    "series_id string, lag int, k int, n_prior long, feature_mean array<double>, feature_scale array<double>, "
    "reach array<double>, rule_count int, empty int, realized double, support array<bigint>, "
    "centers array<double>, spreads array<double>"
)


def cover(
    rows: DataFrame, order_list: Sequence[int], max_rules: int, max_len: int | None = None, chunk: int = CHUNK
) -> DataFrame:
    """One row per (series, lag, k): cover radii and the refined rules of the first k picks.

    ``reach[k-1]`` is the cover radius with the first k picks. A series proven
    to fit in one chunk is covered in one task; others go in rounds over all
    series together.
    """
    prior = rows.filter(F.col("role") == "prior").select(
        F.col("series_id").cast("string").alias("series_id"), "step", "features"
    )
    if fits(max_len, chunk):
        return _cover_blocks(prior, order_list, max_rules, chunk)
    return _cover_rounds(prior, order_list, max_rules)


def _cover_blocks(prior: DataFrame, order_list: Sequence[int], max_rules: int, limit: int) -> DataFrame:
    """Series of one lag and length are covered together; only those that lose a rule go on by themselves."""

    def covered(ids: pa.Array, p: int, x: np.ndarray) -> list[pa.RecordBatch]:
        mean, scale = x.mean(axis=1), x.std(axis=1)
        scale = np.where(scale > EPSILON, scale, 1.0)
        z = (x - mean[:, None]) / scale[:, None]
        order, reach = blocks.farthest_first(z, max_rules)
        wide = z.std(axis=1)
        wide = np.where(wide > EPSILON, wide, 1.0)

        def rules(own: np.ndarray, k: int, centers: np.ndarray) -> pa.RecordBatch:
            label, gap = blocks.nearest(z[own], centers)
            support, sd = blocks.group_deviation(z[own], label, centers.shape[1])
            sd = np.where((support[..., None] >= 2) & (sd > EPSILON), sd, wide[own][:, None])
            n, count = len(own), centers.shape[1]

            def same(value: int, kind) -> pa.Array:
                return pa.array(np.full(n, value), kind)

            columns = [
                ids.take(pa.array(own)), same(p, pa.int32()), same(k, pa.int32()), same(x.shape[1], pa.int64()), lists(mean[own]), lists(scale[own]),
                lists(reach[own]), same(count, pa.int32()), same(k - count, pa.int32()), pa.array(np.maximum(np.sqrt(gap.max(axis=1)), EPSILON)),
                lists(support.astype(np.int64)), lists(centers.reshape(n, -1)), lists(np.clip(sd, SPREAD_FLOOR, SPREAD_CEILING).reshape(n, -1)),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in COVER_SCHEMA.split(", ")])

        out = []
        for k in range(1, order.shape[1] + 1):
            centers = np.take_along_axis(z, order[:, :k, None], axis=1)
            for _ in range(REFINEMENTS):
                label, _gap = blocks.nearest(z, centers)
                centers = blocks.group_mean(z, label, centers)
            label, _gap = blocks.nearest(z, centers)
            used = blocks.members(label, k).any(axis=1)
            whole = np.flatnonzero(used.all(axis=1))
            if len(whole):
                out.append(rules(whole, k, centers[whole]))
            # Rules that no row is nearest to are dropped, then rows are assigned again.
            out += [rules(np.array([i]), k, centers[i][used[i]][None]) for i in np.flatnonzero(~used.all(axis=1))]
        return out

    def visit(batches):
        for table in whole_groups(batches, KEYS, ("step",), limit):
            first = starts(table, KEYS)
            ends = np.append(first[1:], table.num_rows)
            lag, features = table.column("lag").to_numpy(), Lists(table.column("features"))
            ids = table.column("series_id").combine_chunks()
            alike: dict = {}
            for a, b in zip(first.tolist(), ends.tolist()):
                if b - a > limit:
                    raise ValueError(TOO_LONG)
                alike.setdefault((int(lag[a]), b - a), []).append((a, b))
            for (p, n), found in alike.items():
                x = np.stack([features.rows(a, b).reshape(n, p) for a, b in found])
                yield from covered(ids.take(pa.array([a for a, _b in found])), p, x)

    lags = F.explode(F.array(*[F.lit(int(p)) for p in order_list])).alias("lag")
    per_lag = prior.select("*", lags).filter(F.col("step") >= F.col("lag")).withColumn("features", F.slice("features", F.lit(1), F.col("lag")))
    return spread_keys(per_lag, *KEYS).sortWithinPartitions(*KEYS).mapInArrow(visit, COVER_SCHEMA)


def _each(column: str, width: int, measure) -> Column:
    """``measure`` of every coordinate as an array; lags of less than ``width`` leave NULLs behind their own."""
    return F.array(*[measure(F.get(column, F.lit(i))) for i in range(width)])


def _cover_rounds(prior: DataFrame, order_list: Sequence[int], max_rules: int) -> DataFrame:
    """Centers for all series and lags together in ``max_rules`` rounds; each round is one map-side combined max."""
    widest = max(int(p) for p in order_list)
    lags = F.explode(F.array(*[F.lit(int(p)) for p in order_list])).alias("lag")
    x = prior.select("series_id", "step", "features", lags).filter(F.col("step") >= F.col("lag")).select(
        *KEYS, "step", F.slice("features", F.lit(1), F.col("lag")).alias("x")
    )
    own = F.lit(1), F.col("lag")
    stats = x.groupBy(*KEYS).agg(
        F.count("*").alias("n_prior"), _each("x", widest, F.avg).alias("feature_mean"), _each("x", widest, F.stddev_pop).alias("feature_scale")
    ).withColumns({
        "feature_mean": F.slice("feature_mean", *own),
        "feature_scale": F.transform(F.slice("feature_scale", *own), lambda s: F.when(s > EPSILON, s).otherwise(1.0)),
    })
    z = x.join(stats, list(KEYS)).select(
        *KEYS, "step",
        F.transform(
            F.arrays_zip("x", "feature_mean", "feature_scale"),
            lambda t: (t["x"] - t["feature_mean"]) / t["feature_scale"],
        ).alias("z"),
    )
    # Every round reads these rows, so they are written once to shared storage.
    z = cut_lineage(z)
    zero = F.transform("z", lambda v: v * 0.0)
    first = z.groupBy(*KEYS).agg(
        F.min_by("z", F.struct(mean_square_gap(F.col("z"), zero).alias("d"), "step")).alias("pick")
    )
    centers = cut_lineage(first.select(*KEYS, F.array("pick").alias("picks"), F.array().cast("array<double>").alias("reach")))
    for k in range(1, max_rules + 1):
        near = F.array_min(F.transform("picks", lambda c: mean_square_gap(F.col("z"), c)))
        far = (
            z.join(centers.select(*KEYS, "picks"), list(KEYS))
            .withColumn("near", near)
            .groupBy(*KEYS)
            .agg(F.max("near").alias("far"), F.max_by("z", F.struct("near", (-F.col("step")).alias("s"))).alias("pick"), F.count("*").alias("n"))
        )
        grown = centers.join(far, list(KEYS))
        full = F.size("picks") >= F.least(F.lit(max_rules), F.col("n"))
        done = F.size("reach") >= F.size("picks")
        centers = cut_lineage(
            grown.select(
                *KEYS,
                F.when(full, F.col("picks")).otherwise(F.concat("picks", F.array("pick"))).alias("picks"),
                F.when(done, F.col("reach")).otherwise(F.concat("reach", F.array(F.sqrt("far")))).alias("reach"),
            )
        )
    cuts = centers.select(
        *KEYS, F.explode(F.sequence(F.lit(1), F.size("picks"))).alias("k"), "picks"
    ).select(*KEYS, "k", F.slice("picks", F.lit(1), F.col("k")).alias("centers"))
    for _ in range(REFINEMENTS):
        cuts = cut_lineage(_refine(z, cuts, widest))
    # Rules that no row is nearest to are dropped, then rows are assigned again.
    used = _assign(z, cuts).groupBy(*KEYS, "k").agg(F.array_sort(F.collect_set("rule")).alias("used"))
    kept = cuts.join(used, [*KEYS, "k"]).select(
        *KEYS, "k", (F.size("centers") - F.size("used")).alias("empty"),
        F.transform("used", lambda j: F.col("centers")[j]).alias("centers"),
    )
    kept = cut_lineage(kept)
    labelled = _assign(z, kept)
    wide = z.groupBy(*KEYS).agg(_each("z", widest, F.stddev_pop).alias("wide")).withColumn(
        "wide", F.transform(F.slice("wide", *own), lambda s: F.when(s > EPSILON, s).otherwise(1.0))
    )
    per_rule = labelled.groupBy(*KEYS, "k", "rule").agg(
        F.count("*").alias("support"), F.max("gap").alias("gap"), _each("z", widest, F.stddev_pop).alias("sd")
    ).withColumn("sd", F.slice("sd", *own)).join(wide, list(KEYS))
    spread = F.transform(
        F.arrays_zip("sd", "wide"),
        lambda t: F.least(
            F.greatest(
                F.when((F.col("support") >= 2) & (t["sd"] > EPSILON), t["sd"]).otherwise(t["wide"]), F.lit(SPREAD_FLOOR)
            ),
            F.lit(SPREAD_CEILING),
        ),
    )
    # At most max_rules entries per group.
    packed = per_rule.withColumn("spread", spread).groupBy(*KEYS, "k").agg(
        F.array_sort(F.collect_list(F.struct("rule", "spread", "support"))).alias("r"), F.max("gap").alias("gap")
    )
    return (
        kept.join(packed, [*KEYS, "k"])
        .join(stats, list(KEYS))
        .join(centers.select(*KEYS, "reach"), list(KEYS))
        .select(
            *KEYS, F.col("k").cast("int").alias("k"), "n_prior", "feature_mean",
            "feature_scale", "reach", F.size("centers").alias("rule_count"), F.col("empty").cast("int").alias("empty"),
            F.greatest(F.sqrt("gap"), F.lit(EPSILON)).alias("realized"), F.col("r.support").alias("support"),
            F.flatten("centers").alias("centers"), F.flatten("r.spread").alias("spreads"),
        )
    )


def _assign(z: DataFrame, cuts: DataFrame) -> DataFrame:
    """Each row with its nearest center of every cut; the lower rule wins a tie."""
    gaps = F.transform("centers", lambda c: mean_square_gap(F.col("z"), c))
    return (
        z.join(cuts, list(KEYS))
        .withColumn("_gaps", gaps)
        .withColumn("gap", F.array_min("_gaps"))
        .withColumn("rule", (F.array_position("_gaps", F.col("gap")) - 1).cast("int"))
        .drop("_gaps", "centers")
    )


def _refine(z: DataFrame, cuts: DataFrame, widest: int) -> DataFrame:
    means = _assign(z, cuts).groupBy(*KEYS, "k", "rule").agg(_each("z", widest, F.avg).alias("center"))
    moved = means.withColumn("center", F.slice("center", F.lit(1), F.col("lag")))
    old = cuts.select(*KEYS, "k", F.posexplode("centers").alias("rule", "old"))
    new = old.join(moved, [*KEYS, "k", "rule"], "left").withColumn("center", F.coalesce("center", "old"))
    ordered = F.array_sort(F.collect_list(F.struct("rule", "center")))
    return new.groupBy(*KEYS, "k").agg(ordered["center"].alias("centers"))


def cut_for_radius(reach: Column, radius: Column) -> Column:
    """Number of picks until the cover radius is within ``radius`` (all picks if never)."""
    enough = F.filter(
        F.sequence(F.lit(1), F.size(reach)), lambda k: F.get(reach, k - 1) <= radius
    )
    return F.coalesce(F.get(enough, F.lit(0)), F.size(reach)).cast("int")


def parameter_counts(rules: Column, lag: Column) -> dict[str, Column]:
    antecedent = 2 * rules * lag
    consequent = rules * (lag + 1)
    return {
        "antecedent_parameter_count": antecedent,
        "consequent_parameter_count": consequent,
        "total_parameter_count": antecedent + consequent,
    }


# --- expressions for rows that carry their rules -----------------------------------------


def as_rules(flat: Column, rules: Column, lag: Column) -> Column:
    """Row-major values back as one array per rule."""
    return F.transform(F.sequence(F.lit(0), rules - 1), lambda i: F.slice(flat, i * lag + 1, lag))


def standardize(features: Column, mean: Column, scale: Column) -> Column:
    centered = F.zip_with(features, mean, lambda v, m: v - m)
    return F.zip_with(centered, scale, lambda v, s: v / s)


def firing_strengths(z: Column, centers: Column, spreads: Column, active: Column) -> Column:
    """Normalised rule weights of one row; the higher rule wins a tie at the cut."""

    def log_weights(zz: Column) -> Column:
        return F.transform(
            F.arrays_zip(centers.alias("c"), spreads.alias("s")),
            lambda r: -0.5
            * F.aggregate(
                F.zip_with(F.zip_with(zz, r["c"], lambda a, b: a - b), r["s"], lambda d, s: (d / s) * (d / s)),
                F.lit(0.0),
                lambda acc, v: acc + v,
            ),
        )

    def weights(log_w: Column) -> Column:
        ranked = F.sort_array(F.transform(log_w, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), asc=False)
        # Everything below the last kept (value, rule) pair is cut.
        return let(
            F.struct(F.get(ranked, active - 1).alias("last"), F.array_max(log_w).alias("top")),
            lambda c: F.transform(
                log_w,
                lambda v, i: F.when(F.struct(v.alias("v"), i.alias("i")) >= c["last"], F.exp(v - c["top"])).otherwise(F.lit(0.0)),
            ),
        )

    def normalised(raw: Column) -> Column:
        return let(total(raw), lambda norm: F.transform(raw, lambda v: v / norm))

    return let(z, lambda zz: let(log_weights(zz), lambda log_w: let(weights(log_w), normalised)))


def design_row(z: Column, weights: Column) -> Column:
    return let(
        F.concat(F.array(F.lit(1.0)), z), lambda one_z: F.flatten(F.transform(weights, lambda w: F.transform(one_z, lambda v: w * v)))
    )


def rule_forecast(z: Column, centers: Column, spreads: Column, active: Column, coefficients: Column) -> Column:
    """Weighted sum of the rules' affine forecasts; ``coefficients`` holds one array per rule."""
    return let(
        z,
        lambda zz: let(
            F.concat(F.array(F.lit(1.0)), zz),
            lambda one_z: dot(
                firing_strengths(zz, centers, spreads, active), F.transform(coefficients, lambda c: dot(one_z, c))
            ),
        ),
    )


def rule_usage(rows: DataFrame, keys: Sequence[str], weights: str, threshold: float = 1e-8) -> DataFrame:
    """Usage diagnostics per model from rows holding rule weights."""
    keys = list(keys)
    # ``inline`` fixes the weights of a row once; a projection would repeat their expression.
    fixed = rows.select(*keys, F.inline(F.array(F.struct(F.col(weights).alias("_w"))))).withColumnRenamed("_w", weights)
    top = F.array_max(weights)
    per_row = fixed.select(
        *keys,
        (F.array_position(F.col(weights), top) - 1).alias("_hard"),
        F.size(F.filter(weights, lambda w: w > threshold)).alias("_active"),
        F.posexplode(weights).alias("rule", "w"),
    )
    per_rule = per_row.groupBy(*keys, "rule").agg(
        F.avg("w").alias("mean_weight"),
        F.count_if(F.col("_hard") == F.col("rule")).alias("hard_support"),
        F.avg("_active").alias("_mean_active"),
        F.max("_active").alias("_max_active"),
    )
    mean = F.col("mean_weight")
    entropy = -F.sum(F.when(mean > 0, mean * F.log(mean)).otherwise(0.0)) / F.log(F.count("*").cast("double"))
    return per_rule.groupBy(*keys).agg(
        F.count("*").alias("rule_count"),
        F.count_if(F.col("hard_support") > 0).alias("effective_rule_count"),
        F.min("hard_support").alias("minimum_hard_rule_support"),
        F.max("hard_support").alias("maximum_hard_rule_support"),
        F.first("_mean_active").alias("mean_active_rules"),
        F.first("_max_active").alias("maximum_active_rules"),
        F.when(F.count("*") > 1, entropy).otherwise(0.0).alias("rule_usage_entropy"),
    )

