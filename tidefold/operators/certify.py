"""Risk bounds as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions.arrays import total

LN2 = math.log(2.0)


def gaussian_kl(q_mean: Column, q_std: Column, p_mean: Column, p_std: Column) -> Column:
    """KL of diagonal Gaussians given as arrays, never below zero."""
    pairs = F.arrays_zip(q_mean.alias("qm"), q_std.alias("qs"), p_mean.alias("pm"), p_std.alias("ps"))
    terms = F.transform(
        pairs,
        lambda t: F.log((t["ps"] * t["ps"]) / (t["qs"] * t["qs"])) - 1.0
        + (t["qs"] * t["qs"] + (t["qm"] - t["pm"]) * (t["qm"] - t["pm"])) / (t["ps"] * t["ps"]),
    )
    return F.greatest(F.lit(0.0), 0.5 * total(terms))


def gaussian_kl_ratio(dimension: Column, location: Column, scale: Column, ratio: Column) -> Column:
    """Same when q_std = ratio * p_std and p_std = scale * base; ``location`` is sum(((q-p)/base)^2)."""
    r2 = ratio * ratio
    spread = dimension * (F.log(1.0 / r2) - 1.0 + r2)
    return F.greatest(F.lit(0.0), 0.5 * (spread + location / (scale * scale)))


def rule_code(rules: Column, max_rules: int, eta: float = LN2) -> Column:
    """Code length of a rule count under a geometric law on 1..max_rules."""
    norm = math.log(sum(math.exp(-eta * k) for k in range(1, max_rules + 1)))
    return F.when(
        rules.between(1, max_rules), eta * rules + F.lit(norm)
    ).otherwise(F.raise_error(F.lit("rule count outside its support")).cast("double"))


def structure_code(
    family: Column,
    rules: Column,
    families: int,
    lags: int,
    radii: int,
    alphas: int,
    max_rules: int,
    eta: float = LN2,
) -> Column:
    """Code length of a model structure: grid shares, rule count, and the radius where one is used."""
    base = math.log(families) + math.log(lags) + math.log(alphas)
    counted = F.lit(base) + rule_code(rules, max_rules, eta)
    return (
        F.when(family == "ridge", F.lit(base))
        .when(family == "fixed_k_dense_tsk", counted)
        .otherwise(counted + F.lit(math.log(max(radii, 1))))
    )


def fixed_grid_code(
    rules: Column, lags: int, radii: int, alphas: int, max_rules: int, eta: float = LN2
) -> Column:
    return F.lit(math.log(lags * radii * alphas)) + rule_code(rules, max_rules, eta)


def table_code(candidates: DataFrame, keys: Sequence[str], eta_rule: float, eta_dimension: float, eta_lag: float) -> DataFrame:
    """Code length of each distinct structure under a softmax of its complexity.

    The normaliser is a log-sum-exp per group: a max, then a sum of shifted
    exponentials, both map-side combined.
    """
    keys = list(keys)
    structure = ["lag_order", "radius", "ridge_alpha", "rule_count"]
    distinct = candidates.select(*keys, *structure).distinct().withColumn(
        "score",
        -(
            eta_rule * F.col("rule_count")
            + eta_dimension * F.col("rule_count") * (F.col("lag_order") + 1)
            + eta_lag * F.col("lag_order")
        ),
    )
    top = distinct.groupBy(*keys).agg(F.max("score").alias("_top"), F.count("*").alias("structures"))
    shifted = distinct.join(top, keys)
    norm = shifted.groupBy(*keys).agg(
        (F.first("_top") + F.log(F.sum(F.exp(F.col("score") - F.col("_top"))))).alias("log_normalizer"),
        F.first("structures").alias("structures"),
    )
    return distinct.join(norm, keys).withColumn("structure_kl", F.col("log_normalizer") - F.col("score"))


def match_structure(selected: DataFrame, codes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Code length of each selected structure; anything but one match fails the job.

    Lag and rule count are the equi-join; grid values may then differ by 1e-12.
    """
    keys = list(keys)
    right = codes.select(
        *keys, F.col("lag_order").alias("_lag"), F.col("rule_count").alias("_rules"), F.col("radius").alias("_to_radius"),
        F.col("ridge_alpha").alias("_to_alpha"), "structure_kl",
    )
    left = selected.withColumns(
        {"_lag": F.col("selected_lag"), "_radius": F.col("selected_radius"), "_alpha": F.col("selected_ridge_alpha"), "_rules": F.col("rule_count")}
    )
    on = [*keys, "_lag", "_radius", "_alpha", "_rules"]
    close = (F.abs(F.col("_radius") - F.col("_to_radius")) <= 1e-12) & (F.abs(F.col("_alpha") - F.col("_to_alpha")) <= 1e-12)
    met = left.select(*on).distinct().join(right, [*keys, "_lag", "_rules"]).filter(close)
    agg = met.groupBy(*on).agg(F.count("*").alias("_matches"), F.first("structure_kl").alias("structure_kl"))
    joined = left.join(agg, on, "left")
    return joined.filter(
        F.when(F.col("_matches") == 1, F.lit(True)).otherwise(
            F.raise_error(F.lit("a selected structure does not match exactly one candidate")).cast("boolean")
        )
    ).drop("_lag", "_radius", "_alpha", "_rules", "_matches")


def pointwise_loss(target: Column, center: Column, variance: Column, bound: Column) -> Column:
    """Upper value of the clipped squared loss of a Gaussian forecast, in [0, 1]."""
    y = F.least(F.greatest(target, -bound), bound)
    return F.least(F.lit(1.0), ((y - center) * (y - center) + variance) / (4.0 * bound * bound))


def certificate(risk: Column, kl: Column, temperature: Column, n: Column, delta: Column | float, mass: float) -> Column:
    """risk + t/8 + (KL + ln(1 / (delta * mass))) / (t * n), not capped."""
    share = F.lit(delta) if isinstance(delta, float) else delta
    return risk + temperature / 8.0 + (kl + F.log(1.0 / (share * mass))) / (temperature * n)


def best_certificate(
    risks: Column,
    n: Column,
    dimension: Column,
    location: Column,
    structure_kl: Column,
    scales: Sequence[float],
    ratios: Sequence[float],
    temperatures: Sequence[float],
    delta: float,
    extra_penalty: float = 0.0,
) -> Column:
    """Best entry of the (scale, ratio, temperature) grid as one struct.

    ``risks`` holds the mean loss per (scale, ratio) in grid order. The first
    minimum wins: entries compare by value, then by grid position.
    """
    # Everything that depends on the grid alone is worked out here, once.
    charge = math.log(len(scales)) + extra_penalty
    confidence = math.log(len(temperatures) / delta)
    grid = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"), F.lit(float(s)).alias("scale"), F.lit(float(r)).alias("ratio"),
                F.lit(0.5 / (s * s)).alias("pull"), F.lit(0.5 * (math.log(1.0 / (r * r)) - 1.0 + r * r)).alias("spread"),
            )
            for i, (s, r) in enumerate((s, r) for s in scales for r in ratios)
        ]
    )

    def entry(risk: Column, g: Column) -> Column:
        kl = F.greatest(F.lit(0.0), dimension * g["spread"] + location * g["pull"])
        return F.struct(risk.alias("risk"), kl.alias("kl"), (structure_kl + charge + kl).alias("whole"), g.alias("g"))

    def bounded(e: Column) -> Column:
        load = (e["whole"] + confidence) / n
        best = F.least(*[load / float(t) + (t / 8.0) for t in temperatures])
        return F.struct((e["risk"] + best).alias("certificate_untruncated"), e["g"]["i"].alias("grid_index"), e.alias("e"))

    best = F.array_min(F.transform(F.zip_with(risks, grid, entry), bounded))
    e = best["e"]
    load = (e["whole"] + confidence) / n
    temperature = F.array_min(
        F.array(*[F.struct((load / float(t) + (t / 8.0)).alias("v"), F.lit(i).alias("i"), F.lit(float(t)).alias("t"))
                  for i, t in enumerate(temperatures)])
    )["t"]
    return F.struct(
        best["certificate_untruncated"].alias("certificate_untruncated"), best["grid_index"].alias("grid_index"),
        e["g"]["scale"].alias("prior_scale"), e["g"]["ratio"].alias("posterior_ratio"), temperature.alias("temperature"),
        e["risk"].alias("empirical_gibbs_risk"), e["kl"].alias("gaussian_kl"), e["whole"].alias("total_kl"),
        F.least(F.lit(1.0), best["certificate_untruncated"]).alias("certificate"),
    )


def mixing_envelope(block: Column, tau: float, multiplier: float = 1.0) -> Column:
    return F.least(F.lit(1.0), multiplier * F.exp(-block / F.lit(float(tau))))


def effective_delta(allocated: Column, blocks: Column, envelope: Column) -> Column:
    return allocated - 2.0 * (blocks - 1) * envelope


def odd_block_means(
    rows: DataFrame, keys: Sequence[str], block_lengths: Sequence[int], losses: Sequence[Column], position: str = "at", n: str = "n"
) -> DataFrame:
    """``block_length, blocks, used_observations, risks`` per group: mean of each loss over the retained blocks 0, 2, 4, ...

    Retained blocks are complete, so the mean of their means is the mean of
    their rows: one pass with a conditional sum for each length and loss, added up
    before the shuffle, and no row is repeated or grouped by block. Lengths with
    fewer than two retained blocks have NULL risks.
    """
    keys, at = list(keys), F.col(position)
    sums = []
    for i, length in enumerate(block_lengths):
        used = (F.floor(at / length) % 2 == 0) & (at < 2 * length * F.floor(F.col(n) / (2 * length)))
        sums += [F.sum(F.when(used, loss)).alias(f"_sum_{i}_{j}") for j, loss in enumerate(losses)]
    grouped = rows.groupBy(*keys).agg(F.first(n).alias("_rows"), *sums)

    def entry(i: int, length: int) -> Column:
        blocks = F.floor(F.col("_rows") / (2 * length)).cast("long")
        risks = F.array(*[F.when(blocks >= 2, F.col(f"_sum_{i}_{j}") / (blocks * length)) for j in range(len(losses))])
        return F.struct(
            F.lit(int(length)).alias("block_length"), blocks.alias("blocks"), (2 * blocks * length).alias("used_observations"), risks.alias("risks")
        )

    return grouped.select(*keys, F.inline(F.array(*[entry(i, a) for i, a in enumerate(block_lengths)])))


def odd_block_risk(
    losses: DataFrame, keys: Sequence[str], block_lengths: Sequence[int], loss: str = "loss", position: str = "at", n: str = "n"
) -> DataFrame:
    """Mean loss over the retained blocks for each block length.

    ``at`` is the zero-based place of a row among the ``n`` rows of its group.
    Every length needs at least two retained blocks; others come back with
    ``blocks`` below two and no risk.
    """
    means = odd_block_means(losses, keys, block_lengths, [F.col(loss)], position, n)
    return means.withColumn("block_risk", F.col("risks")[0]).drop("risks")


# Statuses a verified mixing bound must carry.
VERIFIED = {
    "stationarity_status": "verified_stationary",
    "frozen_feature_map_status": "verified_independent_or_valid_gap",
    "envelope_verification_status": "verified_external_upper_bound",
}


def evidence_complete() -> Column:
    parts = F.lit(True)
    for name, value in VERIFIED.items():
        parts = parts & (F.col(name) == value)
    return parts & (F.trim("source_reference") != "")


def recompute_gap(stored: str, recomputed: Column) -> Column:
    """Largest distance between stored and recomputed bounds."""
    return F.max(F.abs(F.col(stored) - recomputed))


def mixing_profile(
    rows: DataFrame,
    block_lengths: Sequence[int],
    scales: Sequence[float],
    ratios: Sequence[float],
    temperatures: Sequence[float],
    delta: float,
    tau: float,
    multiplier: float = 1.0,
) -> DataFrame:
    """Best bound per series and block length under an assumed mixing envelope.

    ``rows`` is the certification sample of one model per series: ``series_id,
    at, n, y, center, square_size, dimension, q_square, clip_bound,
    structure_kl`` with ``square_size`` the squared length of the design row and
    ``q_square`` that of the coefficients (the prior is centered at zero with one
    deviation for all coefficients). Lengths that leave under two blocks, or no
    confidence, come back with that status.
    """
    pairs = [(float(s), float(r)) for s in scales for r in ratios]
    model = ["series_id", "n", "dimension", "q_square", "structure_kl"]
    losses = [
        pointwise_loss(F.col("y"), F.col("center"), F.lit((s * r) ** 2) * F.col("square_size"), F.col("clip_bound")) for s, r in pairs
    ]
    means = odd_block_means(rows, model, block_lengths, losses)
    grid = F.array(*[F.struct(F.lit(s).alias("scale"), F.lit(r).alias("ratio"), F.get("risks", F.lit(i)).alias("block_risk")) for i, (s, r) in enumerate(pairs)])
    risk = means.select("*", F.inline(grid)).drop("risks")
    allocated = delta / len(block_lengths)
    a, mu = F.col("block_length"), F.col("blocks")
    envelope = mixing_envelope(a, tau, multiplier)
    kl = gaussian_kl_ratio(F.col("dimension"), F.col("q_square"), F.col("scale"), F.col("ratio"))
    shared = risk.withColumns(
        {
            "assumed_beta_upper": envelope,
            "mixing_residual": 2.0 * (mu - 1) * envelope,
            "effective_delta": effective_delta(F.lit(allocated), mu, envelope),
            "gaussian_kl": kl,
            "total_kl": kl + F.col("structure_kl") + math.log(len(scales)),
        }
    )
    feasible = (mu >= 2) & (F.col("effective_delta") > 0)
    mass = 1.0 / len(temperatures)
    steps = shared.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])))
    value = F.least(
        F.lit(1.0),
        certificate(F.col("block_risk"), F.col("total_kl"), F.col("temperature"), mu, F.col("effective_delta"), mass),
    )
    key = F.struct(
        F.col("certificate"), F.col("total_kl"), F.col("block_risk"), F.col("temperature"), F.col("scale"), F.col("ratio"),
    )
    best = steps.withColumn("certificate", F.when(feasible, value)).groupBy("series_id", "block_length").agg(
        F.first("blocks").alias("effective_sample_size"), F.first("used_observations").alias("used_observations"),
        F.first("assumed_beta_upper").alias("assumed_beta_upper"), F.first("mixing_residual").alias("mixing_residual"),
        F.first("effective_delta").alias("effective_delta"),
        F.min(F.when(F.col("certificate").isNotNull(), key)).alias("_b"),
    )
    few = F.col("effective_sample_size") < 2
    status = F.when(few, "INSUFFICIENT_BLOCKS").when(F.col("effective_delta") <= 0, "INFEASIBLE_CONFIDENCE").otherwise("PASS")
    out = best.withColumn("status", status).withColumns(
        {
            "certificate": F.col("_b.certificate"), "total_kl": F.col("_b.total_kl"), "block_risk": F.col("_b.block_risk"),
            "temperature": F.col("_b.temperature"), "prior_scale": F.col("_b.scale"), "posterior_ratio": F.col("_b.ratio"),
            "allocated_delta": F.lit(allocated),
        }
    )
    blank = ("assumed_beta_upper", "mixing_residual", "effective_delta")
    out = out.withColumns({c: F.when(~few, F.col(c)) for c in blank})
    zeroed = ("effective_sample_size", "used_observations")
    return out.withColumns({c: F.when(few, F.lit(0)).otherwise(F.col(c)) for c in zeroed}).drop("_b")


def best_block_length(profile: DataFrame) -> DataFrame:
    """The block length with the smallest bound; ties by divergence, risk, length."""
    key = F.struct("certificate", "total_kl", "block_risk", "block_length")
    row = F.struct("block_length", "certificate", "total_kl", "block_risk", "temperature", "prior_scale", "posterior_ratio")
    return profile.filter(F.col("status") == "PASS").groupBy("series_id").agg(F.min_by(row, key).alias("_b")).select("series_id", "_b.*")
