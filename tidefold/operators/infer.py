"""Resampling and paired tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.functions import draws
from tidefold.functions import metrics as m
from tidefold.functions.text import digest_head
from tidefold.operators.ordered import CHUNK, average_rank, chunk_of, fits, number_rows, with_medians
from tidefold.session import spread_keys, store

NEAR_ZERO = 1e-8


def holm(df: DataFrame, families: Sequence[str], p: str = "p_value", name: str = "p_holm") -> DataFrame:
    """Holm step-down inside each family of tests.

    A family has one row per test, so the window is short.
    """
    ordered = Window.partitionBy(*families).orderBy(p)
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*families)
    left = F.count("*").over(whole) - F.row_number().over(ordered) + 1
    return (
        df.withColumn("_step", F.least(F.lit(1.0), left * F.col(p)))
        .withColumn(name, F.max("_step").over(running))
        .drop("_step")
    )


TILE = 500
CELLS = 1 << 21


def _tiles(groups: DataFrame, resamples: int, *keys: str) -> DataFrame:
    """Rows of ``groups`` once for each tile of replicates, dealt out by tile."""
    tiled = groups.withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(TILE))))
    return spread_keys(tiled.withColumn("_to", F.least(F.col("_from") + TILE, F.lit(resamples))), *keys, "_from")


def _parts(start: int, stop: int, width: int):
    """Runs of replicates whose draws fit in ``CELLS``."""
    step = max(1, CELLS // max(1, width))
    for at in range(start, stop, step):
        yield np.arange(at, min(at + step, stop))


def _tile_means(batches):
    """(group, mean) of every replicate of a tile; a group's values are one array."""
    for batch in batches:
        for group, key, start, stop, values in zip(*(batch.column(c) for c in ("_group", "_key", "_from", "_to", "_values"))):
            values = values.values.to_numpy()
            n = len(values)
            for reps in _parts(start.as_py(), stop.as_py(), n):
                means = values[draws.draw_array(n, key.as_py(), reps, np.arange(n))].mean(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([group.as_py()] * len(reps), pa.string()), pa.array(means)], ["_group", "_m"])


def bootstrap_mean(
    values: DataFrame,
    keys: Sequence[str],
    value: str,
    id_column: str,
    resamples: int,
    seed: int = 0,
    confidence: float = 0.95,
    constant_shortcut: bool = True,
    chunk: int = CHUNK,
) -> DataFrame:
    """Percentile interval of the mean by hash draws.

    Values are numbered 0..n-1 in hash order. Each replicate draws n numbers;
    a draw is a hash of (group, replicate, place), so any task can make it and a
    lost task makes it again. A group of at most ``chunk`` values travels as one
    array with each tile of replicates, and a tile is drawn and summed as a
    whole: no row for a draw. In a larger group draws are rows that meet the
    values in a join on the number, which spreads the group over all tasks.
    NULL keys are groups.
    """
    keys = list(keys)
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    tagged = values.select(group.alias("_group"), *keys, F.col(id_column).alias("_id"), F.col(value).alias("_v")).withColumn(
        "_h", F.md5(F.col("_id").cast("string"))
    )
    bucket = F.conv(F.substring("_h", 1, 2), 16, 10).cast("int")
    # Both kinds of groups read the numbers.
    numbered = store(number_rows(tagged, ["_group"], [F.col("_h"), F.col("_id")], bucket, "_at").select("_group", *keys, "_at", "_v"))
    stats = numbered.groupBy("_group").agg(
        *[F.first(k).alias(k) for k in keys], F.count("*").alias("_n"), F.avg("_v").alias("_mean"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    ).withColumn("_key", digest_head(F.lit(seed), *[F.col(k) for k in keys]))
    sized = numbered.select("_group", "_at", "_v").join(stats.select("_group", "_n", "_key"), "_group")
    arrays = (
        sized.filter(F.col("_n") <= chunk).groupBy("_group", "_key")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"].cast("double")).alias("_values"))
    )
    small = _tiles(arrays, resamples, "_group").select("_group", "_key", "_from", "_to", "_values").mapInArrow(_tile_means, "_group string, _m double")
    large = sized.filter(F.col("_n") > chunk)
    # Each value row makes the draw of its own place in every replicate.
    places = large.select("_group", "_n", "_key", "_at", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_rep"))
    drawn = places.select("_group", "_rep", "_n", draws.draw(F.col("_n"), F.col("_key"), F.col("_rep"), F.col("_at")).alias("_at"))
    # Equal draws of a replicate are counted before they meet the values.
    counted = drawn.groupBy("_group", "_rep", "_n", "_at").agg(F.count("*").alias("_c"))
    means = (
        counted.join(numbered.select("_group", "_at", "_v"), ["_group", "_at"])
        .groupBy("_group", "_rep")
        .agg((F.sum(F.col("_v") * F.col("_c")) / F.first("_n")).alias("_m"))
        .select("_group", "_m")
        .unionByName(small)
    )
    tail = (1.0 - confidence) / 2.0
    out = means.groupBy("_group").agg(
        F.percentile("_m", F.lit(tail)).alias("ci_low"), F.percentile("_m", F.lit(1.0 - tail)).alias("ci_high")
    )
    out = out.join(stats, "_group")
    if constant_shortcut:
        # All values close to each other: the interval is the value itself.
        same = (F.col("_hi") - F.col("_lo")) <= NEAR_ZERO + 1e-5 * F.abs("_lo")
        out = out.withColumns(
            {"ci_low": F.when(same, F.col("_lo")).otherwise(F.col("ci_low")),
             "ci_high": F.when(same, F.col("_lo")).otherwise(F.col("ci_high"))}
        )
    return out.select(*keys, F.col("_n").alias("pair_count"), F.col("_mean").alias("mean"), "ci_low", "ci_high")


def signed_ranks(differences: DataFrame, keys: Sequence[str], value: str = "difference", zeros: str = "pratt") -> DataFrame:
    """Rank sums of a paired comparison with everything its p-value needs.

    ``pratt`` ranks zeros and then leaves them out of the sums; ``wilcox``
    drops them first.
    """
    keys = list(keys)
    base = differences.select(*keys, F.col(value).alias("_d")).withColumn("_a", F.abs("_d"))
    if zeros == "wilcox":
        base = base.filter(F.col("_a") > 0)
    elif zeros != "pratt":
        raise ValueError(f"Unknown zero rule {zeros}.")
    ranked = average_rank(base, keys, "_a", "_rank")
    sums = ranked.groupBy(*keys).agg(
        F.count("*").alias("pair_count"), F.count_if(F.col("_d") == 0).alias("zero_count"),
        F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_rank"))), F.lit(0.0)).alias("rank_sum_positive"),
        F.coalesce(F.sum(F.when(F.col("_d") < 0, F.col("_rank"))), F.lit(0.0)).alias("rank_sum_negative"),
        # Every row of a tie of size t adds (t^3 - t) / t = t^2 - 1.
        F.coalesce(F.sum(F.when(F.col("_a") > 0, F.col("_rank_ties") * F.col("_rank_ties") - 1)), F.lit(0)).alias("tie_term"),
    )
    n, z = F.col("pair_count").cast("double"), F.col("zero_count").cast("double")
    mean = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1)
    if zeros == "pratt":
        mean = mean - z * (z + 1) / 4.0
        var = var - z * (z + 1) * (2 * z + 1)
    sd = F.sqrt((var - F.col("tie_term") / 2.0) / 24.0)
    statistic = F.least("rank_sum_positive", "rank_sum_negative")
    return sums.withColumn("z_score", F.when(sd > 0, (statistic - mean) / sd).otherwise(F.lit(0.0)))


EXACT_PAIRS = 50
TERMS = 60


def exact_signed_rank_p(n: Column, low: Column) -> Column:
    """Two-sided p-value of the smaller rank sum of ``n`` untied pairs.

    The number of sign choices with each rank sum grows rank by rank: adding a
    rank convolves the counts with (1, 0, ..., 0, 1), a sum of the array with
    itself moved by that rank.
    """
    one = F.array(F.lit(1.0))

    def added(counts: Column, rank: Column) -> Column:
        gap = F.array_repeat(F.lit(0.0), rank)
        return F.zip_with(F.concat(counts, gap), F.concat(gap, counts), lambda stays, moves: stays + moves)

    # At most EXACT_PAIRS ranks, so at most 1,276 sums.
    counts = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), one, added)
    ways = F.aggregate(F.slice(counts, F.lit(1), F.round(low).cast("int") + 1), F.lit(0.0), lambda total, v: total + v)
    return F.least(F.lit(1.0), 2.0 * ways / F.pow(F.lit(2.0), n))


def erfc(x: Column) -> Column:
    """Complementary error function of ``x >= 0``: a series of positive terms near 0, a continued fraction beyond."""
    square = x * x
    start = F.struct(x.alias("term"), x.alias("total"))

    def grown(acc: Column, k: Column) -> Column:
        term = acc["term"] * 2.0 * square / (2 * k + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    near = 1.0 - F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, grown)["total"] * F.exp(-square) * (2.0 / math.sqrt(math.pi))
    depth = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), x, lambda acc, k: x + (k / 2.0) / acc)
    return F.when(x < 2.5, near).otherwise(F.exp(-square) / math.sqrt(math.pi) / depth)


def signed_rank_p(sums: DataFrame, name: str = "p_value") -> DataFrame:
    """Two-sided p-value for rows of :func:`signed_ranks`: exact for few untied pairs without zeros, else normal."""
    n, z = F.col("pair_count"), F.abs("z_score") / math.sqrt(2.0)
    exact = (n <= EXACT_PAIRS) & (F.col("zero_count") == 0) & (F.col("tie_term") == 0)
    p = (
        F.when(n == F.col("zero_count"), F.lit(1.0))
        .when(exact, exact_signed_rank_p(n, F.least("rank_sum_positive", "rank_sum_negative")))
        .otherwise(F.least(F.lit(1.0), erfc(z)))
    )
    return sums.withColumn(name, p)


def wilcoxon(differences: DataFrame, keys: Sequence[str], value: str = "difference", zeros: str = "pratt") -> DataFrame:
    """Wilcoxon signed-rank test per comparison.

    Comparisons whose differences are all near zero get p = 1.
    """
    keys = list(keys)
    sums = signed_ranks(differences, keys, value, zeros)
    flat = differences.groupBy(*keys).agg((F.max(F.abs(value)) <= NEAR_ZERO).alias("_flat"))
    return (
        flat.join(sums, keys, "left")
        .fillna({"pair_count": 0, "zero_count": 0, "tie_term": 0, "rank_sum_positive": 0.0, "rank_sum_negative": 0.0, "z_score": 0.0})
        .transform(signed_rank_p)
        .withColumn("p_value", F.when(F.col("_flat"), F.lit(1.0)).otherwise(F.col("p_value")))
        .drop("_flat")
    )


def rank_biserial(differences: DataFrame, keys: Sequence[str], value: str = "difference") -> DataFrame:
    """Matched-pairs rank-biserial correlation; near-zero differences are left out."""
    keys = list(keys)
    base = differences.select(*keys, F.col(value).alias("_d"), F.abs(value).alias("_a")).filter(F.col("_a") > NEAR_ZERO)
    ranked = average_rank(base, keys, "_a", "_rank")
    up = F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_rank"))), F.lit(0.0))
    down = F.coalesce(F.sum(F.when(F.col("_d") < 0, F.col("_rank"))), F.lit(0.0))
    effect = ranked.groupBy(*keys).agg(((up - down) / (up + down)).alias("rank_biserial"))
    everyone = differences.select(*keys).distinct()
    return everyone.join(effect, keys, "left").withColumn("rank_biserial", F.coalesce("rank_biserial", F.lit(0.0)))


def paired_statistics(
    differences: DataFrame,
    comparison: Sequence[str],
    id_column: str,
    resamples: int,
    families: Sequence[str],
    zeros: str = "pratt",
    seed: int = 0,
    constant_shortcut: bool = True,
) -> DataFrame:
    """Mean, median, interval, counts, p, Holm p and effect of every comparison."""
    keys = list(comparison)
    d = F.col("difference")
    counts = differences.groupBy(*keys).agg(
        F.count_if(d < 0).alias("left_lower_count"),
        F.count_if(d > 0).alias("left_higher_count"), F.count_if(F.abs(d) <= NEAR_ZERO).alias("ties"),
    )
    counts = with_medians(counts, differences, keys, {"median_difference": d})
    interval = bootstrap_mean(differences, keys, "difference", id_column, resamples, seed, constant_shortcut=constant_shortcut)
    tested = wilcoxon(differences, keys, zeros=zeros).select(*keys, "p_value")
    out = counts.join(interval, keys).join(tested, keys).join(rank_biserial(differences, keys), keys)
    return holm(out, families)


LOSSES = ("bs", "ds", "bc", "dc")


def _tile_gains(chunk: int):
    """(series, block length, gains) of every replicate of a tile, from prefix sums over the circle."""

    def gains(batches):
        for batch in batches:
            for series, length, n, key, start, stop, rows in zip(
                *(batch.column(c) for c in ("series_id", "block_length", "n", "_key", "_from", "_to", "_rows"))
            ):
                length, n, key = length.as_py(), n.as_py(), key.as_py()
                if n > chunk or len(rows.values) != n:
                    raise ValueError("A series is longer than the bound that was promised, or has gaps.")
                blocks = -(-n // length)
                tail = n - (blocks - 1) * length
                around = np.arange(n + length) % n
                sums = [np.concatenate([[0.0], np.cumsum(rows.values.field(k).to_numpy()[around])]) for k in LOSSES]
                for reps in _parts(start.as_py(), stop.as_py(), blocks):
                    begin = draws.draw_array(n, key, reps, np.arange(blocks))
                    # The last block of a replicate is cut so that n values are drawn.
                    end = begin + np.append(np.full(blocks - 1, length), tail)
                    bs, ds, bc, dc = ((p[end] - p[begin]).sum(axis=1) for p in sums)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([series.as_py()] * len(reps), pa.string()), pa.array(np.full(len(reps), length, np.int32)),
                            pa.array(1 - np.sqrt(ds) / np.sqrt(bs)), pa.array(1 - dc / bc),
                        ],
                        ["series_id", "block_length", "rmse", "cost"],
                    )

    return gains


def _running(rows: DataFrame, chunk: int) -> DataFrame:
    """Sums of the losses before each place of the circle, carried over chunk borders."""
    home = rows.withColumn("_chunk", chunk_of(F.col("at"), chunk))
    earlier = Window.partitionBy("series_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = home.groupBy("series_id", "_chunk").agg(*[F.sum(k).alias(f"_{k}") for k in LOSSES]).select(
        "series_id", "_chunk", *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0.0)).alias(f"_{k}") for k in LOSSES]
    )
    inside = Window.partitionBy("series_id", "_chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return home.join(carried, ["series_id", "_chunk"]).select(
        "series_id", "n", "at", *[(F.coalesce(F.sum(k).over(inside), F.lit(0.0)) + F.col(f"_{k}")).alias(k) for k in LOSSES]
    )


def _row_gains(rows: DataFrame, block_lengths: Sequence[int], resamples: int, seed: int, chunk: int) -> DataFrame:
    """The same gains where a series may be of any length: draws are rows that meet block sums."""
    longest = max(block_lengths)
    # The circle: rows come again behind the last one, as far as a block reaches.
    turns = F.sequence(F.col("at"), F.greatest(F.col("at"), F.col("n") + longest), F.col("n"))
    sums = store(_running(rows.withColumn("at", F.explode(turns)), chunk))
    lengths = F.explode(F.array(*[F.lit(int(v)) for v in block_lengths])).alias("block_length")
    begins = sums.filter(F.col("at") < F.col("n")).select("series_id", "n", F.col("at").alias("start"), *[F.col(k).alias(f"_{k}") for k in LOSSES], lengths)
    tail = F.when(F.col("n") % F.col("block_length") == 0, F.col("block_length")).otherwise(F.col("n") % F.col("block_length"))
    ends = begins.select("*", F.inline(F.array(*[
        F.struct(F.lit(last).alias("last"), (F.col("start") + width).alias("at")) for last, width in ((False, F.col("block_length")), (True, tail))
    ])))
    blocks = ends.join(sums.drop("n"), ["series_id", "at"]).select(
        "series_id", "block_length", "last", "start", *[(F.col(k) - F.col(f"_{k}")).alias(k) for k in LOSSES]
    )
    plan = rows.select("series_id", "n").distinct().select("series_id", "n", lengths)
    drawn = (
        plan.withColumns({"_blocks": F.ceil(F.col("n") / F.col("block_length")).cast("int"), "_key": digest_head(F.lit(seed), F.col("series_id"), F.col("block_length"))})
        .withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
        .transform(lambda df: spread_keys(df, "series_id", "block_length", "rep"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("series_id", "block_length", "rep", (F.col("j") == F.col("_blocks") - 1).alias("last"), draws.draw(F.col("n"), F.col("_key"), F.col("rep"), F.col("j")).alias("start"))
    )
    # n draws cancel in every ratio, so sums are enough.
    return (
        drawn.join(blocks, ["series_id", "block_length", "last", "start"])
        .groupBy("series_id", "block_length", "rep")
        .agg(*[F.sum(k).alias(k) for k in LOSSES])
        .select("series_id", "block_length", (1 - F.sqrt("ds") / F.sqrt("bs")).alias("rmse"), (1 - F.col("dc") / F.col("bc")).alias("cost"))
    )


def block_bootstrap(
    pairs: DataFrame,
    block_lengths: Sequence[int],
    resamples: int,
    primary: int | None = None,
    seed: int = 0,
    max_len: int | None = None,
    chunk: int = CHUNK,
    round_gain: int | None = None,
) -> DataFrame:
    """Paired circular block bootstrap of the gain of ``deployed`` over ``base``.

    ``pairs`` holds ``series_id, at, n, actual, base, deployed`` with places
    0..n-1. Block sums are differences of running sums over the circle, so a
    replicate adds ceil(n / L) differences whatever the block length. A series
    inside the bound is one array of running sums that meets tiles of
    replicates; a longer one is kept in rows.
    """
    y, b, d = F.col("actual"), F.col("base"), F.col("deployed")
    terms = {
        "bs": (y - b) * (y - b), "ds": (y - d) * (y - d),
        "bc": m.asymmetric_loss(y, b), "dc": m.asymmetric_loss(y, d),
    }
    rows = pairs.select("series_id", "at", "n", *[v.cast("double").alias(k) for k, v in terms.items()])
    observed = rows.groupBy("series_id").agg(
        F.first("n").alias("sample_size"),
        (1 - F.sqrt(F.avg("ds")) / F.sqrt(F.avg("bs"))).alias("observed_rmse_improvement"),
        (1 - F.avg("dc") / F.avg("bc")).alias("observed_cost_improvement"),
    )
    keys = ["series_id", "block_length"]
    if fits(max_len, chunk):
        circle = rows.groupBy("series_id").agg(F.first("n").cast("long").alias("n"), F.array_sort(F.collect_list(F.struct("at", *LOSSES))).alias("_rows"))
        lengths = F.explode(F.array(*[F.lit(int(v)) for v in block_lengths]))
        plan = circle.withColumn("block_length", lengths).withColumn("_key", digest_head(F.lit(seed), F.col("series_id"), F.col("block_length")))
        kind = dict(pairs.dtypes)["series_id"]
        gains = _tiles(plan.withColumn("series_id", F.col("series_id").cast("string")), resamples, *keys).mapInArrow(
            _tile_gains(chunk), "series_id string, block_length int, rmse double, cost double"
        ).withColumn("series_id", F.col("series_id").cast(kind))
    else:
        gains = _row_gains(rows, block_lengths, resamples, seed, chunk)
    if round_gain is not None:
        gains = gains.withColumns({c: F.round(c, round_gain) for c in ("rmse", "cost")})
    stats = []
    for c in ("rmse", "cost"):
        stats += [
            F.percentile(c, F.lit(0.025)).alias(f"{c}_ci_low"), F.percentile(c, F.lit(0.975)).alias(f"{c}_ci_high"),
            ((F.count_if(F.col(c) <= 0) + 1) / (F.count("*") + 1)).alias(f"{c}_bootstrap_probability_nonpositive"),
        ]
    out = gains.groupBy(*keys).agg(*stats, F.count("*").alias("bootstrap_resamples")).join(observed, "series_id")
    role = F.lit("sensitivity") if primary is None else F.when(F.col("block_length") == primary, "primary").otherwise("sensitivity")
    return out.withColumn("analysis_role", role)
