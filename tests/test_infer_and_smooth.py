import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidefold.functions import draws
from tidefold.functions.text import digest_head
from tidefold.operators import compare, infer, smooth


def diffs(spark, values, key="c"):
    rows = [(key, f"p{i}", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "comparison string, pair string, difference double")


def one(df):
    return df.first().asDict()


def test_exact_p_values(spark):
    assert one(infer.wilcoxon(diffs(spark, [1, 2, 3]), ["comparison"]))["p_value"] == pytest.approx(0.25)
    assert one(infer.wilcoxon(diffs(spark, [1, 2, 3, 4, 5]), ["comparison"]))["p_value"] == pytest.approx(0.0625)
    assert one(infer.wilcoxon(diffs(spark, [-1, 2, 3, 4, 5, 6]), ["comparison"]))["p_value"] == pytest.approx(0.0625)
    assert one(infer.wilcoxon(diffs(spark, [0, 0, 0]), ["comparison"]))["p_value"] == 1.0


def test_normal_p_value_with_zeros_and_ties(spark):
    values = [0, 0, 1, 1, -1, 2, 3, 3, 4, -5, 6, 7]
    got = one(infer.wilcoxon(diffs(spark, values), ["comparison"]))
    d = np.array(values, float)
    ranks = pd.Series(np.abs(d)).rank().to_numpy()
    n, z = len(d), 2
    low = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    ties = sum(t**3 - t for t in pd.Series(np.abs(d[d != 0])).value_counts())
    var = (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - ties / 2) / 24
    score = (low - (n * (n + 1) / 4 - z * (z + 1) / 4)) / math.sqrt(var)
    assert got["p_value"] == pytest.approx(math.erfc(abs(score) / math.sqrt(2)))
    dropped = one(infer.wilcoxon(diffs(spark, values), ["comparison"], zeros="wilcox"))
    assert dropped["pair_count"] == 10 and dropped["zero_count"] == 0


def test_rank_biserial(spark):
    values = [1.0, -2.0, 3.0, 3.0, 1e-12]
    r = pd.Series(np.abs(values[:4])).rank().to_numpy()
    want = (r[0] + r[2] + r[3] - r[1]) / r.sum()
    assert one(infer.rank_biserial(diffs(spark, values), ["comparison"]))["rank_biserial"] == pytest.approx(want)
    assert one(infer.rank_biserial(diffs(spark, [0.0, 0.0]), ["comparison"]))["rank_biserial"] == 0.0


def test_holm_by_hand(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("g", "a", 0.9)], "f string, m string, p_value double")
    got = {(r["f"], r["m"]): r["p_holm"] for r in infer.holm(df, ["f"]).collect()}
    assert got[("f", "a")] == pytest.approx(0.03) and got[("f", "c")] == pytest.approx(0.06)
    assert got[("f", "b")] == pytest.approx(0.06) and got[("g", "a")] == pytest.approx(0.9)


def test_bootstrap_of_a_constant_and_of_a_spread(spark):
    got = one(infer.bootstrap_mean(diffs(spark, [2.0] * 6), ["comparison"], "difference", "pair", 20))
    assert got["ci_low"] == got["ci_high"] == 2.0 and got["pair_count"] == 6
    values = np.arange(30.0)
    got = one(infer.bootstrap_mean(diffs(spark, values), ["comparison"], "difference", "pair", 400))
    half = 1.96 * values.std() / math.sqrt(30)
    assert got["ci_low"] == pytest.approx(values.mean() - half, abs=1.0) and got["ci_high"] == pytest.approx(values.mean() + half, abs=1.0)


@pytest.mark.parametrize("chunk,max_len", [(65_536, 50), (11, None)])
def test_block_bootstrap_equals_direct_resampling(spark, chunk, max_len):
    rng = np.random.default_rng(8)
    n, lengths, reps = 23, (4, 7), 40
    y = rng.normal(10, 2, n)
    b, d = y + rng.normal(0, 2, n), y + rng.normal(0, 1, n)
    df = spark.createDataFrame([("s", i, n, float(y[i]), float(b[i]), float(d[i])) for i in range(n)],
                               "series_id string, at long, n long, actual double, base double, deployed double")
    got = {r["block_length"]: r for r in infer.block_bootstrap(df, lengths, reps, primary=7, seed=1, max_len=max_len, chunk=chunk).collect()}
    for length in lengths:
        count = math.ceil(n / length)
        key = spark.range(1).select(digest_head(F.lit(1), F.lit("s"), F.lit(length))).first()[0]
        starts = draws.draw_array(n, key, np.arange(reps), np.arange(count))
        idx = ((starts[:, :, None] + np.arange(length)) % n).reshape(reps, -1)[:, :n]
        gains = 1 - np.sqrt(((y - d) ** 2)[idx].mean(1)) / np.sqrt(((y - b) ** 2)[idx].mean(1))
        cost = lambda f: 2 * np.maximum(y - f, 0) + np.maximum(f - y, 0)
        costs = 1 - cost(d)[idx].mean(1) / cost(b)[idx].mean(1)
        row = got[length]
        assert row["rmse_ci_low"] == pytest.approx(np.quantile(gains, 0.025)) and row["rmse_ci_high"] == pytest.approx(np.quantile(gains, 0.975))
        assert row["cost_ci_low"] == pytest.approx(np.quantile(costs, 0.025))
        assert row["rmse_bootstrap_probability_nonpositive"] == pytest.approx(((gains <= 0).sum() + 1) / (reps + 1))
        assert row["analysis_role"] == ("primary" if length == 7 else "sensitivity")


def test_paired_table(spark):
    rng = np.random.default_rng(9)
    rows = [(m, f"p{i}", float(v)) for m in ("x", "y") for i, v in enumerate(rng.normal(0.3, 1, 12))]
    df = spark.createDataFrame(rows, "comparison string, pair string, difference double").withColumn("family", F.lit("all"))
    got = infer.paired_statistics(df, ["comparison", "family"], "pair", 50, ["family"]).toPandas()
    assert len(got) == 2 and (got["p_holm"] >= got["p_value"]).all() and (got["ci_low"] <= got["mean"]).all()


def test_pairs_need_unique_keys_and_long_form(spark):
    left = spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, 3.0)], "k string, m double, n double")
    right = spark.createDataFrame([("a", 0.5, 1.0)], "k string, m double, n double")
    got = {r["metric"]: r["difference"] for r in compare.paired(left, right, ["k"], ["m", "n"]).collect()}
    assert got == {"m": 0.5, "n": 1.0}


def test_replaced_dataset_must_cover_the_series(spark):
    from pyspark.errors import PySparkException

    schema = "source string, dataset string, series_id string, rmse double"
    old = spark.createDataFrame([("r", "x", "1", 1.0), ("r", "y", "1", 1.0)], schema)
    assert compare.replace_dataset(old, spark.createDataFrame([("r", "x", "1", 2.0)], schema), "x").count() == 2
    with pytest.raises(PySparkException, match="do not match"):
        compare.replace_dataset(old, spark.createDataFrame([("r", "x", "2", 2.0)], schema), "x").collect()


def test_grid_decision_steps(spark):
    df = spark.createDataFrame([(0.2, 0.0, 0.0, 1.0, 2.0)], "upper_boundary_rate double, failure_rate double, selected_cap_rate double, mean_rmse_ratio_to_previous double, maximum_radius double")
    far = one(compare.grid_decision(df))
    near = one(compare.grid_decision(df, step=0.5, max_boundary=0.5))
    assert far["decision"] == "EXTEND_RADIUS_GRID" and far["suggested_next_maximum_radius"] == 3.0
    assert near["decision"] == "ACCEPT_RADIUS_GRID" and near["suggested_next_maximum_radius"] == 2.0


# --- smoothing ----------------------------------------------------------------------------


def rows_of(spark, y, train, score):
    n = len(y)
    role = ["prior"] * train + ["validation"] * score + ["test"] * (n - train - score)
    return spark.createDataFrame([("s", i, role[i], float(y[i])) for i in range(n)], "series_id string, step long, role string, value_imputed double")


def test_level_smoothing_recursion(spark):
    rng = np.random.default_rng(10)
    y = np.cumsum(rng.normal(size=80))
    got = smooth.forecast(rows_of(spark, y, 60, 20), smooth.ETS[:1], 7, ("prior",), "validation", 80).toPandas().sort_values("step")
    best = None
    for a in smooth.LEVELS:
        level, f = y[0], [np.nan]
        for t in range(1, 80):
            f.append(level)
            level += a * (y[t] - level)
        sse = sum((y[t] - f[t]) ** 2 for t in range(1, 60))
        if best is None or sse < best[0]:
            best = (sse, f[60:])
    assert np.allclose(got["forecast"], best[1]) and list(got["step"]) == list(range(60, 80))


def test_pure_cycle_is_forecast_exactly(spark):
    y = np.tile([1.0, 5.0, 2.0, 7.0], 30)
    specs = [smooth.ETS[3], smooth.SARIMA[0]]
    got = smooth.forecast(rows_of(spark, y, 80, 40), specs, 4, ("prior",), "validation", 120).toPandas()
    assert set(got["status"]) == {"ok"}
    assert np.allclose(got["forecast"], y[got["step"].astype(int)], atol=1e-6)


def test_autoregression_recovers_its_coefficient(spark):
    rng = np.random.default_rng(11)
    y = np.zeros(600)
    for t in range(1, 600):
        y[t] = 0.8 * y[t - 1] + rng.normal()
    spec = smooth.Spec("ar", "SARIMA", order=(1, 0, 0))
    got = smooth.forecast(rows_of(spark, y, 500, 100), [spec], 4, ("prior",), "validation", 600)
    phi = got.select(F.get_json_object("params", "$.ar[0]").cast("double")).first()[0]
    assert phi == pytest.approx(0.8, abs=0.08)


def test_short_series_is_a_failed_candidate_not_an_error(spark):
    got = smooth.forecast(rows_of(spark, np.arange(25.0), 15, 10), smooth.SARIMA[:1], 7, ("prior",), "validation", 25).toPandas()
    assert list(got["status"]) == ["failed"] and "short" in got["error"][0]


def test_benchmark_selects_and_compares(spark, series):
    from tidefold.plans.prepare import by_ratio_panel

    prepared = by_ratio_panel(spark.createDataFrame(series), 7, max_len=200)
    cands, summary = smooth.benchmark(prepared, 7, 200)
    s = summary.toPandas()
    assert cands.count() == 20 and len(s) == 4 and set(s["family"]) == {"ETS", "SARIMA"}
    assert np.allclose(s["test_rmse_improvement_vs_fallback"], (s["fallback_rmse"] - s["test_rmse"]) / s["fallback_rmse"])


def test_spec_rules():
    spec = smooth.SARIMA[4]
    assert spec.constant and spec.complexity == 4 and spec.minimum_length(7) == 20 and smooth.SARIMA[0].minimum_length(7) == 23
    assert smooth.SARIMA[1].candidate_id(7) == "sarima__p0_d1_q1__P0_D1_Q1_m7__trend_n"


@pytest.mark.parametrize("chunk", [65_536, 5])
def test_bootstrap_mean_equals_direct_resampling(spark, chunk):
    """Tiles of replicates and draws in rows give the same means, also for a NULL key and groups of both sizes."""
    rng = np.random.default_rng(12)
    groups = {"x": rng.normal(0, 1, 9), None: rng.normal(3, 1, 4), "one": np.asarray([2.5])}
    rows = [(g, f"p{i}", float(v)) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "comparison string, pair string, difference double")
    got = {r["comparison"]: r for r in infer.bootstrap_mean(df, ["comparison"], "difference", "pair", 700, 5, chunk=chunk).collect()}
    order = {f"p{i}": r[0] for i, r in enumerate(spark.range(9).select(F.md5(F.concat(F.lit("p"), "id"))).collect())}
    for name, values in groups.items():
        key = spark.range(1).select(digest_head(F.lit(5), F.lit(name).cast("string"))).first()[0]
        placed = values[sorted(range(len(values)), key=lambda i: order[f"p{i}"])]
        means = placed[draws.draw_array(len(values), key, np.arange(700), np.arange(len(values)))].mean(axis=1)
        assert got[name]["pair_count"] == len(values) and got[name]["mean"] == pytest.approx(values.mean())
        assert got[name]["ci_low"] == pytest.approx(np.quantile(means, 0.025)) and got[name]["ci_high"] == pytest.approx(np.quantile(means, 0.975))


def test_draws_agree_and_are_even(spark):
    n, key = 7, 123_456_789
    got = spark.range(40).select(*[draws.draw(F.lit(n), F.lit(key).cast("long"), F.col("id"), F.lit(j).cast("long")).alias(f"d{j}") for j in range(50)]).toPandas().to_numpy()
    assert (got == draws.draw_array(n, key, np.arange(40), np.arange(50))).all()
    share = np.bincount(draws.draw_array(n, key, np.arange(2000), np.arange(50)).ravel(), minlength=n) / 100_000
    assert np.abs(share - 1 / n).max() < 0.005


def test_erfc_and_exact_ranks(spark):
    xs = [0.0, 1e-9, 0.3, 1.0, 2.4999, 2.5, 3.0, 6.0, 12.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(infer.erfc(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(x) for x in xs], rel=1e-10)
    rows = [(n, low) for n in (1, 2, 5, 12, 50) for low in (0.0, n * (n + 1) / 8, n * (n + 1) / 4) if low == int(low)]
    found = spark.createDataFrame(rows, "n long, low double").coalesce(1).select("n", "low", infer.exact_signed_rank_p(F.col("n"), F.col("low")).alias("p")).collect()
    for r in found:
        ways = np.zeros(r["n"] * (r["n"] + 1) // 2 + 1)
        ways[0] = 1
        for rank in range(1, r["n"] + 1):
            ways[rank:] += ways[:-rank].copy()
        assert r["p"] == pytest.approx(min(1.0, 2 * ways[: int(r["low"]) + 1].sum() / 2.0 ** r["n"]))


@pytest.mark.parametrize("chunk", [8, 13, 4096])
def test_smoothing_of_chunks_equals_whole_series(spark, chunk):
    """Maps of chunks carried over borders give the values of one run, for all five forms, with a short series among them."""
    from tidefold.operators import smooth

    rng = np.random.default_rng(21)
    rows = []
    for name, n in (("a", 90), ("b", 61), ("short", 12)):
        y = 20 + np.cumsum(rng.normal(0, 0.5, n)) + 3 * np.sin(np.arange(n) * 2 * np.pi / 4)
        rows += [(name, i, "prior" if i < n // 2 else "bound" if i < 3 * n // 4 else "validation", float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "series_id string, step long, role string, value_imputed double")
    args = (smooth.ETS, 4, ("prior", "bound"), "validation")
    names = ["series_id", "candidate", "step"]
    want = smooth.forecast(df, *args, 1000).toPandas().sort_values(names).reset_index(drop=True)
    got = smooth.forecast_long(df, *args, chunk=chunk).toPandas().sort_values(names).reset_index(drop=True)
    assert (got[["series_id", "candidate", "status", "error", "n_train", "params"]].fillna("") == want[["series_id", "candidate", "status", "error", "n_train", "params"]].fillna("")).all().all()
    assert set(want["status"]) == {"ok", "failed"} and set(want["candidate"]) == {x.name for x in smooth.ETS}
    for column in ("aic", "bic", "step", "forecast"):
        assert np.allclose(got[column].astype(float), want[column].astype(float), equal_nan=True, rtol=1e-9)


def test_halves_of_a_difference_are_rounded_on_whole_numbers(spark):
    from decimal import ROUND_HALF_UP, Decimal

    from tidefold.functions.metrics import exact_round

    rng = np.random.default_rng(4)
    left = rng.integers(10**5, 3 * 10**6, 4_000)
    units = [(int(a), int(a) + int(b) * 100 + 50) for a, b in zip(left, rng.integers(-900, 900, 4_000))]
    df = spark.createDataFrame([(k, a / 1e6 - b / 1e6) for k, (a, b) in enumerate(units)], "k int, d double")
    got = {r["k"]: r["d"] for r in df.select("k", exact_round(F.col("d"), 4).alias("d")).collect()}
    want = {k: float(Decimal(a - b).scaleb(-6).quantize(Decimal("0.0001"), ROUND_HALF_UP)) for k, (a, b) in enumerate(units)}
    assert got == want


def test_exact_mean_does_not_depend_on_the_order(spark):
    from decimal import Decimal

    from tidefold.functions.metrics import exact_mean

    values = np.round(np.random.default_rng(9).uniform(1e4, 2e5, 20_000), 4).tolist()
    want = float(sum(Decimal(str(v)) for v in values)) / len(values)
    for rows in (values, sorted(values), sorted(values, reverse=True)):
        df = spark.createDataFrame([(v,) for v in rows], "v double").repartition(3)
        assert df.agg(exact_mean(F.col("v"))).first()[0] == want
    odd = spark.createDataFrame([(1.0,), (float("inf"),)], "v double")
    assert odd.agg(exact_mean(F.col("v"))).first()[0] == float("inf")
