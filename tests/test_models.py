import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidefold.functions import batches, blocks
from tidefold.operators import certify, select, sweep
from tidefold.operators.cover import as_rules, cover, design_row, firing_strengths
from tidefold.operators.linear import fit_linear, gram_rows, merge_grams, with_chunk
from tidefold.operators.sweep import Grid, block_id
from tidefold.plans import decide, develop, prepare

SMALL = Grid(lags=(2, 3), radii=(0.5, 1.0, 2.0), ridge_alphas=(0.01, 1.0), max_rules=4,
             families=("ridge", "fixed_k_dense_tsk", "dense_tsk", "sparse_tsk"), sparse_active=2)


@pytest.fixture(scope="module")
def prepared(spark, series):
    return prepare.by_ratio_panel(spark.createDataFrame(series), 7, max_len=200)


@pytest.fixture(scope="module")
def case(prepared):
    return decide.Case(prepared, SMALL, 7, "simple", 2, max_len=200)


# --- a direct dense version of the study for one series, used as the yardstick --------------


def yardstick(values, grid, delta):
    n = len(values)
    raw = n * np.array([0.20, 0.45, 0.15, 0.20])
    sizes = np.floor(raw).astype(int)
    for i in np.argsort(-(raw - sizes), kind="stable")[: n - sizes.sum()]:
        sizes[i] += 1
    role = np.repeat([0, 1, 2, 3], sizes)
    mu, sd = values[role == 0].mean(), values[role == 0].std()
    z = (values - mu) / sd
    out = {}
    for p in grid.lags:
        x = np.stack([z[p - k : n - k] for k in range(1, p + 1)], axis=1)
        y, r = z[p:], role[p:]
        fx = x[r == 0]
        fm, fs = fx.mean(0), fx.std(0)
        s = (fx - fm) / fs
        order = [int(np.argmin((s**2).mean(1)))]
        gap = ((s - s[order[0]]) ** 2).mean(1)
        steps = [math.sqrt(gap.max())]
        while len(order) < grid.max_rules:
            order.append(int(np.argmax(gap)))
            gap = np.minimum(gap, ((s - s[order[-1]]) ** 2).mean(1))
            steps.append(math.sqrt(gap.max()))

        def rules(k):
            c = s[order[:k]].copy()
            near = lambda c: ((s[:, None] - c[None]) ** 2).mean(2).argmin(1)
            for _ in range(2):
                a = near(c)
                c = np.array([s[a == j].mean(0) if (a == j).any() else c[j] for j in range(k)])
            c = c[np.unique(near(c))]
            a = near(c)
            w = np.array([s[a == j].std(0) if (a == j).sum() >= 2 else s.std(0) for j in range(len(c))])
            w = np.where(w > 1e-12, w, s.std(0))
            return c, np.clip(w, 0.15, 3.0)

        specs = [("ridge", None, 0, 1, 0)]
        c, _w = rules(grid.max_rules)
        if len(c) == grid.max_rules:
            specs.append(("fixed_k_dense_tsk", None, grid.max_rules, grid.max_rules, grid.max_rules))
        for radius in grid.radii:
            k = next((i + 1 for i, v in enumerate(steps) if v <= radius), None)
            if k is not None:
                size = len(rules(k)[0])
                specs += [("dense_tsk", radius, k, size, size), ("sparse_tsk", radius, k, size, min(grid.sparse_active, size))]
        for family, radius, k, size, active in specs:
            if k == 0:
                d = np.hstack([np.ones((len(x), 1)), x])
            else:
                c, w = rules(k)
                t = (x - fm) / fs
                lw = -0.5 * (((t[:, None] - c[None]) / w[None]) ** 2).sum(2)
                keep = np.argsort(lw, axis=1, kind="stable")[:, -active:]
                mask = np.full_like(lw, -np.inf)
                np.put_along_axis(mask, keep, np.take_along_axis(lw, keep, 1), 1)
                f = np.exp(mask - mask.max(1, keepdims=True))
                f /= f.sum(1, keepdims=True)
                d = (f[:, :, None] * np.hstack([np.ones((len(x), 1)), t])[:, None]).reshape(len(x), -1)
            for alpha in grid.ridge_alphas:
                solve = lambda q: np.linalg.solve(d[r == q].T @ d[r == q] + alpha * np.eye(d.shape[1]), d[r == q].T @ y[r == q])
                pm, qm = solve(0), solve(1)
                inv = np.diag(np.linalg.inv(d[r == 0].T @ d[r == 0] + alpha * np.eye(d.shape[1])))
                rv = max(1e-4, ((y[r == 0] - d[r == 0] @ pm) ** 2).mean())
                base = np.sqrt(np.clip(rv * inv, 1e-6, 100))
                bound = max(1.0, grid.clip_multiplier * np.abs(y[r == 0]).max())
                e = (y[r == 2] - d[r == 2] @ qm) * sd
                cert = (r == 1) | (r == 2)
                code = math.log(4) + math.log(len(grid.lags)) + math.log(len(grid.ridge_alphas))
                if family != "ridge":
                    code += math.log(2) * size + math.log(sum(2.0**-i for i in range(1, grid.max_rules + 1)))
                if radius is not None:
                    code += math.log(len(grid.radii))
                best = math.inf
                yc = np.clip(y[cert], -bound, bound)
                for scale in grid.prior_scales:
                    for ratio in grid.posterior_ratios:
                        second = (yc - d[cert] @ qm) ** 2 + (d[cert] ** 2) @ ((base * scale * ratio) ** 2)
                        risk = np.minimum(1, second / (4 * bound**2)).mean()
                        ps = base * scale
                        kl = 0.5 * np.sum(np.log(1 / ratio**2) - 1 + ratio**2 + ((qm - pm) / ps) ** 2)
                        total = code + math.log(len(grid.prior_scales)) + max(0.0, kl)
                        for t in grid.temperatures:
                            v = risk + t / 8 + (total + math.log(len(grid.temperatures) / delta)) / (t * cert.sum())
                            best = min(best, v)
                out[(family, p, radius, alpha)] = (math.sqrt((e**2).mean()), np.abs(e).mean(), best, size, d.shape[1])
    return out


def test_sweep_equals_direct_computation(case, series):
    got = case.candidates.toPandas()
    for name, part in got.groupby("series_id"):
        want = yardstick(series.loc[series.series_id == name, "value"].to_numpy(), SMALL, 0.05 / 2)
        rows = {
            (r.family, r.lag, None if pd.isna(r.radius) else r.radius, r.ridge_alpha):
            (r.validation_rmse, r.validation_mae, r.certificate_untruncated, r.rule_count, r.consequent_dimension)
            for r in part.itertuples()
        }
        assert rows.keys() == want.keys()
        for key, value in want.items():
            assert rows[key] == pytest.approx(value, rel=1e-6), key


def test_long_series_plan_gives_the_same(prepared, case):
    """Chunks of 32 rows: rounds over all series, two visits, merged sums."""
    other = decide.Case(prepared, SMALL, 7, "simple", 2, chunk=32)
    keys = ["series_id", "candidate_id", "family"]
    numbers = ["validation_rmse", "validation_mae", "validation_weighted_cost", "certificate_untruncated", "rule_usage_entropy",
               "mean_active_rules", "minimum_hard_rule_support", "validation_worst_block_rmse_improvement"]
    a = case.candidates.select(*keys, *numbers).toPandas().sort_values(keys).reset_index(drop=True)
    b = other.candidates.select(*keys, *numbers).toPandas().sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, rtol=1e-6, check_dtype=False)
    c = case.covers.toPandas().sort_values(["series_id", "lag", "k"]).reset_index(drop=True)
    d = other.covers.toPandas().sort_values(["series_id", "lag", "k"]).reset_index(drop=True)
    assert len(c) == len(d)
    for name in ("reach", "centers", "spreads", "support"):
        for u, v in zip(c[name], d[name]):
            assert np.allclose(u, v, atol=1e-8), name


def test_candidates_hold_no_test_columns(case):
    assert not [c for c in case.candidates.columns if c.startswith("test_")]


def test_decision_job_never_lists_the_test_files(case):
    plan = case._scored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "role" in plan
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "features" in line]
    assert scans and all("NOT (role" in s or "role#" in s.split("PartitionFilters")[1].split("]")[0] for s in scans)


def test_decisions_and_outcomes(case):
    decisions = case.decisions()
    rows = case.outcomes(decisions).toPandas()
    assert len(rows) == 2 and rows["decision_made_before_test_opening"].all()
    results = case.family_results().toPandas()
    assert set(results["family"]) == set(SMALL.families)
    picked = decisions.select("series_id", "selected.candidate_id").toPandas().set_index("series_id")["candidate_id"]
    pool = case.candidates.toPandas()
    for r in rows.itertuples():
        mine = pool[(pool.series_id == r.series_id) & (pool.certificate_untruncated <= 0.20) & (pool.certification_target_clipping_rate <= 0.05)]
        assert r.eligible_candidate_count == len(mine)
        if r.deployment != "seasonal_naive":
            assert picked[r.series_id] == mine.sort_values(["validation_rmse", "certificate_untruncated"]).iloc[0]["candidate_id"]


def test_development_sweep(prepared):
    grid = Grid(families=("ridge", "fixed_k_dense_tsk", "dense_tsk"), lags=(2,), radii=(1.0, 2.0), ridge_alphas=(0.1, 1.0), max_rules=3,
                fixed_k=(2, 3), clip_multiplier=1.0)
    sweep = develop.Sweep(prepared, grid, 2, max_len=200)
    selected = sweep.selected(per_count=True).toPandas()
    # ridge, radius, and one per fixed count, for two strategies and two series.
    fixed = selected[selected.family == "fixed_k_dense_tsk"]
    assert set(fixed["wanted_k"]) <= {2, 3}
    assert len(selected[selected.family == "ridge"]) == 4
    best = develop.best_fixed_count(sweep.selected(per_count=True)).toPandas()
    assert len(best) == 4
    c = sweep.candidates.toPandas()
    assert (c["certificate_pointwise_untruncated"] <= c["certificate_untruncated"] + 1e-12).all()


def test_rule_report_adds_up(case):
    won = decide.family_winners(case.candidates.filter("family = 'dense_tsk'"), "rmse_then_certificate")
    summary, detail = develop.rule_report(case.lagged, won.join(case.scale, "series_id"), case.covers)
    s, d = summary.toPandas(), detail.toPandas()
    assert np.allclose(s.groupby("series_id")["mean_firing"].sum(), 1.0)
    assert len(d) == sum(won.toPandas().set_index("series_id").loc[s["series_id"], "lag"])


# --- small pieces -------------------------------------------------------------------------


def test_ridge_path_equals_single_solves():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(80, 12)), rng.normal(size=80)
    alphas = (0.001, 0.1, 1.0)
    for a, (coef, diag) in zip(alphas, blocks.ridge_path(x.T @ x, x.T @ y, alphas)):
        g = x.T @ x + a * np.eye(12)
        assert np.allclose(coef, np.linalg.solve(g, x.T @ y), atol=1e-8)
        assert np.allclose(diag, np.diag(np.linalg.inv(g)), atol=1e-8)


def test_linear_models_from_merged_blocks(spark):
    rng = np.random.default_rng(4)
    n, p = 90, 3
    x = rng.normal(size=(n, p))
    y = 2.0 + x @ np.array([0.5, -0.3, 0.0]) + rng.normal(scale=0.1, size=n)
    rows = [("s", i + p, "bound", float(y[i]), x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, step long, role string, y double, features array<double>")
    grams = merge_grams(gram_rows(with_chunk(df, None, 16), [p]), ["series_id", "lag", "role"], 2)
    assert grams.count() == 1
    d = np.hstack([np.ones((n, 1)), x])
    ols = fit_linear(grams, "ols").first()
    assert np.allclose(ols["coefficients"], np.linalg.lstsq(d, y, rcond=None)[0], atol=1e-8)
    lasso = fit_linear(grams, "lasso", (0.05,)).first()["coefficients"]
    grad = x.T @ (y - lasso[0] - x @ np.array(lasso[1:])) / n
    for g, b in zip(grad, lasso[1:]):
        assert abs(g - 0.05 * np.sign(b)) < 1e-6 if b != 0 else abs(g) <= 0.05 + 1e-6
    with pytest.raises(ValueError):
        fit_linear(grams, "lasso", (0.0,))


def test_column_firing_equals_block_firing(spark):
    rng = np.random.default_rng(6)
    z, c, s = rng.normal(size=(40, 3)), rng.normal(size=(5, 3)), rng.uniform(0.2, 2, size=(5, 3))
    df = spark.createDataFrame([(i, z[i].tolist()) for i in range(40)], "i int, z array<double>")
    flat = {k: F.array(*[F.lit(float(v)) for v in m.ravel()]) for k, m in (("c", c), ("s", s))}
    for active in (5, 2):
        w = firing_strengths(F.col("z"), as_rules(flat["c"], F.lit(5), F.lit(3)), as_rules(flat["s"], F.lit(5), F.lit(3)), F.lit(active))
        got = df.select("i", w.alias("w"), design_row(F.col("z"), w).alias("d")).orderBy("i").toPandas()
        want = blocks.firing(z, c, s, active)
        assert np.allclose(np.stack(got["w"]), want) and np.allclose(want.sum(1), 1)
        assert ((want > 0).sum(1) <= active).all()
        assert np.allclose(np.stack(got["d"]), blocks.rule_design(z, want))


def test_active_rule_ties_keep_the_higher_rule():
    w = blocks.firing(np.zeros((1, 2)), np.ones((3, 2)), np.ones((3, 2)), 1)
    assert w.tolist() == [[0.0, 0.0, 1.0]]


def test_stored_bound_is_reproduced(spark):
    """One published bound and its parts."""
    parts = {"risk": 0.0191892, "kl": 7.2755911, "t": 0.25, "n": 1200}
    got = spark.range(1).select(
        certify.certificate(F.lit(parts["risk"]), F.lit(parts["kl"]), F.lit(parts["t"]), F.lit(parts["n"]), 0.05 / 30, 1 / 6)
    ).first()[0]
    assert got == pytest.approx(0.10198679443965242, abs=1e-6)


def test_divergence_is_zero_for_equal_laws(spark):
    a, b = F.array(F.lit(0.3), F.lit(-1.0)), F.array(F.lit(0.5), F.lit(2.0))
    row = spark.range(1).select(
        certify.gaussian_kl(a, b, a, b),
        certify.gaussian_kl(a, b, F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))),
        certify.gaussian_kl_ratio(F.lit(3), F.lit(0.0), F.lit(2.0), F.lit(1.0)),
    ).first()
    want = 0.5 * (math.log(1 / 0.25) - 1 + 0.25 + 0.09 + math.log(1 / 4) - 1 + 4 + 1)
    assert row[0] == 0 and row[1] == pytest.approx(want) and row[2] == 0


def test_structure_masses_sum_to_one(spark):
    rows = [("ridge", 1, 1)] + [("fixed_k_dense_tsk", k, 1) for k in (1, 2, 3)] + [(f, k, 2) for f in ("dense_tsk", "sparse_tsk") for k in (1, 2, 3)]
    df = spark.createDataFrame(rows, "family string, k int, radii int")
    code = certify.structure_code(F.col("family"), F.col("k"), 4, 2, 2, 2, 3)
    # two lags and two penalties for each row; two radii where one is used
    mass = df.select((F.exp(-code) * 4 * F.col("radii")).alias("m")).agg(F.sum("m")).first()[0]
    assert mass == pytest.approx(1.0)
    costs = [r[0] for r in df.filter("family = 'dense_tsk'").orderBy("k").select(code).collect()]
    assert costs == sorted(costs) and costs[0] < costs[-1]
    with pytest.raises(PySparkException, match="outside its support"):
        df.select(certify.rule_code(F.lit(9), 3)).collect()


def test_block_ids_match_even_splits(spark):
    for n in (7, 10, 11, 361):
        df = spark.range(n).select(F.col("id").alias("at"), F.lit(n).alias("n"))
        got = [r[0] for r in df.orderBy("at").select(block_id(F.col("at"), F.col("n"), 4)).collect()]
        want = np.concatenate([np.full(len(b), i) for i, b in enumerate(np.array_split(np.arange(n), 4))])
        assert got == want.tolist()


def test_missing_radius_sorts_last_and_keys_order(spark):
    rows = [("s", 1.0, 0.5, 3, 1, None, 0.1, 2), ("s", 1.0, 0.5, 3, 1, 2.0, 0.1, 2), ("s", 1.0, 0.5, 3, 1, 2.0, 0.01, 2)]
    df = spark.createDataFrame(
        rows, "series_id string, validation_rmse double, validation_mae double, consequent_dimension int, rule_count int, radius double, ridge_alpha double, lag int"
    )
    got = select.best(df, ["series_id"], "rmse").first()
    assert (got["radius"], got["ridge_alpha"]) == (2.0, 0.01)


def test_gates(spark):
    base = {
        "certificate_untruncated": 0.10, "certification_target_clipping_rate": 0.02, "validation_rmse_improvement_vs_fallback": 0.05,
        "validation_cost_improvement_vs_fallback": 0.05, "validation_rmse_nonnegative_blocks": 3, "validation_cost_nonnegative_blocks": 3,
        "validation_worst_block_rmse_improvement": -0.05, "validation_worst_block_cost_improvement": -0.05,
    }
    worse = {k: v + (1e-6 if k.startswith("cert") else -1 if isinstance(v, int) else -1e-6) for k, v in base.items()}
    rows = [base] + [{**base, k: worse[k]} for k in base]
    got = [r[0] for r in spark.createDataFrame(pd.DataFrame(rows)).coalesce(1).select(select.robust_gate()).collect()]
    assert got == [True] + [False] * len(base)


def test_evidence_needs_every_status(spark):
    good = {**certify.VERIFIED, "source_reference": "a paper"}
    rows = [good, {**good, "source_reference": "  "}, {**good, "stationarity_status": "assumed"}]
    got = [r[0] for r in spark.createDataFrame(pd.DataFrame(rows)).coalesce(1).select(certify.evidence_complete()).collect()]
    assert got == [True, False, False]


@pytest.mark.parametrize("digits", [4, 1, 0])
def test_large_samples_order_only_the_last_prefix(spark, monkeypatch, digits):
    """The lowest hashes of groups of any size, in whatever number of prefixes they are counted."""
    monkeypatch.setattr(select, "DIGITS", digits)
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "d").otherwise("e").alias("dataset"), F.concat(F.lit("s"), "id").alias("series_id"))
    got = select.first_by_hash(df, {"d": 1234, "e": 4000}, "ns")
    scored = df.withColumn("h", F.sha2(F.concat_ws("|", F.lit("ns"), "dataset", "series_id"), 256)).toPandas().sort_values(["dataset", "h"])
    want = [set(g.head(n)["series_id"]) for (_, g), n in zip(scored.groupby("dataset"), (1234, 4000))]
    rows = got.collect()
    assert [{r["series_id"] for r in rows if r["dataset"] == d} for d in "de"] == want and len(rows) == 5234
    assert got.columns == ["dataset", "series_id", "selection_hash"]


def test_samples_of_each_dataset(spark):
    rows = [("d" if i % 3 else "e", f"s{i}", i % 7) for i in range(90)]
    df = spark.createDataFrame(rows, "dataset string, series_id string, length int")
    sample = select.first_by_hash(df, {"d": 4, "e": 6}, "ns", strict=False)
    assert {r["dataset"]: r["n"] for r in sample.groupBy("dataset").agg(F.count("*").alias("n")).collect()} == {"d": 4, "e": 6}
    with pytest.raises(PySparkException, match="too few"):
        select.first_by_hash(df, {"d": 400}, "ns").collect()
    spread = select.stratified_sample(df, 9, 1).toPandas()
    assert (spread.groupby("dataset").size() == 9).all()
    assert (spread.groupby(["dataset", "stratum"]).size() == 3).all()
    # Fewer series than the target: all of them.
    assert select.stratified_sample(df.filter("dataset = 'e'"), 50, 1).count() == 30


def test_short_series_fail_alike_on_both_plans(spark):
    """A lag longer than the prior role has no rows there: both plans say so and build nothing for it."""
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"series_id": "s", "pos": np.arange(30), "value": rng.normal(size=30).cumsum()})
    short = prepare.by_ratio_panel(spark.createDataFrame(rows), 2, max_len=40)
    grid = Grid(lags=(3, 12), radii=(1.0,), ridge_alphas=(0.1,), max_rules=2, families=("ridge", "dense_tsk"), sparse_active=1)
    found = []
    for bound in ({"max_len": 40}, {"max_len": None, "chunk": 16}):
        one = decide.Case(short, grid, 2, "simple", **bound)
        specs = {(r["lag"], r["family"]): r["failure"] for r in one.specs.collect()}
        assert specs[12, "ridge"] == "no prior rows" and specs[12, "dense_tsk"] == "no prior rows" and specs[3, "ridge"] is None
        ids = sorted(r["candidate_id"] for r in one.candidates.collect())
        report = one.build_report().first()
        assert report["build_failures"] == 2 and len(ids) == report["candidate_count"]
        found.append(ids)
    assert found[0] == found[1] and found[0]


def test_stated_series_count_must_agree(prepared):
    with pytest.raises(ValueError, match="3 series, but there are 2"):
        decide.Case(prepared, SMALL, 7, "simple", 3, max_len=200)


def test_gram_sums_end_as_one_row(spark):
    rows = [("s", p, 1, 1.0, float(p), [1.0], [1.0]) for p in range(40)]
    frame = spark.createDataFrame(rows, "series_id string, part long, n long, yy double, max_abs double, rhs array<double>, gram array<double>")
    got = merge_grams(frame, ["series_id"], levels=0).collect()
    assert len(got) == 1 and got[0]["n"] == 40 and got[0]["gram"] == [40.0] and got[0]["max_abs"] == 39.0


def test_one_decomposition_serves_all_penalties():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 5))
    x = np.hstack([x, x[:, :1] + x[:, 1:2]])  # a singular Gram matrix
    gram, rhs = x.T @ x, x.T @ rng.normal(size=40)
    for (beta, diag), a in zip(blocks.ridge_path(gram, rhs, [0.01, 1.0, 10.0]), [0.01, 1.0, 10.0]):
        inverse = np.linalg.inv(gram + a * np.eye(6))
        assert beta == pytest.approx(inverse @ rhs, rel=1e-6) and diag == pytest.approx(np.diag(inverse), rel=1e-6)


def test_bounded_plan_takes_no_call_for_each_series(spark, prepared):
    """Covers and fits of many series are made together: no operator that calls Python once for a group."""
    rows = sweep.sweep_rows(sweep.lag_context(prepared, 3, 200), SMALL, 200)
    specs, scored, _covers = sweep.run_sweep(sweep.lag_context(prepared, 3, 200), SMALL, 200)
    plans = [df._jdf.queryExecution().toString() for df in (cover(rows, SMALL.lags, SMALL.max_rules, 200), scored)]
    assert all("MapInArrow" in p and "InPandas" not in p for p in plans)


def test_whole_groups_over_batches_of_any_size():
    """Groups that go on over batches stay whole and are sorted in themselves; one past the bound fails."""
    ids = ["a"] * 40_000 + [None] * 3 + ["b"] * 30_000 + ["c"] * 5
    step = list(range(len(ids)))[::-1]
    whole = pa.table({"id": pa.array(ids), "step": pa.array(step)})
    parts = list(batches.whole_groups(whole.to_batches(max_chunksize=7_000), ("id",), ("step",), 40_000))
    got = [(i, s) for t in parts for i, s in zip(t.column("id").to_pylist(), t.column("step").to_pylist())]
    assert [i for i, _s in got] == ids and sum(len(batches.starts(t, ("id",))) for t in parts) == 4
    assert sorted(s for _i, s in got) == sorted(step) and [s for i, s in got if i == "b"] == sorted(s for i, s in got if i == "b")
    with pytest.raises(ValueError, match="longer than the bound"):
        list(batches.whole_groups(whole.to_batches(max_chunksize=7_000), ("id",), ("step",), 30_000))


def test_covers_of_series_of_unlike_length_and_with_lost_rules(spark):
    """Series worked on together have the covers they have alone; copies of one point leave rules without rows."""
    rng = np.random.default_rng(3)
    rows = [(f"s{i}", t, "prior", [float(v) for v in (rng.normal(size=3) if i % 3 else np.full(3, t % 2))]) for i in range(12) for t in range(3, 30 + i % 4)]
    frame = spark.createDataFrame(rows, "series_id string, step long, role string, features array<double>")
    key = lambda r: (r["series_id"], r["lag"], r["k"])
    got = {key(r): r.asDict() for r in cover(frame, (2, 3), 4, 200).collect()}
    long = {key(r): r.asDict() for r in cover(frame, (2, 3), 4, 200, 16).collect()}
    assert got.keys() == long.keys() and any(r["empty"] for r in got.values())
    for name, r in got.items():
        assert all(r[c] == long[name][c] for c in ("n_prior", "rule_count", "empty", "support")), name
        for c in ("reach", "realized", "centers", "spreads", "feature_mean", "feature_scale"):
            assert r[c] == pytest.approx(long[name][c], abs=1e-9), (name, c)
