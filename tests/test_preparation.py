import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidefold.functions import metrics as m
from tidefold.functions.text import (
    candidate_id, flatten_schema, origin_of, override_origin, parse_boolean, parse_lags, plain_number, safe_name,
)
from tidefold.operators import impute, lags, quality, resample, roles


def loop_fill(values, season):
    first = next(i for i, v in enumerate(values) if v == v)
    work, last, out = list(values[first:]), None, []
    for i, v in enumerate(work):
        if v == v:
            source = "observed"
        elif i >= season:
            work[i], source = work[i - season], "seasonal_past"
        else:
            work[i], source = last, "last_observation"
        last = work[i]
        out.append((first + i, work[i], source))
    return out


@pytest.mark.parametrize("chunk", [None, 8, 24])
def test_fill_equals_loop(spark, chunk):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(12):
        n, season = int(rng.integers(15, 90)), 7
        values = np.where(rng.random(n) < 0.45, np.nan, rng.normal(size=n))
        values[-1] = 1.0
        rows += [(f"s{k}", i, None if v != v else float(v)) for i, v in enumerate(values)]
        want[f"s{k}"] = loop_fill(values, season)
    df = spark.createDataFrame(rows, "series_id string, pos long, value double")
    args = {"max_len": 100} if chunk is None else {"chunk": chunk}
    got = impute.seasonal_fill(df, 7, **args).toPandas().sort_values(["series_id", "pos"])
    for name, part in got.groupby("series_id"):
        assert list(zip(part["pos"], part["value_imputed"], part["imputation_source"])) == want[name]


@pytest.mark.parametrize("n,want", [(2000, (400, 900, 300, 400)), (2406, (481, 1083, 361, 481)), (4368, (874, 1966, 655, 873))])
def test_ratio_sizes(spark, n, want):
    sizes = roles.ratio_sizes(F.col("n"), {"prior": 0.20, "bound": 0.45, "validation": 0.15, "test": 0.20})
    row = spark.createDataFrame([(n,)], "n long").select(*[sizes[r].alias(r) for r in roles.ROLES]).first()
    assert tuple(row) == want


def test_horizon_sizes_and_variants(spark):
    def sizes(n, h, variant):
        plan = roles.horizon_sizes(F.col("n"), F.lit(h), 0.30, variant=variant)
        return tuple(spark.createDataFrame([(n,)], "n long").select(*[plan[r].alias(r) for r in roles.ROLES]).first())

    got = sizes(1000, 48, "capped")
    assert got[2:] == (48, 48) and sum(got[:2]) == 904
    # A short prefix: prior gives way to bound only in the capped form.
    assert sizes(21, 7, "capped") == (3, 4, 7, 7)
    assert sizes(21, 7, "strict") == (4, 3, 7, 7)


def test_roles_are_chronological_and_guarded(spark, series):
    filled = impute.seasonal_fill(spark.createDataFrame(series), 7, max_len=200)
    got = roles.by_ratio(filled, {"prior": 0.20, "bound": 0.45, "validation": 0.15, "test": 0.20}, max_len=200)
    same = roles.by_ratio(filled, {"prior": 0.20, "bound": 0.45, "validation": 0.15, "test": 0.20}, chunk=16)
    a = got.toPandas().sort_values(["series_id", "step"])
    b = same.toPandas().sort_values(["series_id", "step"])
    assert list(a["role"]) == list(b["role"])
    order = {r: i for i, r in enumerate(roles.ROLES)}
    for _name, part in a.groupby("series_id"):
        assert part["role"].map(order).is_monotonic_increasing
    bad = roles.forbidden_roles(got, ("prior", "bound")).toPandas()
    assert set(bad["role"]) == {"validation", "test"}


def test_short_series_fails_or_is_left_out(spark):
    df = spark.createDataFrame([("s", i, i, 1.0) for i in range(3)], "series_id string, pos long, step long, v double")
    shares = {"prior": 0.20, "bound": 0.45, "validation": 0.15, "test": 0.20}
    with pytest.raises(PySparkException, match="too short"):
        roles.by_ratio(df, shares, max_len=3).collect()
    assert roles.by_ratio(df, shares, max_len=3, on_short="drop").count() == 0


def test_scaler_fallback_and_strict(spark):
    df = spark.createDataFrame([("s", r, 5.0) for r in ("prior", "prior", "test")], "series_id string, role string, value_imputed double")
    got = roles.with_scaler(df, max_len=3).toPandas()
    assert got["scaler_fallback"].all() and (got["scaler_scale"] == 1.0).all() and (got["value_scaled"] == 0).all()
    with pytest.raises(PySparkException, match="no spread"):
        roles.with_scaler(df, strict=True, max_len=3).collect()


def test_lags_by_hand(spark):
    df = spark.createDataFrame(
        [("s", i, float(i), "prior" if i < 4 else "bound", i == 2) for i in range(8)],
        "series_id string, step long, value_scaled double, role string, was_imputed boolean",
    )
    got = lags.with_lags(df, 2, chunk=3).toPandas().sort_values("step")
    assert [list(v) for v in got["features"]] == [[i - 1.0, i - 2.0] for i in range(2, 8)]
    assert list(got["context_imputed_count"]) == [0, 1, 1, 0, 0, 0]
    inside = lags.with_lags(df, 2, history="same_split_only", max_len=8).toPandas()
    assert sorted(inside["step"]) == [2, 3, 6, 7]


def test_cost_is_two_to_one(spark):
    df = spark.createDataFrame([(10.0, 8.0, 12.0)], "y double, low double, high double")
    row = df.agg(m.weighted_cost(F.col("y"), F.col("low")), m.weighted_cost(F.col("y"), F.col("high"))).first()
    assert row[0] / row[1] == 2


def test_gain_variants(spark):
    df = spark.createDataFrame([(0.0, 1e-13), (-2.0, 1.0)], "b double, c double")
    rows = df.select(m.gain(F.col("b"), F.col("c"), "absolute"), m.gain(F.col("b"), F.col("c"), "floored")).collect()
    assert rows[0][0] == pytest.approx(-0.1) and rows[1][0] == pytest.approx(-1.5) and rows[1][1] == pytest.approx(-3e12)


def test_quality_report_names_each_issue(spark):
    rows = [("ok", i, i, 1.0) for i in range(3)] + [("bad", 0, 5, None), ("bad", 1, 5, float("nan")), ("bad", 2, 4, float("inf"))]
    df = spark.createDataFrame(rows, "series_id string, pos long, t long, value double")
    got = {r["series_id"]: r for r in quality.series_quality(df, expected_length=3, chunk=2).collect()}
    assert got["ok"]["status"] == "PASS" and got["ok"]["issues"] == ""
    assert got["bad"]["issues"] == "missing_values=2; nonfinite_values=3; duplicate_times=1; time_not_strictly_increasing"
    assert quality.series_quality(df, expected_length=4, max_len=9).filter("issues like '%unexpected_length=3;expected=4'").count() == 2


def test_incomplete_bucket_fails(spark):
    df = spark.createDataFrame([("s", 0, 23), ("s", 1, 22)], "series_id string, pos long, readings long")
    assert resample.require_complete(df.filter("pos = 0"), 23).count() == 1
    with pytest.raises(PySparkException, match="incomplete bucket 1"):
        resample.require_complete(df, 23).collect()


def test_unique_keys_guard_fires(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(PySparkException, match="duplicate keys"):
        quality.unique_keys(df, ["k"]).collect()
    assert quality.unique_keys(df, ["k", "v"]).count() == 2


def test_column_guards(spark):
    df = spark.createDataFrame([(1,)], "rmse int")
    with pytest.raises(ValueError, match="test metrics"):
        quality.without_test_columns(df)
    with pytest.raises(ValueError, match="missing columns"):
        quality.require_columns(df, ["x"])


def test_overall_status(spark):
    def status(*words):
        return quality.overall_status(spark.createDataFrame([(w,) for w in words], "status string")).first()["overall"]

    assert status("PASS", "PASS") == "PASS"
    assert status("PASS", "SENSITIVITY_ONLY") == "PASS_WITH_QUALIFICATIONS"
    assert status("FAIL", "SENSITIVITY_ONLY") == "FAIL"


def test_numbers_and_ids(spark):
    values = [0.0001, 0.001, 0.1, 1.0, 2.5, 12.0, 123456.789, 1e-5, 1.5e9, 0.75, 99999999.9, 1 / 3]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(plain_number(F.col("v"))).collect()]
    assert got == [f"{v:.8g}" for v in values]
    row = spark.range(1).select(
        candidate_id(F.lit("ridge"), F.lit(3), F.lit(None).cast("double"), F.lit(0.01), F.lit(1)),
        candidate_id(F.lit("dense_tsk"), F.lit(12), F.lit(2.0), F.lit(1.0), F.lit(4)),
    ).first()
    assert tuple(row) == ("ridge|p=3|r=none|a=0.01|k=1", "dense_tsk|p=12|r=2|a=1|k=4")


def test_text_helpers(spark):
    df = spark.createDataFrame([("3|5;10, 5", "..a b/ü._", {"origin": "Simulated bank"})], "l string, n string, a map<string,string>")
    row = df.select(parse_lags(F.col("l")).alias("l"), safe_name(F.col("n")).alias("n"), origin_of(F.col("a")).alias("o")).first()
    assert row["l"] == [3, 5, 10] and row["n"] == "a_b_ü" and row["o"] == "artificial"
    with pytest.raises(PySparkException, match="not a boolean"):
        df.select(parse_boolean(F.lit("maybe"))).collect()
    known = spark.createDataFrame([("x", "unverified")], "series_id string, origin string")
    empty = spark.createDataFrame([], "id string")
    assert override_origin(known, empty).first()["origin"] == "unverified"
    assert override_origin(known, spark.createDataFrame([("y",)], "id string")).first()["origin"] == "artificial"
    nested = spark.range(1).select(F.struct(F.lit(1).alias("x"), F.array(F.lit(2)).alias("y")).alias("s"))
    assert flatten_schema(nested).columns == ["s.x", "s.y"]


def test_length_strata_follow_quantile_cuts(spark):
    from tidefold.operators.select import length_strata

    for n in (11, 12, 38):
        pdf = pd.DataFrame({"dataset": "d", "series_id": [f"s{i:03d}" for i in range(n)], "length": np.arange(n) * 3 % 17})
        got = length_strata(spark.createDataFrame(pdf), 3).toPandas().sort_values("length_rank")
        want = pd.qcut(np.arange(1, n + 1), q=3, labels=False)
        assert list(got["stratum"]) == list(want)
