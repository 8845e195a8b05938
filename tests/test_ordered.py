import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidefold.operators import ordered


def test_number_rows_equals_one_sort(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": rng.choice(list("xyz"), 500), "t": rng.permutation(500)})
    got = ordered.number_rows(spark.createDataFrame(pdf), ["k"], [F.col("t")], F.floor(F.col("t") / 37)).toPandas()
    got = got.sort_values(["k", "t"])
    assert (got.groupby("k").cumcount().to_numpy() == got["pos"].to_numpy()).all()


def test_chunked_look_back_equals_plain_window(spark):
    pdf = pd.DataFrame({"series_id": ["a"] * 50 + ["b"] * 23, "pos": [*range(50), *range(23)], "v": np.arange(73.0)})
    df = spark.createDataFrame(pdf)

    def columns(w):
        return {"l1": F.lag("v", 1).over(w), "l5": F.lag("v", 5).over(w), "s": F.sum("v").over(w.rowsBetween(-4, 0))}

    plain = ordered.look_back(df, 5, columns, max_len=50).toPandas().sort_values(["series_id", "pos"]).reset_index(drop=True)
    chunked = ordered.look_back(df, 5, columns, chunk=7).toPandas().sort_values(["series_id", "pos"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(plain, chunked[plain.columns])


def test_average_rank_with_heavy_ties(spark):
    rng = np.random.default_rng(1)
    values = np.where(rng.random(400) < 0.4, 3.0, rng.integers(0, 50, 400).astype(float))
    pdf = pd.DataFrame({"k": rng.choice(["p", "q"], 400, p=[0.9, 0.1]), "id": range(400), "v": values})
    got = ordered.average_rank(spark.createDataFrame(pdf), ["k"], "v").toPandas().sort_values("id")
    want = pdf.groupby("k")["v"].rank(method="average")
    assert np.allclose(got["rank"].to_numpy(), want.to_numpy())
    assert (got["rank_ties"].to_numpy() == pdf.groupby(["k", "v"])["id"].transform("size").to_numpy()).all()


def test_per_group_same_both_ways(spark):
    pdf = pd.DataFrame({"series_id": list("aabbb"), "v": [1.0, 3.0, 2.0, 4.0, 6.0]})
    df = spark.createDataFrame(pdf)
    a = ordered.per_group(df, {"m": F.avg("v")}, max_len=5).toPandas().sort_values(["series_id", "v"])["m"]
    b = ordered.per_group(df, {"m": F.avg("v")}).toPandas().sort_values(["series_id", "v"])["m"]
    assert list(a) == list(b) == [2.0, 2.0, 4.0, 4.0, 4.0]


def test_medians_with_ties_and_null_keys(spark):
    rng = np.random.default_rng(3)
    keys = [None if k == "n" else k for k in rng.choice(["p", "q", "n"], 300, p=[0.6, 0.3, 0.1])]
    a = np.where(rng.random(300) < 0.4, 2.0, rng.integers(0, 30, 300)).astype(float)
    b = rng.normal(size=300)
    rows = [(k, float(x), None if i % 9 == 0 else float(y)) for i, (k, x, y) in enumerate(zip(keys, a, b))]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    summary = df.groupBy("k").agg(F.count("*").alias("n"))
    got = ordered.with_medians(summary, df, ["k"], {"ma": F.col("a"), "mb": F.col("b")}).toPandas()
    pdf = pd.DataFrame(rows, columns=["k", "a", "b"])
    pdf["k"] = pdf["k"].fillna("none")
    want = pdf.groupby("k")[["a", "b"]].median()
    got["k"] = got["k"].fillna("none")
    got = got.set_index("k").loc[want.index]
    assert len(got) == 3 and np.allclose(got["ma"], want["a"]) and np.allclose(got["mb"], want["b"])


def test_global_rank_with_one_huge_tie(spark):
    pdf = pd.DataFrame({"dataset": ["d"] * 200 + ["e"] * 20, "series_id": [f"s{i:04d}" for i in range(220)], "length": [7] * 180 + list(range(40))})
    got = ordered.global_rank(spark.createDataFrame(pdf), ["dataset"], ["length", "series_id"], "r").toPandas()
    want = pdf.sort_values(["dataset", "length", "series_id"])
    want["w"] = want.groupby("dataset").cumcount() + 1
    both = got.merge(want, on="series_id")
    assert len(both) == 220 and (both["r"] == both["w"]).all()


def test_unbounded_plan_never_windows_over_a_whole_series(spark):
    """Without a length bound the wide windows are cut by chunk; only per-chunk summaries are not."""
    from tidefold.operators import impute, lags

    df = spark.createDataFrame([("a", i, float(i)) for i in range(20)], "series_id string, pos long, value double")
    filled = impute.seasonal_fill(df, 3, chunk=8)
    plan = lags.with_shift(filled, 2, "value_imputed", "f", chunk=8)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows
    for line in windows:
        assert "_chunk" in line, line
