"""Linear models for every series at once.

Gram sums are built per block of rows (one series chunk), merged, and solved
per series. The model grid travels as one small row set per series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions import blocks
from tidefold.functions.arrays import dot
from tidefold.operators.ordered import CHUNK, chunk_of, fits

FAN = 256

GRAM_SCHEMA = (
    "series_id string, lag int, role string, part long, n long, yy double, max_abs double, "
    "rhs array<double>, gram array<double>"
)


def with_chunk(df: DataFrame, max_len: int | None, chunk: int = CHUNK, pos: str = "step") -> DataFrame:
    value = F.lit(0).cast("long") if fits(max_len, chunk) else chunk_of(F.col(pos), chunk)
    return df.withColumn("chunk", value)


def gram_rows(rows: DataFrame, order_list: Sequence[int]) -> DataFrame:
    """Block sums of (1, lags) by (series, lag, role): X'X, X'y, y'y, n."""
    orders = [int(p) for p in order_list]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        x_all = np.stack(pdf["features"].to_numpy())
        y_all = pdf["y"].to_numpy(float)
        step = pdf["step"].to_numpy()
        role_all = pdf["role"].to_numpy()
        for p in orders:
            for role in ("prior", "bound"):
                use = (step >= p) & (role_all == role)
                if not use.any():
                    continue
                x, y = blocks.affine(x_all[use, :p]), y_all[use]
                out.append(
                    (pdf["series_id"].iloc[0], p, role, int(pdf["chunk"].iloc[0]) // FAN, len(y), float(y @ y),
                     float(np.abs(y).max()), x.T @ y, blocks.pack(x.T @ x))
                )
        return pd.DataFrame(out, columns=[c.split()[0] for c in GRAM_SCHEMA.split(", ")])

    return (
        rows.filter(F.col("role").isin("prior", "bound"))
        .select(F.col("series_id").cast("string").alias("series_id"), "chunk", "step", "role", "y", "features")
        .groupBy("series_id", "chunk")
        .applyInPandas(one, GRAM_SCHEMA)
    )


def merge_grams(grams: DataFrame, keys: Sequence[str], levels: int = 2) -> DataFrame:
    """Tree sum of block rows to one row a key: a task adds at most ``FAN`` blocks of one key at each of ``levels``, then what is left of it."""
    keys = list(keys)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[:1].copy()
        head["part"] = int(pdf["part"].iloc[0]) // FAN
        head["n"] = int(pdf["n"].sum())
        head["yy"] = float(pdf["yy"].sum())
        head["max_abs"] = float(pdf["max_abs"].max())
        head["rhs"] = [np.sum(np.stack(pdf["rhs"].to_numpy()), axis=0)]
        head["gram"] = [np.sum(np.stack(pdf["gram"].to_numpy()), axis=0)]
        return head

    for _ in range(levels):
        grams = grams.groupBy(*keys, "part").applyInPandas(add, grams.schema)
    # One row for FAN ** (levels + 1) blocks and more: the last sum takes what remains, whatever its depth.
    return grams.groupBy(*keys).applyInPandas(add, grams.schema)


def fit_linear(
    grams: DataFrame,
    model: str,
    alphas: Sequence[float] = (0.0,),
    role: str = "bound",
    tolerance: float = 1e-6,
    max_iter: int = 50_000,
) -> DataFrame:
    """Models with a free intercept from merged Gram sums of one role.

    ``ols`` and ``ridge`` center first, so the intercept is not penalised;
    ``lasso`` is cyclic coordinate descent on ||y - Xb||^2 / (2n) + alpha |b|.
    ``penalised_ridge`` penalises the constant column too.
    """
    if model not in ("ols", "ridge", "lasso", "penalised_ridge"):
        raise ValueError(f"Unknown model {model}.")
    penalties = [float(a) for a in alphas]
    if model == "lasso" and min(penalties) <= 0:
        raise ValueError("Lasso needs a positive penalty.")

    def lasso(g, r, n, alpha):
        b = np.zeros(len(r))
        scale = np.diag(g).copy()
        for _ in range(max_iter):
            largest = 0.0
            for j in range(len(b)):
                if scale[j] == 0:
                    continue
                rho = r[j] - g[j] @ b + scale[j] * b[j]
                new = np.sign(rho) * max(abs(rho) - n * alpha, 0.0) / scale[j]
                largest = max(largest, abs(new - b[j]))
                b[j] = new
            if largest <= tolerance * max(1e-12, np.abs(b).max(initial=0.0)) * 1e-4:
                break
        return b

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples():
            rhs = np.asarray(row.rhs, float)
            gram = blocks.unpack(np.asarray(row.gram, float), len(rhs))
            n = row.n
            if model == "penalised_ridge":
                for alpha, (coef, diag) in zip(penalties, blocks.ridge_path(gram, rhs, penalties)):
                    rss = row.yy - 2 * coef @ rhs + coef @ gram @ coef
                    out.append((row.series_id, row.lag, alpha, n, rss, coef, diag))
                continue
            mean_x, mean_y = gram[0, 1:] / n, rhs[0] / n
            inner = gram[1:, 1:] - n * np.outer(mean_x, mean_x)
            cross = rhs[1:] - n * mean_x * mean_y
            for alpha in penalties:
                if model == "lasso":
                    b = lasso(inner, cross, n, alpha)
                else:
                    a = 0.0 if model == "ols" else alpha
                    b = np.linalg.lstsq(inner + a * np.eye(len(cross)), cross, rcond=None)[0]
                coef = np.concatenate([[mean_y - mean_x @ b], b])
                rss = row.yy - 2 * coef @ rhs + coef @ gram @ coef
                out.append((row.series_id, row.lag, alpha, n, rss, coef, np.full(len(coef), np.nan)))
        return pd.DataFrame(out, columns=["series_id", "lag", "ridge_alpha", "n", "rss", "coefficients", "inverse_diag"])

    return (
        grams.filter(F.col("role") == role)
        .groupBy("series_id", "lag")
        .applyInPandas(
            solve,
            "series_id string, lag int, ridge_alpha double, n long, rss double, "
            "coefficients array<double>, inverse_diag array<double>",
        )
        .withColumn("model", F.lit(model))
    )


def predict(features: Column, lag: Column, coefficients: Column) -> Column:
    """Dot product of (1, newest lags) with the stored coefficients."""
    x = F.concat(F.array(F.lit(1.0)), F.slice(features, 1, lag))
    return dot(x, coefficients)


def score(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Forecasts of stored models on rows: a key join, no refit."""
    keyed = rows.withColumn("series_id", F.col("series_id").cast("string"))
    return (
        keyed.join(models.select("series_id", "lag", "ridge_alpha", "coefficients"), "series_id")
        .filter(F.col("step") >= F.col("lag"))
        .withColumn("forecast", predict(F.col("features"), F.col("lag"), F.col("coefficients")))
        .drop("coefficients")
    )
