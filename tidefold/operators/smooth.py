"""Exponential smoothing and seasonal autoregressions for every series.

One-step forecasts take in each observed value while parameters stay fixed.
Smoothing parameters come from a grid by in-sample squared error; moving-average
terms by regression on residuals of a longer autoregression. These recursions
need a series in order, so each series must fit the promised length bound.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.functions import metrics as m
from tidefold.operators.lags import with_shift
from tidefold.operators.ordered import CHUNK, chunk_of, fits
from tidefold.operators.select import best
from tidefold.session import spread_keys, store


@dataclass(frozen=True)
class Spec:
    """One statistical model: a smoothing form or a seasonal autoregression."""

    name: str
    family: str
    trend: bool = False
    damped: bool = False
    seasonal: bool = False
    order: tuple[int, int, int] = (0, 0, 0)
    seasonal_order: tuple[int, int, int] = (0, 0, 0)

    @property
    def constant(self) -> bool:
        """A constant is used only without any differencing."""
        return self.order[1] + self.seasonal_order[1] == 0

    @property
    def complexity(self) -> int:
        (p, _d, q), (sp, _sd, sq) = self.order, self.seasonal_order
        return p + q + sp + sq + int(self.constant)

    def minimum_length(self, season: int) -> int:
        return max(20, sum(self.order) + sum(self.seasonal_order) * season + 8)

    def candidate_id(self, season: int) -> str:
        (p, d, q), (sp, sd, sq) = self.order, self.seasonal_order
        kind = "sarima" if any(self.seasonal_order) else "arima"
        length = season if any(self.seasonal_order) else 0
        return f"{kind}__p{p}_d{d}_q{q}__P{sp}_D{sd}_Q{sq}_m{length}__trend_{'c' if self.constant else 'n'}"


# The benchmark candidates.
ETS = (
    Spec("ets_level", "ETS"),
    Spec("ets_holt", "ETS", trend=True),
    Spec("ets_damped_holt", "ETS", trend=True, damped=True),
    Spec("ets_seasonal", "ETS", seasonal=True),
    Spec("ets_holt_winters", "ETS", trend=True, seasonal=True),
)
SARIMA = (
    Spec("sarima_100_011", "SARIMA", order=(1, 0, 0), seasonal_order=(0, 1, 1)),
    Spec("sarima_011_011", "SARIMA", order=(0, 1, 1), seasonal_order=(0, 1, 1)),
    Spec("sarima_110_011", "SARIMA", order=(1, 1, 0), seasonal_order=(0, 1, 1)),
    Spec("sarima_101_011", "SARIMA", order=(1, 0, 1), seasonal_order=(0, 1, 1)),
    Spec("sarima_200_100", "SARIMA", order=(2, 0, 0), seasonal_order=(1, 0, 0)),
)
LEVELS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
TRENDS = (0.01, 0.05, 0.1, 0.3)
SEASONS = (0.01, 0.05, 0.1, 0.3)
DAMPING = (0.8, 0.9, 0.98)

SCHEMA = (
    "series_id string, family string, candidate string, status string, error string, aic double, bic double, "
    "n_train long, params string, step long, forecast double"
)


def _grid(spec: Spec) -> np.ndarray:
    """All weights of a form: one row (alpha, beta, gamma, phi) for each point."""
    return np.array(
        list(product(LEVELS, TRENDS if spec.trend else (0.0,), SEASONS if spec.seasonal else (0.0,), DAMPING if spec.damped else (1.0,)))
    )


def _start(y: np.ndarray, spec: Spec, season: int, size: int):
    """(first forecast, state before it) from the first values."""
    if spec.seasonal:
        base = y[:season].mean()
        slope = (y[season : 2 * season].mean() - base) / season if spec.trend else 0.0
        return season, (np.full(size, base), np.full(size, slope), np.tile((y[:season] - base)[:, None], (1, size)))
    return 1, (np.full(size, y[0]), np.full(size, y[1] - y[0] if spec.trend else 0.0), np.zeros((1, size)))


def _run(y: np.ndarray, place: int, state, grid: np.ndarray, unit=1.0, keep: bool = True):
    """Forecasts of ``y``, whose first value is at ``place``, and the state behind it; all grid points (and columns) at once."""
    alpha, beta, gamma, phi = grid.T
    level, slope, cycle = state
    out = np.empty((len(y), *level.shape)) if keep else None
    for t, value in enumerate(y):
        slot = (place + t) % len(cycle)
        ahead = level + phi * slope
        guess = ahead + cycle[slot]
        if keep:
            out[t] = guess
        error = value * unit - guess
        level = ahead + alpha * error
        slope = phi * slope + beta * error
        cycle[slot] = cycle[slot] + gamma * error
    return out, (level, slope, cycle)


def _fitted(grid: np.ndarray, k: int) -> tuple[dict, int]:
    return dict(zip(("alpha", "beta", "gamma", "phi"), map(float, grid[k]))), int((grid[k] != 0).sum())


def _smooth(y: np.ndarray, n: int, spec: Spec, season: int):
    """All grid points at once; returns the best point, its error, its size and its forecasts."""
    grid = _grid(spec)
    first, state = _start(y, spec, season, len(grid))
    ahead = np.full((len(y), len(grid)), np.nan)
    ahead[first:], _ = _run(y[first:], first, state, grid)
    sse = ((y[first:n, None] - ahead[first:n]) ** 2).sum(axis=0)
    k = int(np.argmin(sse))
    params, size = _fitted(grid, k)
    return params, float(sse[k]), n - first, size, ahead[:, k]


# --- smoothing of series of any length ---------------------------------------------------
# A step is an affine map of the state (level, slope, cycle), so a chunk is one too.


def _chunk_map(y: np.ndarray, place: int, spec: Spec, season: int) -> np.ndarray:
    """The chunk as a map: states x (states + 1) x grid points, from the recursion run on every unit vector and on zero."""
    grid = _grid(spec)
    slots = season if spec.seasonal else 1
    size = slots + 2
    unit = np.eye(size, size + 1)[:, :, None] * np.ones(len(grid))
    value = np.zeros((size + 1, 1))
    value[size] = 1.0
    _, (level, slope, cycle) = _run(y, place, (unit[0], unit[1], unit[2:].copy()), grid, value, keep=False)
    return np.concatenate([level[None], slope[None], cycle])


def _moved(step: np.ndarray, state: np.ndarray) -> np.ndarray:
    return (step[:, :-1] * state[None]).sum(axis=1) + step[:, -1]


def _as_state(flat: np.ndarray):
    return flat[0].copy(), flat[1].copy(), flat[2:].copy()


def forecast_long(
    rows: DataFrame, specs: Sequence[Spec], season: int, train: Sequence[str], score: str, value: str = "value_imputed", chunk: int = CHUNK
) -> DataFrame:
    """:func:`forecast` for smoothing forms and series of any length, with the same values.

    Every chunk of a series becomes an affine map of the state; the maps are applied
    one after another, which gives the state at every border; then each chunk works
    out its errors from its own border, and with the best weights its forecasts.
    A task holds one chunk, the border states pass through it one by one.
    """
    if any(s.family != "ETS" for s in specs):
        raise ValueError("Only smoothing forms run on series of any length.")
    if chunk < 2 * season:
        raise ValueError("A chunk must hold the first two seasons.")
    by_name, train = {s.name: s for s in specs}, tuple(train)
    base = rows.filter(F.col("role").isin(*train, score)).select(
        F.col("series_id").cast("string").alias("series_id"), "step", "role", F.col(value).cast("double").alias("y"), chunk_of(F.col("step"), chunk).alias("chunk")
    )
    sizes = base.groupBy("series_id").agg(F.count_if(F.col("role").isin(*train)).alias("n"))
    used = base.join(sizes, "series_id")
    keys = ["series_id", "chunk"]

    def usable(n: int):
        return [s for s in specs if n >= s.minimum_length(season)]

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        y, place, out = pdf["y"].to_numpy(float), int(pdf["step"].iloc[0]), []
        for spec in usable(int(pdf["n"].iloc[0])):
            if place:
                step = _chunk_map(y, place, spec, season)
            else:
                first, state = _start(y, spec, season, len(_grid(spec)))
                _, (level, slope, cycle) = _run(y[first:], first, state, _grid(spec), keep=False)
                last = np.concatenate([level[None], slope[None], cycle])
                step = np.concatenate([np.zeros((len(last), len(last), last.shape[1])), last[:, None]], axis=1)
            out.append((pdf["series_id"].iloc[0], spec.name, place // chunk, step.tobytes()))
        return pd.DataFrame(out, columns=["series_id", "candidate", "chunk", "step"])

    def borders(frames):
        """The state before each chunk, over maps in the order of their chunks."""
        now, state = None, None
        for pdf in frames:
            out = []
            for row in pdf.itertuples():
                if (row.series_id, row.candidate) != now:
                    now, state = (row.series_id, row.candidate), None
                spec = by_name[row.candidate]
                size = (season if spec.seasonal else 1) + 2
                step = np.frombuffer(row.step).reshape(size, size + 1, -1)
                out.append((row.series_id, row.candidate, row.chunk, b"" if state is None else state.tobytes()))
                state = _moved(step, np.zeros((size, step.shape[2])) if state is None else state)
            yield pd.DataFrame(out, columns=["series_id", "candidate", "chunk", "state"])

    def chunk_run(left: pd.DataFrame, candidate: str, state: bytes, grid: np.ndarray, point=None):
        """(place of the first forecast, forecasts) of a chunk for the whole grid or one point of it."""
        spec = by_name[candidate]
        y, place = left["y"].to_numpy(float), int(left["step"].iloc[0])
        if place:
            flat = np.frombuffer(state).reshape((season if spec.seasonal else 1) + 2, -1)
            first, begin = 0, _as_state(flat if point is None else flat[:, point : point + 1])
        else:
            first, begin = _start(y, spec, season, len(grid))
        return first, _run(y[first:], place + first, begin, grid)[0]

    def errors(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        left = left.sort_values("step")
        for row in right.itertuples():
            first, ahead = chunk_run(left, row.candidate, row.state, _grid(by_name[row.candidate]))
            inside = left["step"].to_numpy()[first:] < left["n"].to_numpy()[first:]
            gap = left["y"].to_numpy(float)[first:][inside, None] - ahead[inside]
            out.append((row.series_id, row.candidate, (gap**2).sum(axis=0).tolist()))
        return pd.DataFrame(out, columns=["series_id", "candidate", "sse"])

    def ahead_of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        left = left.sort_values("step")
        picked = np.flatnonzero(left["role"].to_numpy() == score)
        for row in right.itertuples() if len(picked) else ():
            spec, grid = by_name[row.candidate], _grid(by_name[row.candidate])
            first, ahead = chunk_run(left, row.candidate, row.state, grid[row.k : row.k + 1], row.k)
            n, (params, size) = int(left["n"].iloc[0]), _fitted(grid, row.k)
            count = n - (season if spec.seasonal else 1)
            log_error = count * np.log(max(row.total, 1e-300) / count)
            head = (row.series_id, spec.family, spec.name, "ok", "", log_error + 2 * size, log_error + size * np.log(count), n, json.dumps(params, sort_keys=True))
            out += [(*head, int(left["step"].iloc[i]), float(ahead[i - first, 0])) for i in picked]
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    steps = used.groupBy(*keys).applyInPandas(maps, "series_id string, candidate string, chunk long, step binary")
    states = store(
        spread_keys(steps, "series_id", "candidate").sortWithinPartitions("series_id", "candidate", "chunk")
        .mapInPandas(borders, "series_id string, candidate string, chunk long, state binary")
    )
    parts = used.groupBy(*keys).cogroup(states.groupBy(*keys)).applyInPandas(errors, "series_id string, candidate string, sse array<double>")
    totals = parts.select("series_id", "candidate", F.posexplode("sse").alias("k", "sse")).groupBy("series_id", "candidate", "k").agg(F.sum("sse").alias("total"))
    best_of = store(totals.groupBy("series_id", "candidate").agg(F.min(F.struct("total", "k")).alias("b")).select("series_id", "candidate", "b.*"))
    scored = base.filter(F.col("role") == score).select(*keys).distinct()
    found = used.join(scored, keys, "left_semi").groupBy(*keys).cogroup(states.join(best_of, ["series_id", "candidate"]).groupBy(*keys)).applyInPandas(ahead_of, SCHEMA)
    short = sizes.select("series_id", "n", F.explode(F.array(*[
        F.struct(F.lit(s.family).alias("family"), F.lit(s.name).alias("candidate"), F.lit(s.minimum_length(season)).alias("least")) for s in specs
    ])).alias("s")).filter(F.col("n") < F.col("s.least"))
    nothing = F.lit(None)
    failed = short.select(
        "series_id", "s.family", "s.candidate", F.lit("failed").alias("status"), F.lit("the series is too short for this model").alias("error"),
        nothing.cast("double").alias("aic"), nothing.cast("double").alias("bic"), F.col("n").alias("n_train"), nothing.cast("string").alias("params"),
        nothing.cast("long").alias("step"), nothing.cast("double").alias("forecast"),
    )
    return found.unionByName(failed)


def _lagged(values: np.ndarray, lags: Sequence[int]) -> np.ndarray:
    out = np.full((len(values), len(lags)), np.nan)
    for j, lag in enumerate(lags):
        out[lag:, j] = values[:-lag]
    return out


def _regress(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    ok = np.isfinite(x).all(axis=1) & np.isfinite(y)
    ok[n:] = False
    if ok.sum() <= x.shape[1]:
        raise ValueError("too few rows for the regression")
    return np.linalg.lstsq(x[ok], y[ok], rcond=None)[0]


def _autoregress(y: np.ndarray, n: int, spec: Spec, season: int):
    (p, d, q), (sp, sd, sq) = spec.order, spec.seasonal_order
    w = y.astype(float).copy()
    for gap, times in ((1, d), (season, sd)):
        for _ in range(times):
            shifted = np.full(len(w), np.nan)
            shifted[gap:] = w[:-gap]
            w = w - shifted
    ar = sorted({*range(1, p + 1), *(season * i for i in range(1, sp + 1))})
    ma = sorted({*range(1, q + 1), *(season * i for i in range(1, sq + 1))})
    one = np.ones((len(w), 1)) if spec.constant else np.empty((len(w), 0))
    noise = np.zeros(len(w))
    if ma:
        long = sorted({*range(1, max(p, q) + 4), *(season * i for i in range(1, max(sp, sq) + 1))})
        x = np.hstack([one, _lagged(w, long)])
        noise = w - x @ _regress(x, w, n)
    x = np.hstack([one, _lagged(w, ar), _lagged(noise, ma)])
    coef = _regress(x, w, n)
    start = d + sd * season + max(ar, default=0)
    c0 = coef[0] if spec.constant else 0.0
    a = coef[one.shape[1] : one.shape[1] + len(ar)]
    b = coef[one.shape[1] + len(ar) :]
    # One-step forecasts: errors before the start are zero, then each observed value gives the next error.
    error = np.zeros(len(w))
    out = np.full(len(w), np.nan)
    for t in range(start, len(w)):
        guess = c0 + sum(v * w[t - g] for v, g in zip(a, ar)) + sum(v * error[t - g] for v, g in zip(b, ma) if t >= g)
        error[t] = w[t] - guess
        out[t] = y[t] - error[t]
    sse = float((error[start:n] ** 2).sum())
    if not np.isfinite(sse) or not np.isfinite(out[n:]).all():
        raise ValueError("the recursion is not stable")
    return {"constant": float(c0), "ar": a.tolist(), "ma": b.tolist()}, sse, n - start, len(coef) + 1, out


def forecast(
    rows: DataFrame,
    specs: Sequence[Spec],
    season: int,
    train: Sequence[str],
    score: str,
    max_len: int | None,
    value: str = "value_imputed",
    wanted: DataFrame | None = None,
) -> DataFrame:
    """One row per (series, candidate, step of the scored role); a failed fit is one row with its error.

    With ``wanted(series_id, candidate)`` only these specs of a series are fitted.
    Without a length bound smoothing forms go chunk by chunk; autoregressions need the bound.
    """
    if not fits(max_len):
        long = forecast_long(rows, specs, season, train, score, value)
        return long if wanted is None else long.join(wanted.select("series_id", "candidate").distinct(), ["series_id", "candidate"], "left_semi")
    specs = tuple(specs)
    train = tuple(train)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > max_len:
            raise ValueError("A series is longer than the bound that was promised.")
        pdf = pdf.sort_values("step")
        y, role = pdf["y"].to_numpy(float), pdf["role"].to_numpy()
        step = pdf["step"].to_numpy()
        n = int(np.isin(role, train).sum())
        picked = np.flatnonzero(role == score)
        out = []
        chosen = set(pdf["_wanted"].iloc[0]) if restricted else None
        for spec in specs:
            if chosen is not None and spec.name not in chosen:
                continue
            head = [pdf["series_id"].iloc[0], spec.family, spec.name]
            try:
                if n < spec.minimum_length(season):
                    raise ValueError("the series is too short for this model")
                fit = _smooth if spec.family == "ETS" else _autoregress
                params, sse, used, size, ahead = fit(y, n, spec, season)
                log_error = used * np.log(max(sse, 1e-300) / used)
                aic, bic = log_error + 2 * size, log_error + size * np.log(used)
                text = json.dumps(params, sort_keys=True)
                out += [(*head, "ok", "", aic, bic, n, text, int(step[i]), float(ahead[i])) for i in picked]
            except (ValueError, np.linalg.LinAlgError) as error:
                out.append((*head, "failed", str(error), None, None, n, None, None, None))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        return frame.astype({"step": "Int64"})

    restricted = wanted is not None
    used = rows.filter(F.col("role").isin(*train, score)).select(
        F.col("series_id").cast("string").alias("series_id"), "step", "role", F.col(value).alias("y")
    )
    if restricted:
        names = wanted.groupBy("series_id").agg(F.collect_set("candidate").alias("_wanted"))  # one a family at most
        used = used.join(names, "series_id")
    return spread_keys(used, "series_id").groupBy("series_id").applyInPandas(one, SCHEMA)


def candidate_scores(forecasts: DataFrame, actuals: DataFrame) -> DataFrame:
    """Candidate table of one role: status, information criteria and errors."""
    y, f = F.col("actual"), F.col("forecast")
    joined = forecasts.join(actuals.select("series_id", "step", "actual"), ["series_id", "step"], "left")
    return joined.groupBy("series_id", "family", "candidate").agg(
        F.first("status").alias("status"), F.first("error").alias("error"), F.first("aic").alias("aic"), F.first("bic").alias("bic"),
        F.first("n_train").alias("n_train"), F.first("params").alias("spec_json"), F.count(f).alias("points"),
        m.rmse(y, f).alias("validation_rmse"), m.mae(y, f).alias("validation_mae"), m.weighted_cost(y, f).alias("validation_weighted_cost"),
    )


def benchmark(
    prepared: DataFrame,
    season: int,
    max_len: int,
    specs: Sequence[Spec] = (*ETS, *SARIMA),
    primary: str = "cost_then_rmse",
    deployed: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(candidates, summary): choose on validation, refit on all rows before test, score the test role.

    The summary compares with the seasonal forecast and, where given, with the
    ``deployed`` forecasts (``series_id, step, deployed_forecast``).
    """
    rows = prepared.withColumn("series_id", F.col("series_id").cast("string"))
    actuals = rows.select("series_id", "step", F.col("value_imputed").alias("actual"))
    first = forecast(rows, specs, season, ("prior", "bound"), "validation", max_len)
    cands = store(candidate_scores(first, actuals))
    chosen = best(cands.filter(F.col("status") == "ok"), ["series_id", "family"], primary).select(
        "series_id", "family", "candidate", "validation_rmse", "validation_mae", "validation_weighted_cost"
    )
    final = forecast(rows, specs, season, ("prior", "bound", "validation"), "test", max_len, wanted=chosen)
    kept = final.join(chosen, ["series_id", "family", "candidate"]).filter(F.col("status") == "ok")
    base = with_shift(rows, season, "value_imputed", "fallback", max_len=max_len).filter(F.col("role") == "test").select(
        "series_id", "step", F.col("value_imputed").alias("actual"), "fallback"
    )
    joined = kept.join(base, ["series_id", "step"])
    if deployed is not None:
        joined = joined.join(deployed.select("series_id", "step", "deployed_forecast"), ["series_id", "step"])
    y, f, b = F.col("actual"), F.col("forecast"), F.col("fallback")
    stats = [
        F.count("*").alias("test_count"), m.rmse(y, f).alias("test_rmse"), m.mae(y, f).alias("test_mae"),
        m.weighted_cost(y, f).alias("test_weighted_cost"), m.rmse(y, b).alias("fallback_rmse"),
        m.weighted_cost(y, b).alias("fallback_weighted_cost"),
    ]
    against = ["fallback"]
    if deployed is not None:
        d = F.col("deployed_forecast")
        stats += [m.rmse(y, d).alias("deployed_rmse"), m.weighted_cost(y, d).alias("deployed_weighted_cost")]
        against.append("deployed")
    summary = joined.groupBy(
        "series_id", "family", "candidate", "validation_rmse", "validation_mae", "validation_weighted_cost"
    ).agg(*stats)
    for name in against:
        summary = summary.withColumns(
            {
                f"test_rmse_improvement_vs_{name}": m.gain(F.col(f"{name}_rmse"), F.col("test_rmse"), "absolute"),
                f"test_cost_improvement_vs_{name}": m.gain(F.col(f"{name}_weighted_cost"), F.col("test_weighted_cost"), "absolute"),
            }
        )
    return cands, summary
