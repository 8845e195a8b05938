"""Candidate sweep: every lag, family, radius or rule count and penalty for every series.

Families that share rules share work. A radius and a fixed rule count that stop
the traversal at the same number of picks have the same design, so Gram sums,
solves and scores are done once per distinct design and joined to the specs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions import blocks
from tidefold.functions.batches import TOO_LONG, Lists, lists, starts, whole_groups
from tidefold.operators.cover import EPSILON, cover, cut_for_radius
from tidefold.operators.linear import FAN, merge_grams, with_chunk
from tidefold.operators.ordered import CHUNK, fits, look_back
from tidefold.session import cut_lineage, spread_keys, store


@dataclass(frozen=True)
class Grid:
    """Candidate grid and the certificate grid that goes with it."""

    families: tuple[str, ...] = ("ridge", "fixed_k_dense_tsk", "dense_tsk")
    lags: tuple[int, ...] = (3, 6, 12)
    radii: tuple[float, ...] = (0.75, 1.0, 1.25, 1.5, 2.0, 2.5)
    ridge_alphas: tuple[float, ...] = (0.0001, 0.001, 0.01, 0.1, 1.0)
    max_rules: int = 8
    fixed_k: tuple[int, ...] = field(default=())
    sparse_active: int = 3
    temperatures: tuple[float, ...] = (0.125, 0.25, 0.5, 1.0, 2.0, 4.0)
    prior_scales: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0, 8.0)
    posterior_ratios: tuple[float, ...] = (0.01, 0.03, 0.1, 0.3, 1.0)
    clip_multiplier: float = 1.25
    validation_blocks: int = 4

    @property
    def counts(self) -> tuple[int, ...]:
        return self.fixed_k or (self.max_rules,)

    @property
    def multipliers(self) -> list[float]:
        return [(s * r) ** 2 for s in self.prior_scales for r in self.posterior_ratios]

    @property
    def uses_rules(self) -> bool:
        return any(f != "ridge" for f in self.families)


def block_id(step: Column, size: Column, count: int) -> Column:
    """Consecutive near-equal blocks: the first ``size mod count`` ones are one longer."""
    short = F.floor(size / F.lit(count))
    longer = size - short * count
    edge = longer * (short + 1)
    return F.when(step < edge, F.floor(step / (short + 1))).otherwise(
        longer + F.floor((step - edge) / F.greatest(short, F.lit(1)))
    ).cast("int")


def sweep_rows(lagged: DataFrame, grid: Grid, max_len: int | None, chunk: int = CHUNK) -> DataFrame:
    """The columns the sweep reads, from rows with ``features`` of the largest lag."""
    rows = lagged.select(
        F.col("series_id").cast("string").alias("series_id"), "step", "role", "role_step",
        F.col("value_scaled").alias("y"), "features",
        block_id(F.col("role_step"), F.col("role_size"), grid.validation_blocks).alias("block"),
    )
    return with_chunk(rows, max_len, chunk)


def lag_context(prepared: DataFrame, largest: int, max_len: int | None, chunk: int = CHUNK) -> DataFrame:
    """All rows with up to ``largest`` lags; missing ones at the start stay NULL.

    The largest lag would drop first targets that a smaller lag can use, so
    rows are kept and each lag filters by ``step``.
    """
    return look_back(
        prepared,
        largest,
        lambda w: {
            "features": F.array(
                *[F.coalesce(F.lag("value_scaled", k).over(w), F.lit(0.0)) for k in range(1, largest + 1)]
            )
        },
        pos="step",
        max_len=max_len,
        chunk=chunk,
    )


def specs(rows: DataFrame, covers: DataFrame | None, grid: Grid) -> DataFrame:
    """One row per series, lag, family and radius or count: its design, or why it has none."""
    # Rows that a lag can use in each role; no family is built on a role without any.
    usable = {
        (p, role): F.count_if((F.col("step") >= p) & (F.col("role") == role)) for p in grid.lags for role in ("prior", "bound", "validation")
    }
    per_lag = F.array(*[
        F.struct(F.lit(p).alias("lag"), *[usable[p, role].alias(f"_{role}") for role in ("prior", "bound", "validation")]) for p in grid.lags
    ])
    base = rows.groupBy("series_id").agg(per_lag.alias("_lags")).select("series_id", F.inline("_lags"))
    missing = F.coalesce(*[F.when(F.col(f"_{role}") == 0, f"no {role} rows") for role in ("prior", "bound", "validation")])
    none_d = F.lit(None).cast("double")

    def spec(family, radius, wanted, k, active, rule_count, capped, failure) -> Column:
        return F.struct(
            F.lit(family).alias("family"), radius.alias("radius"), wanted.cast("int").alias("wanted_k"),
            k.cast("int").alias("k"), active.cast("int").alias("active"), rule_count.cast("int").alias("rule_count"),
            capped.alias("capped"), failure.alias("failure"),
        )

    zero = F.lit(0)
    entries = []
    if "ridge" in grid.families:
        entries.append(spec("ridge", none_d, F.lit(1), zero, zero, F.lit(1), F.lit(False), missing))
    if grid.uses_rules:
        if covers is None:
            raise ValueError("Rule families need covers.")
        # At most max_rules entries per (series, lag).
        by_k = F.array_sort(F.collect_list(F.struct("k", "rule_count", "empty")))
        heads = covers.groupBy("series_id", "lag").agg(
            F.first("n_prior").alias("n_prior"), F.first("reach").alias("reach"), by_k.alias("cuts")
        )
        base = base.join(heads, ["series_id", "lag"], "left")
        no_prior = F.coalesce(missing, F.when(F.col("n_prior").isNull(), "no prior rows"))
        if "fixed_k_dense_tsk" in grid.families:
            for count in grid.counts:
                have = F.col("n_prior") >= count
                distinct = F.lit(True) if count == 1 else F.get("reach", F.lit(count - 2)) > EPSILON
                why = F.coalesce(
                    no_prior,
                    F.when(~have, "fewer prior rows than rules"),
                    F.when(~distinct, "too few distinct prior points"),
                    F.when(F.get("cuts", F.lit(count - 1))["empty"] > 0, "refinement left an empty rule"),
                )
                k = F.lit(count)
                entries.append(spec("fixed_k_dense_tsk", none_d, k, k, k, k, F.lit(False), why))
        for family in ("dense_tsk", "sparse_tsk"):
            if family not in grid.families:
                continue
            for radius in grid.radii:
                k = cut_for_radius(F.col("reach"), F.lit(float(radius)))
                rules = F.get("cuts", k - 1)["rule_count"]
                active = rules if family == "dense_tsk" else F.least(F.lit(grid.sparse_active), rules)
                capped = F.coalesce(F.get("reach", k - 1) > float(radius), F.lit(False))
                entries.append(spec(family, F.lit(float(radius)), k, k, active, rules, capped, no_prior))
    return base.select("series_id", "lag", F.inline(F.array(*entries)))


GEOMETRY = ["feature_mean", "feature_scale", "centers", "spreads"]


def designs(spec_rows: DataFrame, covers: DataFrame | None) -> DataFrame:
    """Distinct designs behind the usable specs, with their rule geometry."""
    usable = spec_rows.filter(~F.col("capped") & F.col("failure").isNull())
    keys = usable.select("series_id", "lag", "k", "active").distinct()
    if covers is None:
        return keys.select("*", *[F.lit(None).cast("array<double>").alias(c) for c in GEOMETRY])
    return keys.join(covers.select("series_id", "lag", "k", *GEOMETRY), ["series_id", "lag", "k"], "left")


def _fresh(df: DataFrame) -> DataFrame:
    """New column identities, so two frames of one origin can be cogrouped."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


# --- per-block helpers ------------------------------------------------------------------


class _Block:
    """Rows of one (series, chunk) as arrays, with the design of each model."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values("step")
        self.step = pdf["step"].to_numpy()
        self.role = pdf["role"].to_numpy()
        self.y = pdf["y"].to_numpy(float)
        self.x = np.stack(pdf["features"].to_numpy())
        self.block = pdf["block"].to_numpy()
        self._shared: dict = {}

    def take(self, p: int, *roles: str) -> np.ndarray:
        return (self.step >= p) & np.isin(self.role, roles)

    def design(self, row) -> tuple[np.ndarray, np.ndarray | None]:
        x = self.x[:, : row.lag]
        if row.k == 0:
            return blocks.affine(x), None
        # The rules of a lag have one standardisation, those of a cut one set of distances.
        if row.lag not in self._shared:
            self._shared = {row.lag: (x - np.asarray(row.feature_mean)) / np.asarray(row.feature_scale)}
        z, shape = self._shared[row.lag], (-1, row.lag)
        if (row.lag, row.k) not in self._shared:
            self._shared[row.lag, row.k] = blocks.log_firing(z, np.reshape(row.centers, shape), np.reshape(row.spreads, shape))
        weights = blocks.normalised(self._shared[row.lag, row.k], row.active)
        return blocks.rule_design(z, weights), weights


def _gram(block: _Block, design: np.ndarray, p: int, role: str):
    use = block.take(p, role)
    x, y = design[use], block.y[use]
    return len(y), float(y @ y), float(np.abs(y).max(initial=0.0)), x.T @ y, x.T @ x


def _solve(prior, bound, alphas) -> dict[str, np.ndarray]:
    """Per penalty: posterior mean, base deviation, squared distances to both prior means; any number of models of one shape."""
    n, yy, _, rhs, gram = prior
    p_mean, diag = blocks.ridge_paths(gram, rhs, alphas)
    q_mean, _d = blocks.ridge_paths(bound[4], bound[3], alphas)
    fit = (rhs[..., None, :] @ p_mean)[..., 0, :]
    rss = (np.asarray(yy)[..., None] - 2 * fit + (p_mean * (gram @ p_mean)).sum(axis=-2)) / n
    base = np.sqrt(np.clip(np.maximum(1e-4, rss)[..., None, :] * np.maximum(diag, 0.0), 1e-6, 100.0))
    return {
        "coefficients": q_mean, "base_std": base, "location_local": (((q_mean - p_mean) / base) ** 2).sum(axis=-2),
        "location_zero": ((q_mean / base) ** 2).sum(axis=-2),
    }


def _score(y, design, weights, val, cert, where, coef, base, bound_value, grid: Grid) -> dict[str, np.ndarray]:
    """Sums over the rows of each model for every penalty, in scaled units, as ``SUM_FIELDS`` names them.

    ``y`` is models x rows; ``val``, ``cert`` and ``where`` (the validation blocks) hold for all of them.
    """
    models, penalties = coef.shape[0], coef.shape[2]
    edge = bound_value[:, None, None]
    yv = y[:, val, None]
    raw = design[:, val] @ coef
    cut = np.clip(raw, -edge, edge)
    err, cut_err = yv - raw, yv - cut
    cost = 2.0 * np.maximum(cut_err, 0.0) + np.maximum(-cut_err, 0.0)
    member = blocks.members(where[val], grid.validation_blocks).T
    yc, xc = y[:, cert, None], design[:, cert]
    below = 4.0 * edge * edge
    bias = (np.clip(yc, -edge, edge) - xc @ coef) ** 2
    spread = (xc * xc) @ base**2
    risk = np.stack([np.minimum(1.0, (bias + m * spread) / below).sum(axis=1) for m in grid.multipliers], axis=-1)

    def each(per_model: np.ndarray) -> np.ndarray:
        return np.broadcast_to(per_model[:, None], (models, penalties, *per_model.shape[1:]))

    if weights is None:
        hard = weight = np.zeros((models, 0))
        active_sum, active_max = np.zeros(models), np.zeros(models, int)
    else:
        w = weights[:, cert]
        on = (w > 1e-8).sum(axis=2)
        hard, weight = blocks.members(w.argmax(axis=2), w.shape[2]).sum(axis=1), w.sum(axis=1)
        active_sum, active_max = on.sum(axis=1).astype(float), on.max(axis=1, initial=0)
    return {
        "n_val": np.full((models, penalties), int(val.sum())), "sse": (err**2).sum(axis=1), "sae": np.abs(err).sum(axis=1),
        "cut_sse": (cut_err**2).sum(axis=1), "cut_sae": np.abs(cut_err).sum(axis=1), "cut_cost": cost.sum(axis=1),
        "forecast_clips": (np.abs(raw) > edge).sum(axis=1), "block_sse": (member @ cut_err**2).swapaxes(1, 2),
        "block_cost": (member @ cost).swapaxes(1, 2), "n_cert": np.full((models, penalties), int(cert.sum())),
        "target_clips": each((np.abs(yc) > edge).sum(axis=(1, 2))), "risk": risk, "hard": each(hard), "weight": each(weight),
        "active_sum": each(active_sum), "active_max": each(active_max),
    }


KEYS = ["series_id", "lag", "k", "active"]
MODEL_FIELDS = (
    "ridge_alpha double, dimension int, clip_bound double, coefficients array<double>, base_std array<double>, "
    "location_local double, location_zero double"
)
SUM_FIELDS = (
    "n_val long, sse double, sae double, cut_sse double, cut_sae double, cut_cost double, forecast_clips long, "
    "block_sse array<double>, block_cost array<double>, n_cert long, target_clips long, risk array<double>, "
    "hard array<double>, weight array<double>, active_sum double, active_max int"
)
KEY_FIELDS = "series_id string, lag int, k int, active int"
SCORED = f"{KEY_FIELDS}, {MODEL_FIELDS}, {SUM_FIELDS}"
GRAMS = f"{KEY_FIELDS}, role string, part long, n long, yy double, max_abs double, rhs array<double>, gram array<double>"


ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
ROLES = ("prior", "bound", "validation")


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def _record(values: dict, fields: str) -> pa.RecordBatch:
    """Columns as an Arrow batch of the schema ``fields``; a matrix is a column of lists."""
    columns = []
    for field_ in fields.split(", "):
        name, kind = field_.split()
        value = values[name]
        if kind.startswith("array"):
            columns.append(lists(np.ascontiguousarray(value, float)))
        else:
            columns.append(value if isinstance(value, pa.Array) else pa.array(np.ascontiguousarray(value), ARROW[kind]))
    return pa.RecordBatch.from_arrays(columns, names=_names(fields))


def _clip_bound(max_abs: float, grid: Grid) -> float:
    return max(1.0, grid.clip_multiplier * max_abs)


def fit_and_score(
    rows: DataFrame, design_rows: DataFrame, grid: Grid, max_len: int | None = None, chunk: int = CHUNK
) -> DataFrame:
    """Models of every design and penalty with their validation and certificate sums.

    A series proven to fit in one chunk is fitted and scored in one visit. A
    longer one is visited twice (Gram sums, then scores), chunk by chunk, and
    the small per-chunk rows are merged.
    """
    used = rows.filter(F.col("role") != "test")
    if fits(max_len, chunk):
        return _one_visit(used, design_rows, grid, chunk)
    return _two_visits(used, design_rows, grid)


def _one_visit(rows: DataFrame, design_rows: DataFrame, grid: Grid, limit: int) -> DataFrame:
    """One visit to each (series, lag): few series still use all tasks, and designs of one shape are worked on together.

    A group's rows follow its designs in one sorted stream, and series whose steps, roles and blocks are the same go through
    every product as one array.
    """
    alphas = list(grid.ridge_alphas)
    most = limit + 2 + len(grid.counts) + 2 * len(grid.radii)

    def fitted(ids: pa.Array, p: int, k: list[int], active: int, x, y, role, where, geometry) -> pa.RecordBatch:
        """Models of one shape; ``x`` is models x rows x lags."""
        weights = None
        if geometry is None:
            design = blocks.affine(x)
        else:
            mean, scale, centers, spreads = geometry
            z = (x - mean[:, None]) / scale[:, None]
            weights = blocks.normalised(blocks.log_firing(z, centers, spreads), active)
            design = blocks.rule_design(z, weights)

        def gram(use: np.ndarray):
            xs, ys = design[:, use], y[:, use]
            xt = xs.swapaxes(1, 2)
            return ys.shape[1], (ys * ys).sum(axis=1), np.abs(ys).max(axis=1, initial=0.0), (xt @ ys[..., None])[..., 0], xt @ xs

        prior = gram(role == ROLES.index("prior"))
        solved = _solve(prior, gram(role == ROLES.index("bound")), alphas)
        bound_value = np.maximum(1.0, grid.clip_multiplier * prior[2])
        val = role == ROLES.index("validation")
        sums = _score(
            y, design, weights, val, val | (role == ROLES.index("bound")), where, solved["coefficients"], solved["base_std"], bound_value, grid
        )
        solved |= {name: solved[name].swapaxes(1, 2) for name in ("coefficients", "base_std")}
        models, penalties = len(y), len(alphas)
        heads = {
            "series_id": ids.take(pa.array(np.repeat(np.arange(models), penalties))), "lag": np.full(models * penalties, p),
            "k": np.repeat(k, penalties), "active": np.full(models * penalties, active), "ridge_alpha": np.tile(alphas, models),
            "dimension": np.full(models * penalties, design.shape[2]), "clip_bound": np.repeat(bound_value, penalties),
        }
        return _record(heads | {n: v.reshape(models * penalties, *v.shape[2:]) for n, v in (solved | sums).items()}, SCORED)

    def visit(batches):
        for table in whole_groups(batches, ("series_id", "lag"), ("data", "step"), most):
            first = starts(table, ("series_id", "lag"))
            ends = np.append(first[1:], table.num_rows)
            ids = table.column("series_id").combine_chunks()
            lag, data, step, role, where, k, active = (
                table.column(c).fill_null(0).to_numpy() for c in ("lag", "data", "step", "role", "block", "k", "active")
            )
            y = table.column("y").to_numpy()
            features, *shape = (Lists(table.column(c)) for c in ("features", *GEOMETRY))
            alike: dict = {}
            for a, b in zip(first.tolist(), ends.tolist()):
                split = a + int(np.searchsorted(data[a:b], 1))
                if b - split > limit:
                    raise ValueError(TOO_LONG)
                if a < split < b:
                    same = (int(lag[a]), step[split:b].tobytes(), role[split:b].tobytes(), where[split:b].tobytes())
                    alike.setdefault(same, []).append((a, split, b))
            for (p, *_), found in alike.items():
                _a, split, b = found[0]
                x = np.stack([features.rows(s, e).reshape(-1, p) for _a, s, e in found])
                targets = np.stack([y[s:e] for _a, s, e in found])
                kinds: dict = {}
                for i, (start, s, _e) in enumerate(found):
                    for d in range(start, s):
                        rules = len(shape[2].rows(d, d + 1)) // p if k[d] else 0
                        kinds.setdefault((rules, int(active[d])), []).append((i, d))
                for (rules, top), members in kinds.items():
                    own = [i for i, _d in members]
                    geometry = None
                    if rules:
                        geometry = [np.stack([g.rows(d, d + 1) for _i, d in members]) for g in shape]
                        geometry[2:] = [g.reshape(-1, rules, p) for g in geometry[2:]]
                    yield fitted(
                        ids.take(pa.array([d for _i, d in members])), p, [int(k[d]) for _i, d in members], top, x[own], targets[own],
                        role[split:b], where[split:b], geometry,
                    )

    lag = F.explode(F.array(*[F.lit(p) for p in grid.lags])).alias("lag")
    code = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")).cast("int") - 1
    per_lag = rows.select(lag, "*").filter(F.col("step") >= F.col("lag")).select(
        "series_id", "lag", F.lit(1).alias("data"), F.col("step").cast("long").alias("step"), code.alias("role"),
        F.col("y").cast("double").alias("y"), "block", F.slice("features", F.lit(1), F.col("lag")).alias("features"),
    )
    keyed = design_rows.withColumns({"data": F.lit(0), "step": F.lit(0).cast("long")})
    both = per_lag.unionByName(keyed, allowMissingColumns=True)
    return spread_keys(both, "series_id", "lag").sortWithinPartitions("series_id", "lag").mapInArrow(visit, SCORED)


def _two_visits(rows: DataFrame, design_rows: DataFrame, grid: Grid) -> DataFrame:
    alphas = list(grid.ridge_alphas)
    places = rows.select("series_id", "chunk").distinct()
    spread = design_rows.join(places, "series_id")

    def gram(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            block = _Block(left)
            part = int(left["chunk"].iloc[0]) // FAN
            for row in right.itertuples():
                design, _weights = block.design(row)
                for role in ("prior", "bound"):
                    n, yy, top, rhs, xx = _gram(block, design, row.lag, role)
                    if n:
                        out.append((row.series_id, row.lag, row.k, row.active, role, part, n, yy, top, rhs, blocks.pack(xx)))
        return pd.DataFrame(out, columns=_names(GRAMS))

    fitted_rows = rows.filter(F.col("role").isin("prior", "bound"))
    grams = (
        fitted_rows.groupBy("series_id", "chunk").cogroup(_fresh(spread).groupBy("series_id", "chunk")).applyInPandas(gram, GRAMS)
    )
    merged = merge_grams(grams, [*KEYS, "role"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        got = {}
        for row in pdf.itertuples():
            width = len(row.rhs)
            got[row.role] = (row.n, row.yy, row.max_abs, np.asarray(row.rhs), blocks.unpack(np.asarray(row.gram), width))
        out = []
        if len(got) == 2:
            head = pdf.iloc[0]
            limit_y = _clip_bound(got["prior"][2], grid)
            solved = _solve(got["prior"], got["bound"], alphas)
            for i, a in enumerate(alphas):
                out.append((head.series_id, int(head.lag), int(head.k), int(head.active), a, len(solved["coefficients"]), limit_y,
                            solved["coefficients"][:, i], solved["base_std"][:, i], float(solved["location_local"][i]),
                            float(solved["location_zero"][i])))
        return pd.DataFrame(out, columns=_names(f"{KEY_FIELDS}, {MODEL_FIELDS}"))

    models = cut_lineage(merged.groupBy(*KEYS).applyInPandas(solve, f"{KEY_FIELDS}, {MODEL_FIELDS}"))
    per_design = models.groupBy(*KEYS).agg(
        F.first("clip_bound").alias("clip_bound"),
        F.array_sort(F.collect_list(F.struct("ridge_alpha", "coefficients", "base_std"))).alias("path"),
    )
    loaded = spread.join(per_design, KEYS)
    sums_schema = f"{KEY_FIELDS}, ridge_alpha double, {SUM_FIELDS}"

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            block = _Block(left)
            for row in right.itertuples():
                design, weights = block.design(row)
                coef, base = (np.stack([m[c] for m in row.path], axis=1)[None] for c in ("coefficients", "base_std"))
                sums = _score(
                    block.y[None], design[None], None if weights is None else weights[None], block.take(row.lag, "validation"),
                    block.take(row.lag, "bound", "validation"), block.block, coef, base, np.array([row.clip_bound]), grid,
                )
                for i, m in enumerate(row.path):
                    out.append((row.series_id, row.lag, row.k, row.active, m["ridge_alpha"], *(v[0, i] for v in sums.values())))
        return pd.DataFrame(out, columns=_names(sums_schema))

    scored_rows = rows.filter(F.col("role").isin("bound", "validation"))
    parts = (
        scored_rows.groupBy("series_id", "chunk").cogroup(_fresh(loaded).groupBy("series_id", "chunk")).applyInPandas(score, sums_schema)
    )
    plain = ["n_val", "sse", "sae", "cut_sse", "cut_sae", "cut_cost", "forecast_clips", "n_cert", "target_clips", "active_sum"]
    widths = {
        "block_sse": grid.validation_blocks, "block_cost": grid.validation_blocks, "risk": len(grid.multipliers),
        "hard": grid.max_rules, "weight": grid.max_rules,
    }
    sums = [F.sum(c).alias(c) for c in plain] + [F.max("active_max").alias("active_max"), F.max(F.size("hard")).alias("_rules")]
    for name, width in widths.items():
        sums += [F.sum(F.get(name, F.lit(i))).alias(f"_{name}_{i}") for i in range(width)]
    total = parts.groupBy(*KEYS, "ridge_alpha").agg(*sums)
    arrays = {name: F.array(*[F.col(f"_{name}_{i}") for i in range(width)]) for name, width in widths.items()}
    for name in ("hard", "weight"):
        arrays[name] = F.slice(arrays[name], F.lit(1), F.col("_rules"))
    total = total.withColumns(arrays)
    return models.join(total, [*KEYS, "ridge_alpha"]).select(*_names(SCORED))


def run_sweep(
    lagged: DataFrame, grid: Grid, max_len: int | None = None, chunk: int = CHUNK
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(specs, scored designs, covers) for rows from :func:`lag_context`."""
    rows = sweep_rows(lagged, grid, max_len, chunk)
    # Covers and specs feed the fits, the candidates and the test forecasts, so they are stored once.
    covers = store(cover(rows, grid.lags, grid.max_rules, max_len, chunk)) if grid.uses_rules else None
    spec_rows = store(specs(rows, covers, grid))
    return spec_rows, fit_and_score(rows, designs(spec_rows, covers), grid, max_len, chunk), covers
