"""Shared SQL for the comparison side: the panels and their usual preparation."""

from __future__ import annotations

from tidefold.sources.panels import EVENT_DAYS, EVENT_HOURS, ORDER_WEEKS, SHIP_WEEKS, Period

RATIO = {"prior": 0.20, "bound": 0.45, "validation": 0.15, "test": 0.20}


def _panel(name: str, source: str, key: str, ts: str, value: str, how: str, p: Period) -> str:
    start = p.start.strftime("%Y-%m-%d %H:%M:%S")
    end = p.end.strftime("%Y-%m-%d %H:%M:%S")
    return f"""
{name}_b AS (
  SELECT {key} AS series_id,
         CAST(floor((epoch({ts}) - epoch(TIMESTAMP '{start}')) / {p.step}) AS BIGINT) AS pos,
         {how}({value}) AS value, count(*) AS readings
  FROM {source}
  WHERE {ts} >= TIMESTAMP '{start}' AND {ts} < TIMESTAMP '{end}'
  GROUP BY 1, 2),
{name} AS (
  SELECT s.series_id, s.pos, b.value, coalesce(b.readings, 0) AS readings
  FROM (SELECT series_id, unnest(range({p.slots})) AS pos FROM (SELECT DISTINCT series_id FROM {name}_b)) s
  LEFT JOIN {name}_b b ON b.series_id = s.series_id AND b.pos = s.pos)"""


REVENUE = "l_extendedprice * (1 - l_discount)"
EVT_HOUR = _panel("evt_hour", "events", "event_type", "ts", "value", "avg", EVENT_HOURS)
USER_DAY = _panel("user_day", "events", "user_id", "ts", "value", "sum", EVENT_DAYS)
SEG_WEEK = _panel(
    "seg_week", "orders JOIN customer ON o_custkey = c_custkey", "c_mktsegment", "o_orderdate", "o_totalprice", "avg", ORDER_WEEKS
)
SHIP_WEEK = _panel("ship_week", "lineitem", "l_returnflag", "l_shipdate", REVENUE, "sum", SHIP_WEEKS)
SUPPLIER_WEEK = _panel("supplier_week", "lineitem", "l_suppkey", "l_shipdate", REVENUE, "sum", SHIP_WEEKS)


def imputed(name: str, season: int) -> str:
    """Trim, fill: adds step, dropped, value_imputed, imputation_source, was_imputed."""
    return f"""
{name}_t AS (
  SELECT *, pos - dropped AS step FROM (
    SELECT *, min(CASE WHEN value IS NOT NULL THEN pos END) OVER (PARTITION BY series_id) AS dropped FROM {name})
  WHERE pos >= dropped),
{name}_s AS (
  SELECT *, CASE WHEN step < {season}
      THEN last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY step ROWS UNBOUNDED PRECEDING)
      ELSE value END AS seed FROM {name}_t),
{name}_i AS (
  SELECT series_id, pos, step, dropped, value, readings,
    last_value(seed IGNORE NULLS) OVER (PARTITION BY series_id, step % {season} ORDER BY step ROWS UNBOUNDED PRECEDING) AS value_imputed,
    CASE WHEN value IS NOT NULL THEN 'observed' WHEN step >= {season} THEN 'seasonal_past' ELSE 'last_observation' END AS imputation_source,
    value IS NULL AS was_imputed
  FROM {name}_s)"""


def roles(name: str, out: str, fractions: dict[str, float] = RATIO) -> str:
    """Ratio split by largest remainder; adds n_rows, role, role_step, role_size."""
    f = {k: f"{v}::DOUBLE" for k, v in fractions.items()}
    rest = "\n".join(
        f"    n_rows * {f[r]} - floor(n_rows * {f[r]}) AS r{i}, CAST(floor(n_rows * {f[r]}) AS BIGINT) AS f{i},"
        for i, r in enumerate(fractions)
    )
    ahead = []
    for i in range(4):
        terms = [f"CAST(r{j} {'>' if j > i else '>='} r{i} AS INT)" for j in range(4) if j != i]
        ahead.append(f"f{i} + CAST({' + '.join(terms)} < n_rows - f0 - f1 - f2 - f3 AS BIGINT) AS z{i}")
    return f"""
{out}_n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n_rows FROM {name}),
{out}_r AS (SELECT *,
{rest.rstrip(',')} FROM {out}_n),
{out}_z AS (SELECT *, {', '.join(ahead)} FROM {out}_r),
{out} AS (
  SELECT * EXCLUDE (r0, r1, r2, r3, f0, f1, f2, f3, z0, z1, z2, z3),
    CASE WHEN step < z0 THEN 'prior' WHEN step < z0 + z1 THEN 'bound' WHEN step < z0 + z1 + z2 THEN 'validation' ELSE 'test' END AS role,
    step - CASE WHEN step < z0 THEN 0 WHEN step < z0 + z1 THEN z0 WHEN step < z0 + z1 + z2 THEN z0 + z1 ELSE z0 + z1 + z2 END AS role_step,
    CASE WHEN step < z0 THEN z0 WHEN step < z0 + z1 THEN z1 WHEN step < z0 + z1 + z2 THEN z2 ELSE z3 END AS role_size
  FROM {out}_z)"""


def scaled(name: str, out: str) -> str:
    return f"""
{out}_m AS (SELECT *, avg(CASE WHEN role = 'prior' THEN value_imputed END) OVER (PARTITION BY series_id) AS scaler_mean,
    stddev_pop(CASE WHEN role = 'prior' THEN value_imputed END) OVER (PARTITION BY series_id) AS sd FROM {name}),
{out} AS (SELECT * EXCLUDE (sd), CASE WHEN sd > 1e-12 THEN sd ELSE 1.0 END AS scaler_scale,
    NOT coalesce(sd > 1e-12, false) AS scaler_fallback,
    (value_imputed - scaler_mean) / CASE WHEN sd > 1e-12 THEN sd ELSE 1.0 END AS value_scaled FROM {out}_m)"""


def prepared(panel: str, name: str, season: int) -> str:
    """Panel, fill, split and scale as CTEs ending in ``p``."""
    return ",".join([panel, imputed(name, season), roles(f"{name}_i", "pr"), scaled("pr", "p")])


FACTOR, MASK = 0x45D9F3B, 0xFFFFFFFF


def digest_head(text: str) -> str:
    """The first 32 bits of the MD5 of a text."""
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def mixed(source: str, value: str, name: str, out: str) -> str:
    """CTEs that add ``out``, the spread 32 bits of ``value``, to the rows of ``source``."""
    return f"""
{name}_0 AS (SELECT *, {value} AS h_0 FROM {source}),
{name}_1 AS (SELECT * EXCLUDE (h_0), (xor(h_0 >> 16, h_0) * {FACTOR}) & {MASK} AS h_1 FROM {name}_0),
{name}_2 AS (SELECT * EXCLUDE (h_1), (xor(h_1 >> 16, h_1) * {FACTOR}) & {MASK} AS h_2 FROM {name}_1),
{name} AS (SELECT * EXCLUDE (h_2), xor(h_2 >> 16, h_2) AS {out} FROM {name}_2)"""


def inverted(source: str, name: str, size: int) -> str:
    """CTEs that solve the symmetric systems of ``source``: columns ``g{i}_{j}`` and ``t{i}`` become ``b{i}`` (solution) and ``v{i}`` (diagonal of the inverse).

    Gauss-Jordan elimination, one step a CTE; positive definite systems need no pivoting.
    """
    width = 2 * size + 1

    def cell(i: int, j: int) -> str:
        if j < size:
            return f"g{min(i, j)}_{max(i, j)}"
        return f"t{i}" if j == size else f"{float(i == j - size - 1)}::DOUBLE"

    cells = [(i, j) for i in range(size) for j in range(width)]
    out = [f"{name}_0 AS (SELECT *, {', '.join(f'{cell(i, j)} AS m{i}_{j}' for i, j in cells)} FROM {source})"]
    names = ", ".join(f"m{i}_{j}" for i, j in cells)
    for k in range(size):
        step = [f"m{k}_{j} / m{k}_{k} AS m{k}_{j}" if i == k else f"m{i}_{j} - m{i}_{k} * m{k}_{j} / m{k}_{k} AS m{i}_{j}" for i, j in cells]
        out.append(f"{name}_{k + 1} AS (SELECT * EXCLUDE ({names}), {', '.join(step)} FROM {name}_{k})")
    found = ", ".join([f"m{i}_{size} AS b{i}" for i in range(size)] + [f"m{i}_{size + 1 + i} AS v{i}" for i in range(size)])
    out.append(f"{name} AS (SELECT * EXCLUDE ({names}), {found} FROM {name}_{size})")
    return ",".join(out)
