import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "customer", "lineitem", "events", "part", "supplier")
# One query of each kind; the rest run in tools/check_oracle.py.
SAMPLE = (
    "bucket_mean_hour", "causal_impute", "ratio_split", "horizon_split", "lag_features", "seasonal_naive_metrics",
    "relative_to_naive", "leaderboard", "hash_sample", "ridge_ar2_path", "robust_gate", "mixing_profile", "block_bootstrap", "ets_level", "panel_file",
)


def clean(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.8g}") + 0.0
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cleaned = [tuple(clean(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(cleaned, key=lambda r: [repr(v) for v in r if not isinstance(v, float)])


def close(a, b):
    """Equal values, floats up to one unit of the last kept digit."""
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6))


def test_registry_is_consistent():
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(queries) and len(queries) >= 90
    assert all(callable(q) for q in queries.values())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    result = con.execute(entry.oracle_sql()[name])
    got, want = table(df.columns, df.collect()), table([d[0] for d in result.description], result.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for mine, theirs in zip(got[1], want[1]):
        assert all(close(a, b) for a, b in zip(mine, theirs)), (mine, theirs)


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["bucket_mean_hour"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "GreaterThanOrEqual(ts" in scan and "LessThan(ts" in scan
    assert "props" not in scan and "user_id" not in scan


def test_bounded_preparation_shuffles_once_after_the_panel(spark):
    from tidefold.plans.prepare import by_ratio_panel
    from tidefold.sources import panels

    raw = panels.evt_hour(spark, SF)
    got = by_ratio_panel(raw, 24, max_len=panels.EVENT_HOURS.slots)

    def shuffles(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert shuffles(got) <= shuffles(raw) + 1


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange " in line]


def test_the_pool_moves_rows_by_series_and_makes_buckets_once(spark):
    from tidefold.checks.pools import pool
    from tidefold.sources import panels

    moved = exchanges(pool(spark, SF))
    assert moved and not [line for line in moved if ", step#" in line or ",step#" in line]
    # One partial and one final sum by slot: the buckets are not made again for the names of the grid.
    plan = panels.supplier_week(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert sum("Aggregate(keys=[" in line and "pos#" in line for line in plan.splitlines()) == 2


def test_key_guard_reads_its_rows_once(spark):
    from tidefold.operators.quality import unique_keys

    plan = unique_keys(spark.read.parquet(f"{SF}/supplier.parquet"), ["s_suppkey"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
