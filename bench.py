"""Time the headline queries; prints one JSON line.

Every query runs to the end over its whole tables (no-op sink). The wide study
also reports how many candidates were fitted and bounded per second, the figure
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from tidefold.checks import catalog  # noqa: E402
from tidefold.operators.sweep import Grid  # noqa: E402
from tidefold.plans import decide, prepare  # noqa: E402
from tidefold.session import build_session  # noqa: E402
from tidefold.sources import panels  # noqa: E402

HEADLINE = (
    "bucket_mean_hour", "causal_impute", "prior_zscore", "lag_features", "seasonal_naive_metrics", "best_candidate", "run_compare",
    "leaderboard", "hash_sample", "ridge_ar2_path", "certificate_grid", "robust_gate", "mixing_profile", "block_bootstrap",
    "signed_ranks", "study_simple_gate", "sweep_selected", "smoothing_summary",
)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def wide_study(spark, folder) -> tuple[float, int, int]:
    """Robust decisions for every supplier over the published grid shape (120 specs per series)."""
    p = panels.SHIP_WEEKS
    started = time.perf_counter()
    prepared = prepare.by_ratio_panel(panels.supplier_week(spark, folder), p.season, max_len=p.slots)
    case = decide.Case(prepared, Grid(), p.season, "robust", max_len=p.slots)
    drain(case.outcomes(case.decisions()))
    seconds = time.perf_counter() - started
    row = case.build_report().agg(F.count("*"), F.sum("candidate_count")).first()
    return seconds, int(row[0]), int(row[1])


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "tidefold-bench", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    checks = catalog()
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        drain(checks[name][0](spark, folder))
        times[name] = round(time.perf_counter() - started, 3)
    seconds, series, candidates = wide_study(spark, folder)
    times["wide_study"] = round(seconds, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
                "wide_study": {"series": series, "candidates": candidates, "candidates_per_second": round(candidates / seconds, 1)},
            }
        )
    )


if __name__ == "__main__":
    main()
