"""Comparing runs, grids and models: joins, summaries, unions and key sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.functions.arrays import finite
from tidefold.functions.metrics import exact_mean
from tidefold.functions.text import digest, plain_number
from tidefold.operators.ordered import with_medians
from tidefold.operators.quality import require_columns, unique_keys

SERIES = ["source", "dataset", "series_id"]
CANDIDATE = [*SERIES, "lag_order", "radius", "ridge_alpha"]
# Tolerances for equal grid values and equal errors.
GRID_TOLERANCE, TIE_TOLERANCE = 1e-12, 1e-10


def same_value(left: Column, right: Column | float, tolerance: float = GRID_TOLERANCE) -> Column:
    return F.abs(left - right) <= tolerance


def relative_to_baseline(results: DataFrame, baseline: DataFrame, model: str = "naive") -> DataFrame:
    """Error ratio to the naive model; running it twice gives the same table."""
    naive = baseline.filter((F.col("status") == "PASS") & (F.col("model") == model)).select(
        *SERIES, F.col("rmse").alias("naive_rmse")
    )
    return (
        results.drop("naive_rmse", "relative_rmse_to_naive")
        .join(unique_keys(naive, SERIES, "naive baseline"), SERIES, "left")
        .withColumn("relative_rmse_to_naive", F.col("rmse") / F.col("naive_rmse"))
    )


def compare_runs(new: DataFrame, old: DataFrame) -> DataFrame:
    """Passed rows of a new run next to the old run, with changes and flags."""
    renamed = {
        "selected_lag": "old_selected_lag", "selected_radius": "old_selected_radius",
        "selected_ridge_alpha": "old_selected_ridge_alpha", "selected_validation_rmse": "old_validation_rmse",
        "selected_validation_mae": "old_validation_mae", "rule_count": "old_rule_count",
        "total_parameter_count": "old_total_parameter_count", "rmse": "old_test_rmse", "mae": "old_test_mae",
        "mase": "old_test_mase",
    }
    require_columns(new, [*SERIES, *renamed, "status"], "new results")
    before = unique_keys(
        old.filter(F.col("status") == "PASS").select(*SERIES, *[F.col(a).alias(b) for a, b in renamed.items() if a in old.columns]),
        SERIES, "old results",
    )
    if "selected_validation_mae" not in old.columns:
        before = before.withColumn("old_validation_mae", F.lit(None).cast("double"))
    changes = {
        "lag_change": F.col("selected_lag") - F.col("old_selected_lag"),
        "radius_change": F.col("selected_radius") - F.col("old_selected_radius"),
        "alpha_change": F.col("selected_ridge_alpha") - F.col("old_selected_ridge_alpha"),
        "validation_rmse_change": F.col("selected_validation_rmse") - F.col("old_validation_rmse"),
        "validation_mae_change": F.col("selected_validation_mae") - F.col("old_validation_mae"),
        "rule_change": F.col("rule_count") - F.col("old_rule_count"),
        "parameter_change": F.col("total_parameter_count") - F.col("old_total_parameter_count"),
        "test_rmse_ratio_to_old": F.col("rmse") / F.col("old_test_rmse"),
        "test_mase_ratio_to_old": F.col("mase") / F.col("old_test_mase"),
    }
    moved = F.lit(False)
    for name in ("lag", "radius", "ridge_alpha"):
        moved = moved | ~F.col(f"selected_{name}").eqNullSafe(F.col(f"old_selected_{name}"))

    def flat(name: str) -> Column:
        return F.coalesce(F.abs(F.col(name)) <= GRID_TOLERANCE, F.lit(False))

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name) == 0, F.lit(False))

    plateau = (
        flat("validation_rmse_change")
        & (F.col("validation_mae_change").isNull() | flat("validation_mae_change"))
        & zero("rule_change") & zero("parameter_change")
    )
    return (
        unique_keys(new.filter(F.col("status") == "PASS"), SERIES, "new results")
        .join(before, SERIES, "left")
        .withColumns(changes)
        .withColumns({"selection_changed": moved, "exact_validation_plateau": plateau})
        .withColumn(
            "radius_reduced_on_plateau",
            F.col("selection_changed") & F.coalesce(F.col("radius_change") < 0, F.lit(False)) & F.col("exact_validation_plateau"),
        )
    )


def selection_changes(comparison: DataFrame) -> DataFrame:
    keys = ["source", "dataset"]
    out = comparison.groupBy(*keys).agg(
        F.countDistinct("series_id").alias("series"),
        F.count_if("selection_changed").alias("changed_selections"),
        F.count_if(F.col("radius_change") < 0).alias("reduced_radius"),
        F.count_if(F.col("radius_change") > 0).alias("increased_radius"),
        F.count_if("radius_reduced_on_plateau").alias("plateau_radius_reductions"),
        F.avg("old_selected_radius").alias("mean_old_radius"),
        F.avg("selected_radius").alias("mean_new_radius"),
        F.avg("old_rule_count").alias("mean_old_rules"),
        F.avg("rule_count").alias("mean_new_rules"),
        F.avg("test_rmse_ratio_to_old").alias("mean_test_rmse_ratio"),
    )
    return with_medians(out, comparison, keys, {"median_test_rmse_ratio": F.col("test_rmse_ratio_to_old")})


def analysis_rows(results: DataFrame, dataset: str, mode: str, max_rules: int) -> DataFrame:
    """Rows of one dataset, mode and rule cap; a repeated series fails the job."""
    chosen = results.filter(
        (F.col("dataset") == dataset) & (F.col("selection_mode") == mode) & (F.col("max_rules") == max_rules)
    )
    return unique_keys(chosen, SERIES, "analysis rows")


def compare_grids(selected: DataFrame, previous: DataFrame) -> DataFrame:
    """Selected rows on a wider grid next to the ones on the previous grid."""
    fields = ("selected_radius", "rmse", "mase", "rule_count", "total_parameter_count")
    before = previous.filter(F.col("status") == "PASS").select(
        *SERIES, *[F.col(c).alias(f"previous_{c}") for c in fields]
    )
    return (
        selected.filter(F.col("status") == "PASS")
        .join(unique_keys(before, SERIES, "previous grid"), SERIES, "left")
        .withColumns(
            {
                "rmse_ratio_to_previous": F.col("rmse") / F.col("previous_rmse"),
                "mase_ratio_to_previous": F.col("mase") / F.col("previous_mase"),
                "radius_change": F.col("selected_radius") - F.col("previous_selected_radius"),
                "rule_change": F.col("rule_count") - F.col("previous_rule_count"),
                "parameter_change": F.col("total_parameter_count") - F.col("previous_total_parameter_count"),
            }
        )
    )


def value_distribution(selected: DataFrame, maximum: float, value: str = "selected_radius") -> DataFrame:
    """Series per selected value, their share, and whether the value is the grid end."""
    passed = selected.filter(F.col("status") == "PASS")
    per_value = passed.groupBy(value).agg(F.countDistinct(*SERIES).alias("series"))
    # The per-value table has one row per grid value, so this window stays small.
    whole = Window.partitionBy(F.lit(1))
    return per_value.withColumns(
        {
            "rate": F.col("series") / F.sum("series").over(whole),
            "at_upper_boundary": same_value(F.col(value), float(maximum)),
        }
    )


def boundary_summary(selected: DataFrame, comparison: DataFrame, maximum: float) -> DataFrame:
    """One row: failures, boundary hits, caps, means and ratios to the previous grid."""
    ok = F.col("status") == "PASS"
    capped = F.coalesce("radius_cap_reached", F.lit(False))
    passed = F.count_if(ok)

    def share(n: Column, d: Column) -> Column:
        return F.when(d > 0, n / d)

    edge = F.count_if(ok & same_value(F.col("selected_radius"), float(maximum)))
    caps = F.count_if(ok & capped)
    stats = [F.count("*").alias("series"), passed.alias("pass_count"), (F.count("*") - passed).alias("failure_count"),
             share(F.count("*") - passed, F.count("*")).alias("failure_rate"), edge.alias("upper_boundary_count"),
             share(edge, passed).alias("upper_boundary_rate"), caps.alias("selected_cap_count"),
             share(caps, passed).alias("selected_cap_rate")]
    for name in ("selected_radius", "rmse", "mase", "rule_count"):
        stats.append(exact_mean(F.when(ok, F.col(name))).alias(f"mean_{name}"))
    stats.append(F.avg(F.when(ok, F.col("total_parameter_count"))).alias("mean_total_parameters"))
    ratio = F.when(finite(F.col("rmse_ratio_to_previous")), F.col("rmse_ratio_to_previous"))
    ratios = comparison.agg(
        F.count(ratio).alias("matched_previous_series"), exact_mean(ratio, 12).alias("mean_rmse_ratio_to_previous"),
    )
    ratios = with_medians(ratios, comparison, [], {"median_rmse_ratio_to_previous": ratio})
    # Both sides are one-row aggregates.
    middles = {f"median_{c}": F.when(ok, F.col(c)) for c in ("selected_radius", "rmse", "mase", "rule_count")}
    one = with_medians(selected.agg(*stats), selected, [], middles).withColumn("_one", F.lit(1))
    return (
        one.join(ratios.withColumn("_one", F.lit(1)), "_one")
        .drop("_one")
        .withColumn("maximum_radius", F.lit(float(maximum)))
    )


def grid_decision(
    summary: DataFrame,
    boundary_rate: str = "upper_boundary_rate",
    max_boundary: float = 0.05,
    max_failure: float = 0.0,
    max_capped: float = 0.0,
    max_penalty: float | None = 0.0,
    step: float = 1.0,
) -> DataFrame:
    """Accept the grid or name the next maximum. ``step`` is 1.0 in one study and 0.5 in another."""
    def within(name: str, limit: float) -> Column:
        return F.coalesce(finite(F.col(name)) & (F.col(name) <= limit), F.lit(False))

    out = summary.withColumns(
        {
            "boundary_ok": within(boundary_rate, max_boundary),
            "failures_ok": within("failure_rate", max_failure),
            "caps_ok": within("selected_cap_rate", max_capped),
            "mean_rmse_penalty_vs_previous": F.col("mean_rmse_ratio_to_previous") - 1.0,
        }
    )
    performance = F.lit(True) if max_penalty is None else within("mean_rmse_penalty_vs_previous", max_penalty)
    out = out.withColumn("performance_ok", performance)
    enough = F.col("boundary_ok") & F.col("failures_ok") & F.col("caps_ok") & F.col("performance_ok")
    return out.withColumn("grid_sufficient", enough).withColumns(
        {
            "decision": F.when(F.col("grid_sufficient"), "ACCEPT_RADIUS_GRID").otherwise("EXTEND_RADIUS_GRID"),
            "suggested_next_maximum_radius": F.when(F.col("grid_sufficient"), F.col("maximum_radius")).otherwise(
                F.col("maximum_radius") + step
            ),
        }
    )


def lower_neighbour(selected: DataFrame, pool: DataFrame, maximum: float, tolerance: float = TIE_TOLERANCE) -> DataFrame:
    """Selections at the grid end next to the nearest lower radius of the same lag and penalty.

    The join is an equi-join on (series, lag, penalty); the nearest lower row is
    a max over a struct, so no sorted group is held.
    """
    edge = selected.filter(same_value(F.col("selected_radius"), float(maximum)))
    lower = pool.filter(
        (F.col("status") == "PASS") & ~F.col("radius_cap_reached") & (F.col("radius") < float(maximum))
    )
    # The largest radius, then the smallest errors and sizes.
    order = F.struct(
        F.col("radius"), (-F.col("rmse")).alias("a"), (-F.col("mae")).alias("b"),
        (-F.col("total_parameter_count")).alias("c"), (-F.col("rule_count")).alias("d"),
    )
    nearest = lower.groupBy(*SERIES, "lag_order", "ridge_alpha").agg(
        F.max_by(F.struct("radius", "rmse", "mae", "rule_count", "total_parameter_count"), order).alias("p")
    )
    on = [edge[c] == nearest[c] for c in SERIES] + [
        edge["selected_lag"] == nearest["lag_order"], edge["selected_ridge_alpha"] == nearest["ridge_alpha"],
    ]
    joined = edge.join(nearest, on, "left").select(edge["*"], "p")
    better_rmse = F.col("p.rmse") - F.col("selected_validation_rmse")
    better_mae = F.col("p.mae") - F.col("selected_validation_mae")
    out = joined.withColumns({"rmse_improvement": better_rmse, "mae_improvement": better_mae})
    tie = F.abs("rmse_improvement") <= tolerance
    mae_tie = F.abs("mae_improvement") <= tolerance
    params, rules = F.col("p.total_parameter_count"), F.col("p.rule_count")
    simpler = (F.col("total_parameter_count") < params) | (F.col("rule_count") < rules)
    equal = (F.col("total_parameter_count") == params) & (F.col("rule_count") == rules)
    label = (
        F.when(F.col("p").isNull(), "unresolved_missing_lower_comparator")
        .when(F.col("rmse_improvement") > tolerance, "true_rmse_improvement")
        .when(tie & (F.col("mae_improvement") > tolerance), "mae_improvement_on_rmse_tie")
        .when(tie & mae_tie & simpler, "complexity_reduction_on_performance_tie")
        .when(tie & mae_tie & equal, "exact_plateau")
        .otherwise("other_boundary_selection")
    )
    return (
        out.withColumn("classification", label)
        .withColumn(
            "effective_upper_boundary",
            ~F.col("classification").isin("complexity_reduction_on_performance_tie", "exact_plateau"),
        )
        .withColumns({f"previous_{c}": F.col(f"p.{c}") for c in ("radius", "rmse", "mae", "rule_count", "total_parameter_count")})
        .drop("p")
    )


def setting_summary(results: DataFrame) -> DataFrame:
    """Pass, failure and cap rates with means and medians of passing rows per setting."""
    ok = F.col("status") == "PASS"
    passed, rows = F.count_if(ok), F.count("*")
    caps = F.count_if(ok & F.coalesce("radius_cap_reached", F.lit(False)))
    stats = [
        rows.alias("series"), passed.alias("pass_count"), (rows - passed).alias("failure_count"),
        ((rows - passed) / rows).alias("failure_rate"), caps.alias("selected_cap_count"),
        F.when(passed > 0, caps / passed).alias("selected_cap_rate"),
    ]
    fields = {"rmse": "rmse", "mase": "mase", "rule_count": "rule_count", "total_parameters": "total_parameter_count"}
    stats += [F.avg(F.when(ok, F.col(c))).alias(f"mean_{n}") for n, c in fields.items()]
    keys = ["source", "dataset", "max_rules", "selection_mode"]
    middles = {f"median_{n}": F.when(ok, F.col(c)) for n, c in fields.items()}
    return with_medians(results.groupBy(*keys).agg(*stats), results, keys, middles)


def recommendation(
    summary: DataFrame, max_cap: float = 0.10, max_failure: float = 0.0, max_penalty: float = 0.02
) -> DataFrame:
    """Per rule cap: worst dataset of each criterion, acceptable or not, smallest acceptable one."""
    keys = ["source", "dataset", "max_rules"]

    def mode(name: str, suffix: str) -> DataFrame:
        fields = ("failure_rate", "selected_cap_rate", "mean_rmse", "mean_rule_count", "mean_total_parameters")
        return summary.filter(F.col("selection_mode") == name).select(*keys, *[F.col(c).alias(f"{c}_{suffix}") for c in fields])

    merged = mode("unconstrained", "natural").join(mode("uncapped_only", "uncapped"), keys, "full")
    penalty = F.col("mean_rmse_uncapped") / F.col("mean_rmse_natural") - 1.0
    per_cap = merged.groupBy("max_rules").agg(
        F.countDistinct("dataset").alias("datasets"),
        F.max("selected_cap_rate_natural").alias("max_dataset_natural_selected_cap_rate"),
        F.max("failure_rate_uncapped").alias("max_dataset_uncapped_failure_rate"),
        F.max(penalty).alias("max_dataset_uncapped_rmse_penalty"),
        F.avg("mean_rule_count_uncapped").alias("mean_uncapped_rule_count"),
        F.avg("mean_total_parameters_uncapped").alias("mean_uncapped_total_parameters"),
    )
    acceptable = F.coalesce(
        (F.col("max_dataset_natural_selected_cap_rate") <= max_cap)
        & (F.col("max_dataset_uncapped_failure_rate") <= max_failure)
        & (F.col("max_dataset_uncapped_rmse_penalty") <= max_penalty),
        F.lit(False),
    )
    # One row per rule cap of the grid.
    whole = Window.partitionBy(F.lit(1))
    return per_cap.withColumn("acceptable", acceptable).withColumn(
        "recommended",
        F.coalesce(F.col("max_rules") == F.min(F.when(F.col("acceptable"), F.col("max_rules"))).over(whole), F.lit(False)),
    )


def eligibility_audit(pool: DataFrame) -> DataFrame:
    ok = F.col("status") == "PASS"
    capped = F.col("radius_cap_reached")
    return pool.groupBy(*SERIES).agg(
        F.count("*").alias("validation_candidates"),
        F.count_if(ok).alias("pass_candidates"),
        F.count_if(ok & capped).alias("capped_pass_candidates"),
        F.count_if(ok & ~capped).alias("uncapped_pass_candidates"),
        F.max("radius").alias("maximum_candidate_radius"),
        F.countDistinct("validation_source").alias("validation_source_count"),
        (F.count_if(ok & ~capped) > 0).alias("has_uncapped_candidate"),
    )


def leaderboard(predictive: DataFrame) -> DataFrame:
    """Mean and median error and average rank by dataset and model.

    Ranks are taken inside a series, over its models, so the window is as long
    as the model list.
    """
    inside = Window.partitionBy(*SERIES).orderBy("rmse")
    ties = Window.partitionBy(*SERIES, "rmse")
    ranked = predictive.withColumn("_rank", F.rank().over(inside) + (F.count("*").over(ties) - 1) / 2.0)
    keys = ["source", "dataset", "model"]
    out = ranked.groupBy(*keys).agg(
        F.countDistinct("series_id").alias("series"), F.avg("rmse").alias("mean_rmse"), F.avg("mase").alias("mean_mase"), F.avg("_rank").alias("average_rank"),
    )
    return with_medians(out, predictive, keys, {"median_rmse": F.col("rmse")})


def complete_series(results: DataFrame, caps: Sequence[int], modes: Sequence[str]) -> DataFrame:
    """Series having every (rule cap, mode) pair; statuses do not matter."""
    wanted = F.col("max_rules").isin(*caps) & F.col("selection_mode").isin(*modes)
    seen = F.countDistinct(F.when(wanted, F.struct("max_rules", "selection_mode")))
    return results.groupBy(*SERIES).agg(seen.alias("_seen")).filter(F.col("_seen") == len(caps) * len(modes)).drop("_seen")


def unused_series(full: DataFrame, *used: DataFrame) -> DataFrame:
    """Series of a manifest that no earlier list holds."""
    key = ["dataset", "series_id"]
    out = full.dropDuplicates(key)
    for earlier in used:
        out = out.join(earlier.select(*key).distinct(), key, "left_anti")
    return out


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    key = ["dataset", "series_id"]
    return left.select(*key).distinct().join(right.select(*key).distinct(), key, "left_semi")


def key_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sizes of the union, the intersection and the two differences of two key sets."""
    key = ["dataset", "series_id"]
    marked = left.select(*key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    each = marked.groupBy(*key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return each.groupBy("dataset").agg(
        F.count("*").alias("in_either"), F.count_if((F.col("l") + F.col("r")) == 2).alias("in_both"),
        F.count_if(F.col("r") == 0).alias("left_only"), F.count_if(F.col("l") == 0).alias("right_only"),
    )


def consolidated_pool(base: DataFrame, extensions: dict[tuple[str, str], tuple[DataFrame, int | None]]) -> DataFrame:
    """Candidate pool with some (source, dataset) parts replaced by extended runs.

    Each extension may state how many rows it must bring. Duplicate candidates
    fail the job.
    """
    out = base.withColumn("validation_source", F.lit("baseline_grid"))
    for source, dataset in extensions:
        out = out.filter(~((F.col("source") == source) & (F.col("dataset") == dataset)))
    for (source, dataset), (rows, expected) in extensions.items():
        part = rows.filter((F.col("source") == source) & (F.col("dataset") == dataset)).withColumn(
            "validation_source", F.lit(f"{dataset}_extension")
        )
        if expected is not None:
            part = require_rows(part, expected, f"{dataset} extension")
        out = out.unionByName(part, allowMissingColumns=True)
    return unique_keys(out, CANDIDATE, "candidate pool")


def require_rows(df: DataFrame, expected: int, name: str) -> DataFrame:
    """Fail the job when the row count differs; the count is a one-row side."""
    count = df.agg(F.count("*").alias("_n")).withColumn("_one", F.lit(1))
    guarded = count.withColumn(
        "_n",
        F.when(F.col("_n") == expected, F.col("_n")).otherwise(
            F.raise_error(F.format_string(f"{name}: expected {expected} rows, found %d", F.col("_n"))).cast("long")
        ),
    )
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(guarded), "_one").filter("_n >= 0").drop("_one", "_n")


def union_grids(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of two candidate tables over disjoint grids; a shared candidate fails the job."""
    return unique_keys(left.unionByName(right, allowMissingColumns=True), CANDIDATE, "grid union")


def replace_dataset(results: DataFrame, fresh: DataFrame, dataset: str) -> DataFrame:
    """Swap the rows of one dataset; the new rows must cover exactly the same series."""
    old_keys = results.filter(F.col("dataset") == dataset).select(*SERIES)
    new_keys = fresh.select(*SERIES)
    missing = old_keys.exceptAll(new_keys).unionByName(new_keys.exceptAll(old_keys))
    guard = missing.groupBy(*SERIES).agg(F.raise_error(F.lit(f"the series of {dataset} do not match")).alias("_bad"))
    checked = fresh.join(guard.filter("_bad is not null").select(*SERIES), SERIES, "left_anti")
    return results.filter(F.col("dataset") != dataset).unionByName(checked, allowMissingColumns=True)


def paired(
    left: DataFrame, right: DataFrame, keys: Sequence[str], metrics: Sequence[str], expected_pairs: int | None = None
) -> DataFrame:
    """Inner pairs as long rows ``keys, metric, difference`` (left minus right).

    With ``expected_pairs`` the job fails when another number of keys meets, so
    a key that one side lacks is not passed over in silence.
    """
    keys = list(keys)
    a = unique_keys(left.select(*keys, *[F.col(m).alias(f"_l_{m}") for m in metrics]), keys, "left side")
    b = unique_keys(right.select(*keys, *[F.col(m).alias(f"_r_{m}") for m in metrics]), keys, "right side")
    both = a.join(b, keys)
    if expected_pairs is not None:
        both = require_rows(both, expected_pairs, "pairs")
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), (F.col(f"_l_{m}") - F.col(f"_r_{m}")).alias("difference")) for m in metrics]
    )
    return both.select(*keys, F.inline(pairs))


def misaligned(forecasts: DataFrame, actuals: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Rows present on one side only or with a different actual value; must be empty."""
    keys = ["series_id", "step"]
    a = forecasts.select(*keys, F.col("actual").alias("_a"))
    b = actuals.select(*keys, F.col("actual").alias("_b"))
    return a.join(b, keys, "full").filter(
        F.col("_a").isNull() | F.col("_b").isNull() | (F.abs(F.col("_a") - F.col("_b")) > tolerance * (1 + F.abs("_b")))
    )


def side_by_side(results: DataFrame, left: str, right: str, fields: Sequence[str], key: str = "series_id") -> DataFrame:
    """Two families per series as columns, with their differences (left minus right)."""
    stats = []
    for field in fields:
        for label, family in (("left", left), ("right", right)):
            stats.append(F.max(F.when(F.col("family") == family, F.col(field))).alias(f"{label}_{field}"))
    out = results.filter(F.col("family").isin(left, right)).groupBy(key).agg(*stats)
    return out.withColumns({f"{f}_difference": F.col(f"left_{f}") - F.col(f"right_{f}") for f in fields})


# Columns of a frozen selection.
LOCK = (
    "source", "dataset", "series_id", "model", "selection_mode", "tie_break_policy", "selected_lag",
    "selected_radius", "selected_ridge_alpha", "rule_count", "radius_cap_reached", "total_parameter_count",
)


def final_issues(results: DataFrame, expected: int) -> DataFrame:
    """Reasons a final table cannot be frozen, with counts; empty when it can."""
    bad = F.lit(False)
    for metric in ("mae", "rmse", "mase", "smape"):
        bad = bad | ~finite(F.col(metric))
    per_series = results.groupBy(*SERIES).agg(
        F.count("*").alias("rows"), F.count_if(F.col("status") != "PASS").alias("failed"),
        F.count_if("radius_cap_reached").alias("capped"), F.count_if(bad).alias("nonfinite"),
        F.count_if(F.col("selection_mode") != "uncapped_only").alias("mode"),
        F.count_if(F.col("tie_break_policy") != "smallest_radius").alias("policy"),
        F.count_if(F.col("model") != "sparse_tsk").alias("model"),
    )
    total = per_series.agg(
        (F.abs(F.coalesce(F.sum("rows"), F.lit(0)) - expected)).alias("row_count"),
        F.count_if(F.col("rows") > 1).alias("duplicate_series"), F.sum("failed").alias("failures"),
        F.sum("capped").alias("capped_selections"), F.sum("nonfinite").alias("nonfinite_metrics"),
        F.sum("mode").alias("wrong_mode"), F.sum("policy").alias("wrong_tie_break"), F.sum("model").alias("wrong_model"),
    )
    names = total.columns
    return total.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("issue"), F.col(n).alias("count")) for n in names]))
    ).filter(F.col("count") > 0)


def selection_lock(validated: DataFrame) -> DataFrame:
    """Lock columns, a stable id of each row and the constant columns; no test metric passes."""
    row_id = digest(
        F.col("source"), F.col("dataset"), F.col("series_id"), F.col("selected_lag"),
        plain_number(F.col("selected_radius"), 12), plain_number(F.col("selected_ridge_alpha"), 12),
        F.col("rule_count"), F.col("total_parameter_count"),
    )
    return validated.select(
        *LOCK, row_id.alias("frozen_model_id"), F.lit(True).alias("frozen"),
        F.lit("exploratory_development_only").alias("certificate_status"),
    )


def family_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("family").agg(
        F.count("series_id").alias("series"), F.avg("certificate").alias("mean_certificate"),
        F.avg("validation_rmse").alias("mean_validation_rmse"), F.avg("test_rmse_clipped").alias("mean_test_rmse"),
        F.avg("test_weighted_cost").alias("mean_test_weighted_cost"), F.avg("total_kl").alias("mean_total_kl"),
        F.avg("rule_count").alias("mean_rule_count"), F.avg("consequent_dimension").alias("mean_dimension"),
        F.avg("certification_target_clipping_rate").alias("mean_certification_clipping"),
    )


def strategy_summary(selected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, median and count of bounds at one, NULL keys kept."""
    out = selected.groupBy(*keys).agg(
        F.count("series_id").alias("series_count"), F.avg("validation_rmse").alias("mean_validation_rmse"),
        F.stddev_samp("validation_rmse").alias("sd_validation_rmse"), F.avg("test_rmse").alias("mean_test_rmse"),
        F.stddev_samp("test_rmse").alias("sd_test_rmse"), F.avg("rule_count").alias("mean_rule_count"),
        F.avg("consequent_dimension").alias("mean_dimension"), F.avg("certificate").alias("mean_certificate"),
        F.stddev_samp("certificate").alias("sd_certificate"), F.count_if(F.col("certificate") >= 1).alias("vacuous"),
    )
    return with_medians(out, selected, keys, {"median_certificate": F.col("certificate")})


def radius_chain(candidates: DataFrame, keys: Sequence[str] = ("family", "lag", "radius")) -> DataFrame:
    """Radius to rule count to dimension to KL to bound; a missing radius is its own group."""
    return candidates.filter(F.col("family") != "ridge").groupBy(*keys).agg(
        F.count("candidate_id").alias("candidates"), F.avg("rule_count").alias("mean_rule_count"),
        F.avg("consequent_dimension").alias("mean_dimension"), F.avg("validation_rmse").alias("mean_validation_rmse"),
        F.avg("gaussian_kl").alias("mean_gaussian_kl"), F.avg("total_kl").alias("mean_total_kl"),
        F.avg("certificate").alias("mean_certificate"),
    )
