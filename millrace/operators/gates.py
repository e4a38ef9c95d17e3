"""Gates: tables of evidence in, one decision a row out, with the name of every reason against it.

Each gate reads columns of the names below, keeps all columns of its input and
adds its own; reasons are an array, empty where the row passes. Evidence that
is null counts as missing and never as good: the docstrings name the value it
stands for. Empty tables give empty results, repeated rows are decided one by
one. Columns that a gate adds must not be in its input (ValueError).
All but operator_promotion are expressions of one row and need no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import rows

# Limits and reason names as users of the gates know them.
REQUIRED_HASHES = ("training_plan_hash", "dataset_manifest_hash", "trace_manifest_hash", "lora_config_hash", "adapter_hash")
MOST_RANK = 32
MOST_ADAPTER_MB = 1500
LEAST_PUBLIC_DELTA = -0.005
LEAST_SAMPLES = 100
MOST_FALSE_POSITIVES = 0.01
MOST_FORMAT_FAILURES = 0.005
MOST_LENGTH_GAMING = 0.01
MOST_HELDOUT_REGRESSION = 0.01


def _free(df: DataFrame, *names: str) -> DataFrame:
    taken = {c.lower() for c in df.columns} & set(names)
    if taken:
        raise ValueError(f"the gate adds columns that the table has: {sorted(taken)}")
    return df


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _number(name: str, missing: float) -> Column:
    return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")), F.lit(float(missing)))


def _named(name: str) -> Column:
    """The entries of an array of names that are not blank."""
    return F.filter(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))


def promotion(df: DataFrame, hashes: tuple[str, ...] = REQUIRED_HASHES, most_rank: int = MOST_RANK) -> DataFrame:
    """Five reports, required hashes, rank, contamination and open investigations: allow only without a failure.

    Reads submission_passed, submission_fields_valid, transfer_passed,
    private_like_passed, regression_passed, contaminated (boolean),
    firewall_decision, the hashes (string), adapter_rank (int),
    firewall_reasons, contamination_flags, investigations (arrays of string).
    A firewall that says "investigate" both blocks and opens its reasons as
    investigations. Null reports and hashes fail; a null rank is not checked.
    Adds unresolved (the open investigations), reasons (sorted), decision.
    """
    _free(df, "unresolved", "reasons", "decision")
    said = F.coalesce(F.col("firewall_decision"), F.lit(""))
    why = _named("firewall_reasons")
    why = F.when(F.size(why) > 0, why).otherwise(F.array(F.lit("public_firewall_investigate")))
    opened = _named("investigations")
    out = df.withColumn("unresolved", F.when(said == "investigate", F.array_sort(F.array_union(opened, why))).otherwise(opened))
    rules = [
        ("submission_exact_failed", ~(_true("submission_passed") & _true("submission_fields_valid"))),
        ("transfer_failed", ~_true("transfer_passed")),
        ("private_like_failed", ~_true("private_like_passed")),
        ("public_firewall_blocked", said != "allow"),
        ("regression_failed", ~_true("regression_passed")),
        *[(f"missing_hash:{h}", F.trim(F.coalesce(F.col(h), F.lit(""))) == "") for h in hashes],
        ("adapter_rank_exceeds_32", F.col("adapter_rank") > most_rank),
        ("contamination", _true("contaminated") | (F.size(_named("contamination_flags")) > 0)),
        ("unresolved_investigation", F.size("unresolved") > 0),
    ]
    out = out.withColumn("reasons", F.array_sort(rows.failures(*rules)))
    return out.withColumn("decision", F.when(F.size("reasons") == 0, "allow").otherwise("reject"))


def stage_promotion(df: DataFrame) -> DataFrame:
    """Promotion by stage: later stages ask for more.

    Reads stage, token_mask_valid, loss_finite, adapter_size_mb,
    adapter_size_limit_mb, empty_output_count, prompt_copy_count; for the
    stages v1_to_v2, v2_to_v3 and submission also public_like_delta and
    private_like_delta, for v2_to_v3 synthetic_gain_only, for submission
    package_clean, rank and failed_lineage. Null: flags are false, the size is
    beyond any limit, the limit 1500, one empty output, no copied prompt, no
    change, rank 999. Adds reasons (sorted) and decision.
    """
    _free(df, "reasons", "decision")
    stage = F.coalesce(F.col("stage"), F.lit(""))
    compared, last = stage.isin("v1_to_v2", "v2_to_v3", "submission"), stage == "submission"
    rules = [
        ("token_mask_invalid", ~_true("token_mask_valid")),
        ("loss_not_finite", ~_true("loss_finite")),
        ("adapter_size_exceeds_limit", _number("adapter_size_mb", 1e9) > _number("adapter_size_limit_mb", MOST_ADAPTER_MB)),
        ("empty_or_nonsense_outputs", _number("empty_output_count", 1) > 0),
        ("prompt_copy_outputs", _number("prompt_copy_count", 0) > 0),
        ("public_like_collapse", compared & (_number("public_like_delta", 0) < LEAST_PUBLIC_DELTA)),
        ("no_private_like_improvement", compared & (_number("private_like_delta", 0) <= 0)),
        ("synthetic_only_gain", (stage == "v2_to_v3") & _true("synthetic_gain_only")),
        ("package_not_clean", last & ~_true("package_clean")),
        ("rank_gt_32", last & (_number("rank", 999) > MOST_RANK)),
        ("failed_lineage", last & _true("failed_lineage")),
    ]
    out = df.withColumn("reasons", F.array_sort(rows.failures(*rules)))
    return out.withColumn("decision", F.when(F.size("reasons") == 0, "PROMOTE").otherwise("REJECT"))


def candidate(df: DataFrame) -> DataFrame:
    """Whether a candidate may be submitted: evaluated, packaged, above two baselines, no family much worse.

    Reads eval_completed, calibration_recorded (boolean), package_status,
    exact_match, first_baseline, second_baseline, severe_families (array of
    string). Baselines count only once the evaluation is complete, the second
    only if it is not 0; null and NaN are 0. A missing calibration is a warning
    that holds the submission back, not a failure.
    Adds reasons, warnings, status, submit.
    """
    _free(df, "reasons", "warnings", "status", "submit")
    done, score, second = _true("eval_completed"), _number("exact_match", 0), _number("second_baseline", 0)
    rules = [
        ("eval_missing_or_incomplete", ~done),
        ("package_not_pass", F.coalesce(F.col("package_status"), F.lit("")) != "PASS"),
        ("below_first_baseline", done & (score < _number("first_baseline", 0))),
        ("below_second_baseline", done & (second != 0) & (score < second)),
        ("severe_family_regression", F.size(F.coalesce(F.col("severe_families"), F.array().cast("array<string>"))) > 0),
    ]
    out = df.withColumn("reasons", rows.failures(*rules)).withColumn("warnings", rows.failures(("calibration_missing", ~_true("calibration_recorded"))))
    passed = F.size("reasons") == 0
    return out.withColumn("status", F.when(passed, "PASS").otherwise("FAIL")).withColumn("submit", passed & (F.size("warnings") == 0))


def reward_admission(df: DataFrame, least_samples: int = LEAST_SAMPLES, most_length_gaming: float = MOST_LENGTH_GAMING, most_heldout_regression: float = MOST_HELDOUT_REGRESSION) -> DataFrame:
    """Whether rewards of a model may train another: rates of error, leakage and gaming under their limits.

    Reads sample_count, false_positive_rate, format_failure_rate,
    leakage_reward_rate, length_gaming_rate, heldout_regression_rate. Samples
    or rates that are null, NaN, negative or (rates) over 1 give the one
    reason invalid_input. The parameters can only tighten admission: admitted
    asks for the fixed limits as well. Adds reasons, accepted, admitted.
    """
    _free(df, "reasons", "accepted", "admitted")
    rates = ("false_positive_rate", "format_failure_rate", "leakage_reward_rate", "length_gaming_rate", "heldout_regression_rate")
    valid = F.coalesce(F.col("sample_count"), F.lit(-1)) >= 0
    for r in rates:
        valid = valid & _number(r, -1).between(0, 1)

    def reasons(samples, gaming, regression):
        found = rows.failures(
            ("insufficient_samples", F.col("sample_count") < samples),
            ("false_positive_rate", F.col("false_positive_rate") > MOST_FALSE_POSITIVES),
            ("format_failure_rate", F.col("format_failure_rate") > MOST_FORMAT_FAILURES),
            ("leakage_reward_rate", F.col("leakage_reward_rate") > 0),
            ("length_gaming_rate", F.col("length_gaming_rate") > gaming),
            ("heldout_regression_rate", F.col("heldout_regression_rate") > regression),
        )
        return F.when(valid, found).otherwise(F.array(F.lit("invalid_input")))

    fixed = reasons(LEAST_SAMPLES, MOST_LENGTH_GAMING, MOST_HELDOUT_REGRESSION)
    out = df.withColumn("reasons", reasons(least_samples, most_length_gaming, most_heldout_regression))
    out = out.withColumn("accepted", F.size("reasons") == 0)
    return out.withColumn("admitted", F.col("accepted") & (F.size(fixed) == 0))


@dataclass(frozen=True)
class OperatorLimits:
    """Limits of operator_promotion."""

    # The usual limits.
    support: int = 3
    symbolic_success: float = 0.80
    verifier_gain: float = 0.02
    cluster_purity: float = 0.85
    cluster_symbolic_success: float = 0.80
    cluster_verifier_score: float = 0.55
    cluster_failure: float = 0.20
    problem_support: int = 1
    safe_candidate: bool = True
    safe_cluster: bool = True


def operator_promotion(candidates: DataFrame, clusters: DataFrame, limits: OperatorLimits | None = None) -> DataFrame:
    """Mined operators against the best figures of the clusters that they dominate.

    candidates: operator_name, promotion_safe, support_count,
    symbolic_success_rate, mean_verifier_gain. clusters: dominant_operator,
    member_count, operator_purity, symbolic_success_rate, mean_verifier_score,
    failure_rate, distinct_problem_count, promotion_safe. Without a cluster
    (null names have none) all best figures are 0 and the failure rate 1; null
    figures of a candidate are 0, null flags false. Adds the metrics of the
    clusters, reasons in the order of the limits, and promoted. Clusters are
    combined to one row an operator before they meet the candidates.
    """
    lim = limits or OperatorLimits()
    best = {
        "max_cluster_support": (F.max("member_count"), 0),
        "max_cluster_operator_purity": (F.round(F.max("operator_purity"), 6), 0.0),
        "max_cluster_symbolic_success_rate": (F.round(F.max("symbolic_success_rate"), 6), 0.0),
        "max_cluster_mean_verifier_score": (F.round(F.max("mean_verifier_score"), 6), 0.0),
        "min_cluster_failure_rate": (F.round(F.min("failure_rate"), 6), 1.0),
        "max_distinct_problem_support": (F.max("distinct_problem_count"), 0),
        "any_cluster_promotion_safe": (F.max(_true("promotion_safe")), False),
    }
    _free(candidates, "cluster_count", *best, "reasons", "promoted", "__operator")
    per = clusters.groupBy(F.col("dominant_operator").alias("__operator")).agg(F.count("*").alias("cluster_count"), *[a.alias(n) for n, (a, _) in best.items()])
    out = candidates.join(per, F.col("operator_name") == F.col("__operator"), "left").drop("__operator")
    out = out.withColumns({"cluster_count": F.coalesce("cluster_count", F.lit(0)), **{n: F.coalesce(n, F.lit(missing)) for n, (_, missing) in best.items()}})
    rules = [
        ("candidate_not_miner_promotion_safe", F.lit(lim.safe_candidate) & ~_true("promotion_safe")),
        ("insufficient_support", _number("support_count", 0) < lim.support),
        ("symbolic_success_below_threshold", _number("symbolic_success_rate", 0) < lim.symbolic_success),
        ("verifier_gain_below_threshold", _number("mean_verifier_gain", 0) < lim.verifier_gain),
        ("cluster_purity_below_threshold", F.col("max_cluster_operator_purity") < lim.cluster_purity),
        ("cluster_symbolic_success_below_threshold", F.col("max_cluster_symbolic_success_rate") < lim.cluster_symbolic_success),
        ("cluster_verifier_score_below_threshold", F.col("max_cluster_mean_verifier_score") < lim.cluster_verifier_score),
        ("cluster_failure_rate_above_threshold", F.col("min_cluster_failure_rate") > lim.cluster_failure),
        ("insufficient_distinct_problem_support", F.col("max_distinct_problem_support") < lim.problem_support),
        ("no_promotion_safe_cluster", F.lit(lim.safe_cluster) & ~F.col("any_cluster_promotion_safe")),
    ]
    out = out.withColumn("reasons", rows.failures(*rules))
    return out.withColumn("promoted", F.size("reasons") == 0)
