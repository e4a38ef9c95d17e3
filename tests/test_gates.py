"""Each gate: one clean row passes, then one changed field a case gives its reason alone."""

from __future__ import annotations

import pytest

from millrace.operators import gates

NAN = float("nan")

PROMOTION = "submission_passed boolean, submission_fields_valid boolean, transfer_passed boolean, private_like_passed boolean, regression_passed boolean, contaminated boolean, firewall_decision string, firewall_reasons array<string>, contamination_flags array<string>, investigations array<string>, adapter_rank int, " + ", ".join(f"{h} string" for h in gates.REQUIRED_HASHES)
GOOD_PROMOTION = {**dict.fromkeys(("submission_passed", "submission_fields_valid", "transfer_passed", "private_like_passed", "regression_passed"), True), "firewall_decision": "allow", "adapter_rank": 32, **dict.fromkeys(gates.REQUIRED_HASHES, "ab")}

STAGE = "stage string, token_mask_valid boolean, loss_finite boolean, adapter_size_mb double, adapter_size_limit_mb double, empty_output_count long, prompt_copy_count long, public_like_delta double, private_like_delta double, synthetic_gain_only boolean, package_clean boolean, rank int, failed_lineage boolean"
GOOD_STAGE = {"stage": "submission", "token_mask_valid": True, "loss_finite": True, "adapter_size_mb": 1500.0, "empty_output_count": 0, "public_like_delta": -0.005, "private_like_delta": 0.1, "package_clean": True, "rank": 32}

CANDIDATE = "eval_completed boolean, calibration_recorded boolean, package_status string, exact_match double, first_baseline double, second_baseline double, severe_families array<string>"
GOOD_CANDIDATE = {"eval_completed": True, "calibration_recorded": True, "package_status": "PASS", "exact_match": 0.5, "first_baseline": 0.5, "second_baseline": 0.5}

REWARD = "sample_count long, false_positive_rate double, format_failure_rate double, leakage_reward_rate double, length_gaming_rate double, heldout_regression_rate double"
GOOD_REWARD = {"sample_count": 100, "false_positive_rate": 0.01, "format_failure_rate": 0.005, "leakage_reward_rate": 0.0, "length_gaming_rate": 0.01, "heldout_regression_rate": 0.01}


def decided(spark, gate, schema, good, changes):
    """The decision of the clean row under each change, all in one table."""
    names = [c.split()[0] for c in schema.split(", ")]
    data = [(i, *[{**good, **change}.get(n) for n in names]) for i, change in enumerate(changes)]
    return [r.asDict() for r in gate(spark.createDataFrame(data, f"id int, {schema}")).orderBy("id").collect()]


def test_promotion(spark):
    cases = [
        ({}, []),
        ({"adapter_rank": None, "contaminated": False, "contamination_flags": [" "], "investigations": ["", None], "firewall_reasons": ["delta"]}, []),
        ({"submission_passed": False}, ["submission_exact_failed"]),
        ({"submission_fields_valid": None}, ["submission_exact_failed"]),
        ({"transfer_passed": False}, ["transfer_failed"]),
        ({"private_like_passed": None}, ["private_like_failed"]),
        ({"regression_passed": False}, ["regression_failed"]),
        ({"firewall_decision": None}, ["public_firewall_blocked"]),
        ({"firewall_decision": "investigate"}, ["public_firewall_blocked", "unresolved_investigation"]),
        ({"adapter_rank": 33}, ["adapter_rank_exceeds_32"]),
        ({"contaminated": True}, ["contamination"]),
        ({"contamination_flags": ["eval"]}, ["contamination"]),
        ({"investigations": ["lineage"]}, ["unresolved_investigation"]),
        *[({h: blank}, [f"missing_hash:{h}"]) for h in gates.REQUIRED_HASHES for blank in (None, " ")],
        ({"transfer_passed": False, "adapter_rank": 64, "contaminated": True}, ["adapter_rank_exceeds_32", "contamination", "transfer_failed"]),
    ]
    got = decided(spark, gates.promotion, PROMOTION, GOOD_PROMOTION, [c for c, _ in cases])
    assert [(r["reasons"], r["decision"]) for r in got] == [(w, "reject" if w else "allow") for _, w in cases]
    assert [r["unresolved"] for r in got if "unresolved_investigation" in r["reasons"]] == [["public_firewall_investigate"], ["lineage"]]
    both = decided(spark, gates.promotion, PROMOTION, GOOD_PROMOTION, [{"firewall_decision": "investigate", "firewall_reasons": ["b", "a"], "investigations": ["c", "a"]}])
    assert both[0]["unresolved"] == ["a", "b", "c"]


def test_stage_promotion(spark):
    later = ["no_private_like_improvement"]
    cases = [
        ({}, []),
        ({"token_mask_valid": None}, ["token_mask_invalid"]),
        ({"loss_finite": False}, ["loss_not_finite"]),
        ({"adapter_size_mb": 1500.5}, ["adapter_size_exceeds_limit"]),
        ({"adapter_size_mb": None}, ["adapter_size_exceeds_limit"]),
        ({"adapter_size_mb": 1600.0, "adapter_size_limit_mb": 1600.0}, []),
        ({"empty_output_count": None}, ["empty_or_nonsense_outputs"]),
        ({"prompt_copy_count": 1}, ["prompt_copy_outputs"]),
        ({"public_like_delta": -0.0051}, ["public_like_collapse"]),
        ({"private_like_delta": 0.0}, later),
        ({"private_like_delta": NAN}, later),
        ({"package_clean": None}, ["package_not_clean"]),
        ({"rank": None}, ["rank_gt_32"]),
        ({"failed_lineage": True}, ["failed_lineage"]),
        ({"synthetic_gain_only": True}, []),
        ({"stage": "v2_to_v3", "synthetic_gain_only": True, "package_clean": False, "rank": 64, "failed_lineage": True}, ["synthetic_only_gain"]),
        ({"stage": "v1_to_v2", "synthetic_gain_only": True, "private_like_delta": -1.0}, later),
        ({"stage": None, "private_like_delta": -1.0, "public_like_delta": -1.0, "package_clean": False}, []),
    ]
    got = decided(spark, gates.stage_promotion, STAGE, GOOD_STAGE, [c for c, _ in cases])
    assert [(r["reasons"], r["decision"]) for r in got] == [(w, "REJECT" if w else "PROMOTE") for _, w in cases]


def test_candidate(spark):
    cases = [
        ({}, [], True),
        ({"calibration_recorded": None}, [], False),
        ({"second_baseline": 0.0}, [], True),
        ({"first_baseline": None, "second_baseline": NAN}, [], True),
        ({"first_baseline": 0.6}, ["below_first_baseline"], False),
        ({"second_baseline": 0.6}, ["below_second_baseline"], False),
        ({"exact_match": None, "second_baseline": 0.0}, ["below_first_baseline"], False),
        ({"eval_completed": None, "exact_match": 0.0}, ["eval_missing_or_incomplete"], False),
        ({"package_status": None}, ["package_not_pass"], False),
        ({"severe_families": []}, [], True),
        ({"severe_families": ["units"]}, ["severe_family_regression"], False),
    ]
    got = decided(spark, gates.candidate, CANDIDATE, GOOD_CANDIDATE, [c for c, _, _ in cases])
    assert [(r["reasons"], r["status"], r["submit"]) for r in got] == [(w, "FAIL" if w else "PASS", s) for _, w, s in cases]
    assert [r["warnings"] for r in got[:2]] == [[], ["calibration_missing"]]


def test_reward_admission(spark):
    cases = [
        ({}, []),
        ({"sample_count": 99}, ["insufficient_samples"]),
        ({"false_positive_rate": 0.011}, ["false_positive_rate"]),
        ({"format_failure_rate": 0.006}, ["format_failure_rate"]),
        ({"leakage_reward_rate": 1e-9}, ["leakage_reward_rate"]),
        ({"length_gaming_rate": 0.011}, ["length_gaming_rate"]),
        ({"heldout_regression_rate": 0.011}, ["heldout_regression_rate"]),
        *[({n: bad}, ["invalid_input"]) for n in ("false_positive_rate", "heldout_regression_rate") for bad in (None, NAN, -0.1, 1.1)],
        ({"sample_count": None}, ["invalid_input"]),
        ({"sample_count": -1}, ["invalid_input"]),
    ]
    got = decided(spark, gates.reward_admission, REWARD, GOOD_REWARD, [c for c, _ in cases])
    assert [(r["reasons"], r["accepted"], r["admitted"]) for r in got] == [(w, not w, not w) for _, w in cases]
    loose = decided(spark, lambda df: gates.reward_admission(df, least_samples=1), REWARD, GOOD_REWARD, [{"sample_count": 5}])
    assert (loose[0]["accepted"], loose[0]["admitted"]) == (True, False)


def test_operator_promotion(spark):
    good = ("o", True, 3, 0.8, 0.02)
    mined = "operator_name string, promotion_safe boolean, support_count long, symbolic_success_rate double, mean_verifier_gain double"
    cluster = "dominant_operator string, member_count long, operator_purity double, symbolic_success_rate double, mean_verifier_score double, failure_rate double, distinct_problem_count long, promotion_safe boolean"
    best = ("o", 9, 0.85, 0.8, 0.55, 0.2, 1, True)

    def reasons(candidates, clusters):
        out = gates.operator_promotion(spark.createDataFrame(candidates, mined), spark.createDataFrame(clusters, cluster))
        return sorted((r["operator_name"] or "", r["cluster_count"], r["reasons"], r["promoted"]) for r in out.collect())

    assert reasons([good, good], [best]) == [("o", 1, [], True)] * 2
    for i, value, name in [(1, None, "candidate_not_miner_promotion_safe"), (2, 2, "insufficient_support"), (3, 0.79, "symbolic_success_below_threshold"), (4, None, "verifier_gain_below_threshold")]:
        assert reasons([good[:i] + (value,) + good[i + 1 :]], [best]) == [("o", 1, [name], False)]
    cases = [(2, 0.84, "cluster_purity_below_threshold"), (3, None, "cluster_symbolic_success_below_threshold"), (4, 0.54, "cluster_verifier_score_below_threshold"), (5, 0.21, "cluster_failure_rate_above_threshold"), (6, 0, "insufficient_distinct_problem_support"), (7, None, "no_promotion_safe_cluster")]
    for i, value, name in cases:
        assert reasons([good], [best[:i] + (value,) + best[i + 1 :]]) == [("o", 1, [name], False)]
    # The best figure of any cluster counts; without a cluster all six are missing.
    assert reasons([good], [best[:2] + (0.1,) + best[3:], best[:5] + (0.9,) + best[6:]]) == [("o", 2, [], True)]
    assert reasons([good, (None, *good[1:])], [(None, *best[1:])]) == [(n, 0, [c for _, _, c in cases], False) for n in ("", "o")]
    assert reasons([], [best]) == []


def test_gates_refuse_columns_that_they_add(spark):
    df = spark.createDataFrame([], f"{CANDIDATE}, Status string")
    with pytest.raises(ValueError, match="status"):
        gates.candidate(df)
    assert gates.candidate(df.drop("Status")).count() == 0
