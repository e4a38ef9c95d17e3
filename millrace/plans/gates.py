"""Queries of the gates: evidence bound from driver tables, decided by millrace.operators.gates.

The evidence is one list of expressions that both engines read, so that rows
pass and fail on every reason; the SQL states each gate's rules by itself.
"""

from __future__ import annotations

from millrace.operators import gates
from millrace.plans.registry import query


def _spark(bound: dict[str, str]) -> list[str]:
    return [f"{e.replace('LIST(', 'array(')} AS {n}" for n, e in bound.items()]


def _duck(key: str, bound: dict[str, str], table: str) -> str:
    return f"SELECT {key}, " + ", ".join(f"{e.replace('LIST(', 'list_value(')} AS {n}" for n, e in bound.items()) + f" FROM {table}"


def _reasons(**rules: str) -> str:
    cases = ", ".join(f"CASE WHEN {rule} THEN '{name.replace('__', ':')}' END" for name, rule in rules.items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


_PROMOTION = {
    "submission_passed": "o_orderstatus <> 'P' OR o_totalprice > 300000",
    "submission_fields_valid": "CASE WHEN o_totalprice >= 5000 THEN true END",
    "transfer_passed": "o_orderpriority <> '5-LOW'",
    "private_like_passed": "month(o_orderdate) <> 12",
    "regression_passed": "CASE WHEN day(o_orderdate) <> 1 THEN true END",
    "firewall_decision": "CASE WHEN o_totalprice > 450000 THEN 'reject' WHEN o_totalprice > 400000 THEN 'investigate' WHEN o_totalprice > 7000 THEN 'allow' END",
    "firewall_reasons": "CASE WHEN o_totalprice > 425000 THEN LIST('public_delta') END",
    "training_plan_hash": "CASE WHEN year(o_orderdate) = 1998 THEN ' ' ELSE 'a1' END",
    "dataset_manifest_hash": "CASE WHEN o_custkey > 20 THEN 'b2' END",
    "trace_manifest_hash": "CASE WHEN o_custkey <> 30 THEN 'c3' ELSE '' END",
    "lora_config_hash": "CASE WHEN day(o_orderdate) <> 2 THEN 'd4' END",
    "adapter_hash": "CASE WHEN day(o_orderdate) <> 3 THEN 'e5' END",
    "adapter_rank": "CASE WHEN year(o_orderdate) <> 1995 THEN CAST(floor(o_totalprice / 10000) AS INT) END",
    "contaminated": "CASE WHEN o_custkey < 60 THEN day(o_orderdate) > 15 END",
    "contamination_flags": "CASE WHEN o_custkey < 40 THEN LIST(' ') WHEN o_custkey < 80 THEN LIST('eval', ' ') END",
    "investigations": "CASE WHEN day(o_orderdate) = 15 THEN LIST('lineage', ' ') WHEN day(o_orderdate) = 16 THEN LIST('') END",
}
_HASHES = {f"missing_hash__{h}": f"trim(coalesce({h}, '')) = ''" for h in gates.REQUIRED_HASHES}
_PROMOTION_SQL = _reasons(
    submission_exact_failed="submission_passed IS NOT TRUE OR submission_fields_valid IS NOT TRUE",
    transfer_failed="transfer_passed IS NOT TRUE",
    private_like_failed="private_like_passed IS NOT TRUE",
    public_firewall_blocked="firewall_decision IS DISTINCT FROM 'allow'",
    regression_failed="regression_passed IS NOT TRUE",
    **_HASHES,
    adapter_rank_exceeds_32="adapter_rank > 32",
    contamination="contaminated IS TRUE OR len(list_filter(contamination_flags, lambda x: trim(x) <> '')) > 0",
    unresolved_investigation="len(u) > 0",
)


@query(
    "gte05_promotion_gate",
    f"WITH e AS ({_duck('o_orderkey', _PROMOTION, 'orders')}), "
    "o AS (SELECT *, coalesce(list_filter(investigations, lambda x: trim(x) <> ''), []) AS i FROM e), "
    "v AS (SELECT *, CASE WHEN firewall_decision = 'investigate' THEN list_sort(list_distinct(list_concat(i, coalesce(firewall_reasons, ['public_firewall_investigate'])))) ELSE i END AS u FROM o), "
    f"r AS (SELECT *, list_sort({_PROMOTION_SQL}) AS r FROM v) "
    "SELECT o_orderkey, array_to_string(u, ',') AS unresolved, array_to_string(r, ',') AS reasons, CASE WHEN len(r) = 0 THEN 'allow' ELSE 'reject' END AS decision FROM r",
)
def _(t):
    out = gates.promotion(t.orders.selectExpr("o_orderkey", *_spark(_PROMOTION)))
    return out.selectExpr("o_orderkey", "array_join(unresolved, ',') AS unresolved", "array_join(reasons, ',') AS reasons", "decision")


_STAGE = {
    "stage": "CASE o_orderpriority WHEN '1-URGENT' THEN 'v0_to_v1' WHEN '2-HIGH' THEN 'v1_to_v2' WHEN '3-MEDIUM' THEN 'v2_to_v3' WHEN '5-LOW' THEN 'submission' END",
    "token_mask_valid": "CASE WHEN o_totalprice > 8000 THEN o_totalprice < 490000 END",
    "loss_finite": "o_orderstatus <> 'P' OR day(o_orderdate) < 20",
    "adapter_size_mb": "CASE WHEN o_custkey <> 10 THEN o_totalprice / 250 END",
    "adapter_size_limit_mb": "CASE WHEN year(o_orderdate) = 1996 THEN 1000 END",
    "empty_output_count": "CASE WHEN day(o_orderdate) = 30 THEN 2 WHEN day(o_orderdate) <> 31 THEN 0 END",
    "prompt_copy_count": "CASE WHEN month(o_orderdate) = 12 THEN 1 END",
    "public_like_delta": "CASE WHEN o_custkey <> 70 THEN (o_custkey - 100) / 1e4 END",
    "private_like_delta": "CASE WHEN o_custkey <> 80 THEN (1200 - o_custkey) / 1e3 END",
    "synthetic_gain_only": "CASE WHEN year(o_orderdate) = 1994 THEN true END",
    "package_clean": "CASE WHEN day(o_orderdate) <> 5 THEN day(o_orderdate) <> 6 END",
    "rank": "CASE WHEN o_custkey <> 90 THEN CAST(floor(o_totalprice / 12000) AS INT) END",
    "failed_lineage": "CASE WHEN month(o_orderdate) < 7 THEN month(o_orderdate) = 6 END",
}
_LATER = "stage IN ('v1_to_v2', 'v2_to_v3', 'submission')"
_STAGE_SQL = _reasons(
    token_mask_invalid="token_mask_valid IS NOT TRUE",
    loss_not_finite="loss_finite IS NOT TRUE",
    adapter_size_exceeds_limit="coalesce(adapter_size_mb, 1e9) > coalesce(adapter_size_limit_mb, 1500)",
    empty_or_nonsense_outputs="empty_output_count IS NULL OR empty_output_count > 0",
    prompt_copy_outputs="prompt_copy_count > 0",
    public_like_collapse=f"{_LATER} AND public_like_delta < -0.005",
    no_private_like_improvement=f"{_LATER} AND coalesce(private_like_delta, 0) <= 0",
    synthetic_only_gain="stage = 'v2_to_v3' AND synthetic_gain_only",
    package_not_clean="stage = 'submission' AND package_clean IS NOT TRUE",
    rank_gt_32="stage = 'submission' AND (rank IS NULL OR rank > 32)",
    failed_lineage="stage = 'submission' AND failed_lineage",
)


@query("gte09_promotion_decision", f"WITH e AS ({_duck('o_orderkey', _STAGE, 'orders')}), r AS (SELECT *, list_sort({_STAGE_SQL}) AS r FROM e) SELECT o_orderkey, stage, array_to_string(r, ',') AS reasons, CASE WHEN len(r) = 0 THEN 'PROMOTE' ELSE 'REJECT' END AS decision FROM r")
def _(t):
    return gates.stage_promotion(t.orders.selectExpr("o_orderkey", *_spark(_STAGE))).selectExpr("o_orderkey", "stage", "array_join(reasons, ',') AS reasons", "decision")


_CANDIDATE = {
    "eval_completed": "CASE WHEN p_size > 5 THEN true END",
    "calibration_recorded": "p_type <> 'ECONOMY'",
    "package_status": "CASE WHEN p_brand = 'Brand#3' THEN 'FAIL' WHEN p_brand <> 'Brand#4' THEN 'PASS' END",
    "exact_match": "CASE WHEN p_size <> 40 THEN p_size / 5e1 END",
    "first_baseline": "CASE WHEN p_brand <> 'Brand#7' THEN 3e-1 END",
    "second_baseline": "CASE WHEN p_brand < 'Brand#15' THEN 0e0 WHEN p_brand <> 'Brand#2' THEN 5e-1 END",
    "severe_families": "CASE WHEN p_size > 47 THEN LIST(p_type) END",
}
_CANDIDATE_SQL = _reasons(
    eval_missing_or_incomplete="eval_completed IS NOT TRUE",
    package_not_pass="package_status IS DISTINCT FROM 'PASS'",
    below_first_baseline="eval_completed AND coalesce(exact_match, 0) < coalesce(first_baseline, 0)",
    below_second_baseline="eval_completed AND second_baseline <> 0 AND coalesce(exact_match, 0) < second_baseline",
    severe_family_regression="len(severe_families) > 0",
)


@query("gte13_candidate_decision", f"WITH e AS ({_duck('p_partkey', _CANDIDATE, 'part')}), r AS (SELECT *, {_CANDIDATE_SQL} AS r FROM e) SELECT p_partkey, array_to_string(r, ',') AS reasons, CASE WHEN calibration_recorded IS TRUE THEN '' ELSE 'calibration_missing' END AS warnings, CASE WHEN len(r) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, len(r) = 0 AND calibration_recorded IS TRUE AS submit FROM r")
def _(t):
    out = gates.candidate(t.part.selectExpr("p_partkey", *_spark(_CANDIDATE)))
    return out.selectExpr("p_partkey", "array_join(reasons, ',') AS reasons", "array_join(warnings, ',') AS warnings", "status", "submit")


def _share(condition: str) -> str:
    return f"avg(CASE WHEN {condition} THEN 1 ELSE 0 END)"


_REWARD = {
    "sample_count": "CASE WHEN l_suppkey <> 5 THEN count(*) END",
    "false_positive_rate": _share("l_discount > 0.095 AND l_tax > 0.075"),
    "format_failure_rate": _share("l_quantity = 50 AND l_discount < 0.005"),
    "leakage_reward_rate": _share("l_quantity = 1 AND l_discount > 0.095 AND l_tax < 0.005"),
    "length_gaming_rate": _share("l_quantity >= 49 AND l_linenumber >= 6"),
    "heldout_regression_rate": f"CASE WHEN l_suppkey = 3 THEN 15e-1 ELSE {_share('l_quantity <= 2 AND l_linenumber = 7')} END",
}
_REWARD_SQL = _reasons(
    insufficient_samples="sample_count < 560",
    false_positive_rate="false_positive_rate > 0.01",
    format_failure_rate="format_failure_rate > 0.005",
    leakage_reward_rate="leakage_reward_rate > 0",
    length_gaming_rate="length_gaming_rate > 0.015",
    heldout_regression_rate="heldout_regression_rate > 0.01",
)


@query("gte08_reward_admission", f"WITH e AS ({_duck('l_suppkey', _REWARD, 'lineitem')} GROUP BY l_suppkey), r AS (SELECT *, CASE WHEN sample_count IS NULL OR heldout_regression_rate > 1 THEN ['invalid_input'] ELSE {_REWARD_SQL} END AS r FROM e) SELECT l_suppkey, array_to_string(r, ',') AS reasons, len(r) = 0 AS accepted, len(r) = 0 AND length_gaming_rate <= 0.01 AS admitted FROM r")
def _(t):
    t.lineitem.createOrReplaceTempView("__gate_lines")
    e = t.spark.sql(f"SELECT l_suppkey, {', '.join(_spark(_REWARD))} FROM __gate_lines GROUP BY l_suppkey")
    return gates.reward_admission(e, least_samples=560, most_length_gaming=0.015).selectExpr("l_suppkey", "array_join(reasons, ',') AS reasons", "accepted", "admitted")


_MINED = {"promotion_safe": "p_brand <> 'Brand#9'", "support_count": "count(*)", "symbolic_success_rate": _share("p_size > 9"), "mean_verifier_gain": "avg(p_size) / 1275e0"}
_CLUSTERS = {
    "member_count": "count(*)",
    "operator_purity": _share("p_size > 8"),
    "symbolic_success_rate": _share("p_size > 12"),
    "mean_verifier_score": "avg(p_size) / 5e1",
    "failure_rate": _share("p_size < 12"),
    "distinct_problem_count": "count(DISTINCT p_name)",
    "promotion_safe": "min(p_size) > 3",
}
_MINED_SQL = _reasons(
    candidate_not_miner_promotion_safe="NOT promotion_safe",
    insufficient_support="support_count < 3",
    symbolic_success_below_threshold="symbolic_success_rate < 0.8",
    verifier_gain_below_threshold="mean_verifier_gain < 0.02",
    cluster_purity_below_threshold="coalesce(purity, 0) < 0.85",
    cluster_symbolic_success_below_threshold="coalesce(symbolic, 0) < 0.8",
    cluster_verifier_score_below_threshold="coalesce(score, 0) < 0.55",
    cluster_failure_rate_above_threshold="coalesce(failure, 1) > 0.2",
    insufficient_distinct_problem_support="coalesce(problems, 0) < 8",
    no_promotion_safe_cluster="safe IS NOT TRUE",
)


@query(
    "gte11_operator_promotion",
    f"WITH m AS ({_duck('p_brand', _MINED, 'part')} GROUP BY p_brand), c AS ({_duck('p_brand AS b, p_type', _CLUSTERS, 'part')} WHERE p_brand <> 'Brand#11' GROUP BY p_brand, p_type), "
    "d AS (SELECT b, count(*) AS n, max(member_count) AS support, round(max(operator_purity), 6) AS purity, round(max(symbolic_success_rate), 6) AS symbolic, round(max(mean_verifier_score), 6) AS score, round(min(failure_rate), 6) AS failure, max(distinct_problem_count) AS problems, bool_or(promotion_safe) AS safe FROM c GROUP BY b), "
    f"r AS (SELECT *, {_MINED_SQL} AS r FROM m LEFT JOIN d ON p_brand = b) "
    "SELECT p_brand, coalesce(n, 0) AS cluster_count, coalesce(support, 0) AS max_cluster_support, coalesce(purity, 0) AS purity, coalesce(failure, 1) AS failure, array_to_string(r, ',') AS reasons, len(r) = 0 AS promoted FROM r",
)
def _(t):
    t.part.createOrReplaceTempView("__gate_parts")
    mined = t.spark.sql(f"SELECT p_brand AS operator_name, {', '.join(_spark(_MINED))} FROM __gate_parts GROUP BY p_brand")
    clusters = t.spark.sql(f"SELECT p_brand AS dominant_operator, p_type, {', '.join(_spark(_CLUSTERS))} FROM __gate_parts WHERE p_brand <> 'Brand#11' GROUP BY p_brand, p_type")
    out = gates.operator_promotion(mined, clusters, gates.OperatorLimits(problem_support=8))
    return out.selectExpr("operator_name AS p_brand", "cluster_count", "max_cluster_support", "max_cluster_operator_purity AS purity", "min_cluster_failure_rate AS failure", "array_join(reasons, ',') AS reasons", "promoted")
