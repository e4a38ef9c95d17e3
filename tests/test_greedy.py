"""Greedy choices against the walk that defines them."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import curriculum


@pytest.mark.parametrize("seed", range(4))
def test_verdicts_of_a_walk(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice(["a", "b", "c", None]), r.choice([*range(6 + 12 * seed), None]), r.choice([None] * 6 + ["short"])) for i in range(150)]
    if seed == 3:
        rows += [(7, "a", 99, None), (7, "a", 99, None)]
    seen, count, want = set(), Counter(), []
    for i, rule, text, reason in sorted(rows, key=lambda x: x[0]):
        reason = reason or ("near_duplicate" if text in seen else "over_cap" if count[rule] >= 4 else None)
        if reason is None:
            seen.add(text)
            count[rule] += 1
        want.append((i, reason or "keep"))
    if seed == 3:
        want = [w for w in want if w[0] != 7]
    df = spark.createDataFrame(rows, "id int, rule string, h int, reason string")
    got = sorted(tuple(x) for x in curriculum.greedy_verdicts(df, "id", "h", "rule", 4).collect())
    assert [g for g in got if seed != 3 or g[0] != 7] == sorted(want)


def test_copy_of_a_row_over_its_cap_is_kept(spark):
    df = spark.createDataFrame([(1, "a", 1, None), (2, "a", 2, None), (3, "b", 2, None)], "id int, rule string, h int, reason string")
    assert dict(tuple(x) for x in curriculum.greedy_verdicts(df, "id", "h", "rule", 1).collect()) == {1: "keep", 2: "over_cap", 3: "keep"}
    assert curriculum.greedy_verdicts(df.limit(0), "id", "h", "rule", 1).count() == 0


def walk(rows, per_rule, per_template, train_limit, holdout_limit):
    """rows (id, rule, template) in order."""
    n = len({rule for _, rule, _ in rows})
    target = min(max(1, holdout_limit // max(1, per_rule)), max(1, n // 4), max(1, n - 1))
    train, holdout, train_rules, out_rules, rules, kinds, held, why = [], [], set(), set(), Counter(), Counter(), Counter(), {}
    for i, rule, t in rows:
        if rules[rule] >= per_rule:
            why[i] = "rule_cap"
        elif len(holdout) < holdout_limit and rule not in train_rules and len(out_rules) < target:
            if held[rule, t] >= max(2, per_template // 2):
                why[i] = "holdout_template_cap"
                continue
            holdout.append(i)
            out_rules.add(rule)
            held[rule, t] += 1
        elif rule in out_rules:
            why[i] = "heldout_rule"
        elif kinds[rule, t] >= per_template:
            why[i] = "template_cap"
        elif len(train) < train_limit:
            train.append(i)
            train_rules.add(rule)
            rules[rule] += 1
            kinds[rule, t] += 1
        else:
            why[i] = "train_limit"
    return {**{i: ("train", k) for k, i in enumerate(train, 1)}, **{i: ("holdout", k) for k, i in enumerate(holdout, 1)}, **{i: (w, None) for i, w in why.items()}}


@pytest.mark.parametrize(("rules", "caps"), [(12, (6, 2, 1000, 20)), (12, (6, 2, 25, 20)), (40, (4, 3, 60, 7)), (3, (50, 5, 40, 6)), (1, (5, 2, 10, 4)), (30, (4, 8, 30, 0))])
def test_cover_of_a_walk(spark, rules, caps):
    r = random.Random(rules)
    rows = [(i, r.choice([None, *(f"r{k}" for k in range(rules - 1))]), r.choice([None, "t", "u", "v"]), r.randrange(40)) for i in range(300)]
    want = walk([x[:3] for x in sorted(rows, key=lambda x: (-x[3], x[0]))], *caps)
    df = spark.createDataFrame(rows, "id int, rule string, template string, score int")
    got = curriculum.cover(df, "id", "rule", "template", [-F.col("score")], *caps).collect()
    assert {x["id"]: (x["part"], x["place"]) for x in got} == want
    assert len(got) == len(rows)
