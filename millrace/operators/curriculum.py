"""Curricula: verdicts in order of precedence, oversampling, greedy coverage, stages, program synthesis."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.lineage import cut
from millrace.operators.solvers import execute


def quality_verdicts(df: DataFrame, key: str, text_hash: str, rule: str, cap: int) -> DataFrame:
    """(key, verdict): the row's own reason, else near_duplicate, else over_cap of its rule, else keep.

    The reduced form of its SQL: every later row of a text is near_duplicate, also
    if its first is not kept. greedy_verdicts() is the whole rule.
    """
    bad = df.where("reason IS NOT NULL").select(key, F.col("reason").alias("verdict"))
    k = df.where("reason IS NULL").withColumn("__k", F.row_number().over(Window.partitionBy(text_hash).orderBy(key)))
    again = k.where("__k > 1").select(key, F.lit("near_duplicate").alias("verdict"))
    r = k.where("__k = 1").withColumn("__r", F.row_number().over(Window.partitionBy(rule).orderBy(key)))
    return bad.unionByName(again).unionByName(r.select(key, F.when(F.col("__r") > cap, "over_cap").otherwise("keep").alias("verdict")))


def greedy_verdicts(df: DataFrame, key: str, template: str, rule: str, cap: int) -> DataFrame:
    """(key, verdict) as a walk in order of key gives it: the row's own reason, else near_duplicate of a kept row, else over_cap of its rule's kept rows, else keep.

    Of a template in a rule only the first row can be kept. Among these, the walk
    is the stable matching of rules (cap places) with templates (one), both by
    order: each round, a rule offers its first cap rows that no template has
    refused, and a template holds the first offer and refuses all after it, until
    no offer is refused. What is held are at most cap rows a rule.
    """
    bad = df.where("reason IS NOT NULL").select(key, F.col("reason").alias("verdict"))
    good = df.where("reason IS NULL").select(F.col(key).alias("k"), F.col(template).alias("t"), F.col(rule).alias("r"))
    place = F.struct("k", "t", "r")
    edges = cut(good.groupBy("t", "r").agg(F.min("k").alias("k")).withColumn("place", place))
    held = None
    while True:
        left = edges if held is None else edges.join(held, F.col("t").eqNullSafe(F.col("ht")), "left").where(F.col("held").isNull() | (F.col("place") <= F.col("held"))).select("t", "r", "k", "place")
        offers = left.withColumn("n", F.row_number().over(Window.partitionBy("r").orderBy("place"))).where(F.col("n") <= cap)
        held = cut(offers.groupBy(F.col("t").alias("ht")).agg(F.min("place").alias("held"), F.count("*").alias("offers")))
        refused = held.agg(F.sum(F.col("offers") - 1)).head()[0] or 0
        held = held.drop("offers")
        if not refused:
            break
    rows = good.withColumn("place", place).withColumn("n", F.row_number().over(Window.partitionBy("t", "r", "k").orderBy(F.lit(0))))
    j = rows.join(held, F.col("t").eqNullSafe(F.col("ht")), "left")
    verdict = F.when((F.col("place") == F.col("held")) & (F.col("n") == 1), "keep").when(F.col("held") <= F.col("place"), "near_duplicate").otherwise("over_cap")
    return bad.unionByName(j.select(F.col("k").alias(key), verdict.alias("verdict")))


def oversample(df: DataFrame, key: str, order: list) -> DataFrame:
    """Every key's rows repeated in order until each key has as many as the largest."""
    n = df.groupBy(key).agg(F.count("*").alias("__n"))
    n = n.withColumn("__m", F.max("__n").over(Window.partitionBy()))
    r = df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).join(n, key)
    copies = F.floor(F.col("__m") / F.col("__n")) + (F.col("__r") < F.col("__m") % F.col("__n")).cast("int")
    return r.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).drop("__n", "__m", "__r")


def cover(df: DataFrame, key: str, rule: str, template: str, order: list[Column], per_rule: int, per_template: int, train_limit: int, holdout_limit: int) -> DataFrame:
    """(key, rule, part, place): the greedy choice of training and held-out rows in the given order.

    The first rows go to the holdout until it has enough rules or rows; later
    rows of its rules are left out of training. Training takes at most per_rule
    rows of a rule, per_template of a rule's template and train_limit in all, the
    holdout half as many of a template (2 at least). part is train, holdout or
    the reason of rejection; place (from 1) is the row's in its part.

    No state is walked through: the holdout is all before one row (the first of
    its last rule, or its last), and a rule's training rows need no other rule
    until the limit. Only rows under the limits and one place a rule are joined.
    """
    p = df.select(F.col(key).alias("id"), F.col(rule).alias("rule"), F.col(template).alias("template"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(key).alias("id")).alias("at"))
    p = cut(p)
    rules = p.groupBy("rule").agg(F.min("at").alias("first"))
    n = rules.count()
    target = min(max(1, holdout_limit // max(1, per_rule)), max(1, n // 4), max(1, n - 1)) if holdout_limit > 0 else 0
    by_template, by_rule = Window.partitionBy("rule", "template").orderBy("at"), Window.partitionBy("rule").orderBy("at")
    last = rules.orderBy("first").limit(target).agg(F.max("first").alias("edge"), F.count("*").alias("rules"))
    early = p.crossJoin(F.broadcast(last)).where(F.col("at") <= F.col("edge")).drop("edge", "rules")
    few = early.withColumn("k", F.row_number().over(by_template)).where(F.col("k") <= max(2, per_template // 2))
    held = cut(few.orderBy("at").limit(holdout_limit).select("id", "rule", "at"))  # at most holdout_limit rows
    full = held.agg(F.max("at").alias("end"), F.count("*").alias("n"))
    edge = F.broadcast(cut(last.crossJoin(full).select(F.when(F.col("n") < holdout_limit, F.col("edge")).otherwise(F.col("end")).alias("edge"))))
    out_rules = F.broadcast(held.select(F.col("rule").alias("hr"), F.lit(True).alias("held")).distinct())  # at most holdout_limit
    split = p.crossJoin(edge).withColumn("early", F.coalesce(F.col("at") <= F.col("edge"), F.lit(False))).drop("edge")
    split = split.join(out_rules, F.col("rule").eqNullSafe(F.col("hr")), "left").withColumn("out", F.col("held").isNotNull()).drop("hr", "held")
    late = split.where(~F.col("early") & ~F.col("out"))
    chosen = late.withColumn("k", F.row_number().over(by_template)).where(F.col("k") <= per_template).drop("k")
    chosen = chosen.withColumn("k", F.row_number().over(by_rule)).where(F.col("k") <= per_rule)
    chosen = cut(chosen.orderBy("at").limit(train_limit).select("id", "rule", "template", "at"))  # at most train_limit rows
    rule_full = chosen.groupBy(F.col("rule").alias("r1")).agg(F.max("at").alias("rule_end"), F.count("*").alias("n")).where(F.col("n") >= per_rule).drop("n")
    kind_full = chosen.groupBy(F.col("rule").alias("r2"), F.col("template").alias("t2")).agg(F.max("at").alias("kind_end"), F.count("*").alias("n")).where(F.col("n") >= per_template).drop("n")
    place = F.row_number().over(Window.partitionBy("part").orderBy("at")).cast("long")
    taken = held.select("id", "at", F.lit("holdout").alias("part")).unionByName(chosen.select("id", "at", F.lit("train").alias("part")))
    taken = taken.withColumn("place", place).select(F.col("id").alias("i3"), F.col("at").alias("a3"), "part", "place")
    j = split.join(taken, (F.col("id") == F.col("i3")) & (F.col("at") == F.col("a3")), "left")
    j = j.join(rule_full, F.col("rule").eqNullSafe(F.col("r1")), "left").join(kind_full, F.col("rule").eqNullSafe(F.col("r2")) & F.col("template").eqNullSafe(F.col("t2")), "left")
    why = F.when(F.col("early"), "holdout_template_cap").when(F.col("out"), "heldout_rule").when(F.col("at") > F.col("rule_end"), "rule_cap").when(F.col("at") > F.col("kind_end"), "template_cap").otherwise("train_limit")
    return j.select(F.col("id").alias(key), F.col("rule").alias(rule), F.coalesce("part", why).alias("part"), "place")


def stages(df: DataFrame, key: str, micro: int, first: int, share: float) -> DataFrame:
    """(stage, n): a micro set, a first set, and the first set with a share of synthetic rows."""
    n = df.count()
    base = min(first, n)
    made = min(n, int(base * share / (1 - share)))
    return df.sparkSession.createDataFrame([("micro", min(micro, n)), ("v1", base), ("v2", base + made)], "stage string, n bigint")


def synthesise(df: DataFrame, key: str, programs: list[str]) -> DataFrame:
    """(key, program): the first program that turns `given` into `wanted`."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pdf: pd.DataFrame = b.to_pandas()
            found = [next((p for p in programs if execute(p, g) == w), None) for g, w in zip(pdf["given"], pdf["wanted"], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=[key, "program"])

    return df.select(key, "given", "wanted").mapInArrow(run, f"{key} {kind}, program string")
