"""Aggregates: evaluation metrics, distributions, calibration, percentiles, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numbers import bucket, clamp, ratio, share


def answer_metrics(df: DataFrame, keys: list, *, answered: Column, correct: Column, should_answer: Column) -> DataFrame:
    """Counts and rates of attempts, right answers and abstentions."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return df.groupBy(*keys).agg(
        F.count("*").alias("row_count"), n(answered).alias("attempted"), n(answered & correct).alias("correct"), n(~answered).alias("abstained"),
        F.round(ratio(n(answered & correct), F.count("*")), 6).alias("exact_match"), F.round(ratio(n(answered), F.count("*")), 6).alias("attempt_rate"),
        F.round(ratio(n(~answered & ~should_answer), n(~answered)), 6).alias("abstain_precision"), F.round(ratio(n(~answered & ~should_answer), n(~should_answer)), 6).alias("abstain_recall"),
        F.round(ratio(n((answered & correct) | (~answered & ~should_answer)), F.count("*")), 6).alias("behaviour_accuracy"),
    )


def verdict(rows: Column, *limits: tuple[Column, float]) -> Column:
    """WARN without rows, FAIL if a value is below its limit, else PASS."""
    bad = F.lit(False)
    for value, least in limits:
        bad = bad | (value < least)
    return F.when(rows == 0, F.lit("WARN")).when(bad, F.lit("FAIL")).otherwise(F.lit("PASS"))


def shares(df: DataFrame, key: str) -> DataFrame:
    """Rows of each value of key and their share of all."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def largest_share(df: DataFrame, key: list, item: Column) -> DataFrame:
    """By key: rows, distinct items, and the largest item's share."""
    n = df.groupBy(*key, item.alias("__item")).agg(F.count("*").alias("__n"))
    return n.groupBy(*key).agg(F.sum("__n").alias("n"), F.count("__item").alias("distinct_items"), F.round(F.max("__n") / F.sum("__n"), 6).alias("max_share"))


def calibration_table(df: DataFrame, p: Column, y: Column, buckets: int, *keys: str) -> DataFrame:
    """Each bucket's rows, mean probability and mean label; empty buckets too."""
    got = df.select(*keys, bucket(p, buckets).alias("bucket"), clamp(p).alias("__p"), y.cast("double").alias("__y")).groupBy(*keys, "bucket").agg(F.count("*").alias("n"), F.round(F.avg("__p"), 6).alias("mean_p"), F.round(F.avg("__y"), 6).alias("mean_y"))
    every = df.select(*keys).distinct().crossJoin(df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))) if keys else df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(got, [*keys, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def calibration_errors(df: DataFrame, p: Column, y: Column, buckets: int, *keys: str) -> DataFrame:
    """Rows, accuracy at 0.5, Brier score, expected and largest calibration error."""
    row = df.select(*keys, bucket(p, buckets).alias("__b"), clamp(p).alias("__p"), y.cast("double").alias("__y"))
    by = row.groupBy(*keys, "__b").agg(F.count("*").alias("n"), F.sum("__p").alias("sp"), F.sum("__y").alias("sy"), F.sum(F.pow(F.col("__p") - F.col("__y"), 2)).alias("sb"), F.sum(((F.col("__p") >= 0.5) == (F.col("__y") >= 0.5)).cast("int")).alias("hit"))
    gap = F.abs(F.col("sp") - F.col("sy"))
    return by.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.round(F.sum("hit") / F.sum("n"), 6).alias("accuracy"), F.round(F.sum("sb") / F.sum("n"), 6).alias("brier"),
        F.round(F.sum(gap) / F.sum("n"), 6).alias("ece"), F.round(F.max(gap / F.col("n")), 6).alias("mce"),
    )


def nearest_rank(values: Column, q: float) -> Column:
    """The value at index round((n - 1) q), halves to even, of a sorted array."""
    return F.element_at(values, (F.bround((F.size(values) - 1) * F.lit(q)) + 1).cast("int"))


def nearest_rank_rows(df: DataFrame, keys: list, value: str, q: float, alias: str) -> DataFrame:
    """(keys, alias): nearest_rank() of each key by a sort that can spill, for keys of any number of rows; null values are left out."""
    known = df.where(F.col(value).isNotNull()).select(*keys, value)
    n = F.count("*").over(Window.partitionBy(*keys))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    ranked = known.select(*keys, value, at.alias("__at"), n.alias("__n"))
    return ranked.where(F.col("__at") == F.bround((F.col("__n") - 1) * F.lit(q)) + 1).select(*keys, F.col(value).alias(alias))


def versus_baseline(df: DataFrame, variant: str, value: Column, keys: list, baseline: Column) -> DataFrame:
    """By keys: count, mean, least, most, best variant, and the best variant's lead over the baseline's mean.

    Ties for best go to the smaller variant.
    """
    by = df.groupBy(*keys, variant).agg(F.avg(value).alias("__m"), F.count("*").alias("__n"), F.sum(value).alias("__s"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    best = F.min_by(F.col(variant), F.struct(-F.round("__m", 6), F.col(variant)))
    return by.groupBy(*keys).agg(
        F.sum("__n").alias("n"), F.round(F.sum("__s") / F.sum("__n"), 6).alias("mean"), F.min("__lo").alias("least"), F.max("__hi").alias("most"),
        best.alias("best"), F.round(F.max("__m") - F.max(F.when(baseline, F.col("__m"))), 6).alias("lead"),
    )


def counted_label(df: DataFrame, keys: list, item: str, ties_to_largest: bool = True) -> DataFrame:
    """The commonest item of each key."""
    n = df.groupBy(*keys, item).agg(F.count("*").alias("n"))
    by = F.struct("n", item) if ties_to_largest else F.struct(F.col("n"), -F.col(item))
    return n.groupBy(*keys).agg(F.max_by(item, by).alias("dominant"), F.max("n").alias("n"))


def prefix_rate(c: Column) -> Column:
    return F.round(share(c), 6)
