"""Overlaps between row sets by key: leakage, contamination, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keys_of(df: DataFrame, kinds: dict[str, Column], *keep: str) -> DataFrame:
    """A row for each kind of key of each row: kind, key; null keys are left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("key")) for k, v in kinds.items()])
    return df.select(*keep, F.explode(pairs).alias("__k")).select(*keep, "__k.kind", "__k.key").where("key IS NOT NULL")


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of left that right holds too. Both: kind, key."""
    return left.join(right.select("kind", "key").distinct(), ["kind", "key"], "left_semi")


def overlap_report(left: DataFrame, right: DataFrame, kinds: list[str], examples: int = 10) -> DataFrame:
    """For each kind, how many distinct keys both hold, with the first examples; kinds without any too."""
    both = overlap(left, right).select("kind", "key").distinct()
    some = both.groupBy("kind").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))
    every = left.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return every.join(some, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("overlap"), "first_key")


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side holds, with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("missing").alias("side")).unionByName(b.join(a, key, "left_anti").select(key, F.lit("extra").alias("side")))


def same_key_conflicts(df: DataFrame, key: str, part: str) -> DataFrame:
    """Keys found in more than one part: number of rows of each pair of parts, without a row pair being made."""
    n = df.groupBy(key, part).agg(F.count("*").alias("n"))
    a, b = n.select(key, F.col(part).alias("part_a"), F.col("n").alias("na")), n.select(key, F.col(part).alias("part_b"), F.col("n").alias("nb"))
    return a.join(b, key).where("part_a < part_b").groupBy("part_a", "part_b").agg(F.count("*").alias("shared_keys"), F.sum(F.col("na") * F.col("nb")).alias("pairs"))
