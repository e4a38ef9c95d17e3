"""Operators on ordered rows: runs, neighbours, n-grams, chains, frontiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def longest_run(df: DataFrame, key: list, order: list, item: str) -> DataFrame:
    """The longest run of equal neighbouring items of each key (gaps and islands)."""
    w = Window.partitionBy(*key).orderBy(*order)
    change = (~F.col(item).eqNullSafe(F.lag(item).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    island = df.withColumn("__c", change).withColumn("__i", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*key, "__i").agg(F.count("*").alias("__n")).groupBy(*key).agg(F.max("__n").alias("longest_run"))


def neighbours(df: DataFrame, key: list, order: list, item: str, weight: Column | None = None) -> DataFrame:
    """(item, following, n): how often one item directly follows another."""
    w = Window.partitionBy(*key).orderBy(*order)
    pairs = df.select(F.col(item).alias("item"), F.lead(item).over(w).alias("following"), (weight if weight is not None else F.lit(1)).alias("__w"))
    return pairs.where("following IS NOT NULL").groupBy("item", "following").agg(F.sum("__w").alias("n"))


def top_neighbours(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The k commonest followers of each item, with their share of those kept; ties by name."""
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("n"), "following"))).where(F.col("rank") <= k)
    return ranked.withColumn("weight", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("item")), 6))


def ngrams(df: DataFrame, key: list, order: list, item: str, n: int) -> DataFrame:
    """(gram, n): runs of n items, counted; a bounded window per row, not a list of the whole sequence."""
    w = Window.partitionBy(*key).orderBy(*order)
    parts = [F.col(item), *[F.lead(item, i).over(w) for i in range(1, n)]]
    grams = df.select(F.array(*parts).alias("g")).where(F.element_at("g", n).isNotNull())
    return grams.groupBy(F.array_join("g", ">").alias("gram")).agg(F.count("*").alias("n"))


def co_occurrence(df: DataFrame, key: list, item: str) -> DataFrame:
    """(item_a, item_b, n): keys that hold both items, each unordered pair once."""
    sets = df.select(*key, item).distinct()
    a, b = sets.select(*key, F.col(item).alias("item_a")), sets.select(*key, F.col(item).alias("item_b"))
    return a.join(b, key).where("item_a < item_b").groupBy("item_a", "item_b").agg(F.count("*").alias("n"))


def broken_links(df: DataFrame, key: list, order: list, link: Column, expected: Column) -> DataFrame:
    """Rows whose link does not equal the expected value computed on the row before."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__before", F.lag(expected).over(w)).where(F.col("__before").isNotNull() & ~link.eqNullSafe(F.col("__before"))).drop("__before")


def diminishing(df: DataFrame, axis: str, value: str) -> DataFrame:
    """Along an axis of few points: gain over the point before and gain by unit of axis."""
    w = Window.orderBy(axis)
    gain = F.col(value) - F.lag(value).over(w)
    return df.withColumn("gain", F.round(gain, 6)).withColumn("efficiency", F.round(gain / (F.col(axis) - F.lag(axis).over(w)), 6))
