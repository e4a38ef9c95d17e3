"""Operators on rows: validation codes, first-wins dedupe, caps, interleaves, splits, samples.

Orders are explicit: "input order" is always a column, and "shuffle" is the
order of a digest, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def error_code(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule broken by the row; null if none is."""
    out = None
    for name, broken in rules:
        out = F.when(broken, F.lit(name)) if out is None else out.when(broken, F.lit(name))
    return out


def failures(*rules: tuple[str, Column]) -> Column:
    """The names of all rules broken by the row, in order."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def first_wins(df: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key in the given order (dropDuplicates keeps any)."""
    return top_per_group(df, key, order, 1)


def top_per_group(df: DataFrame, key: list, order: list, n: int | Column) -> DataFrame:
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where(F.col("__rank") <= n).drop("__rank")


def capped(df: DataFrame, key: str, order: list, caps: dict[str, int], default: int = 0) -> DataFrame:
    """Top rows of each key, as many as caps says."""
    pairs = [x for k, v in sorted(caps.items()) for x in (F.lit(k), F.lit(v))]
    limit = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(key)), F.lit(default))
    return top_per_group(df, [key], order, limit)


def interleaved(df: DataFrame, key: str, order: list, limit: int) -> DataFrame:
    """One row of each key in turn, keys in order, with its place, up to limit."""
    turn = df.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("turn") <= limit)
    first = turn.orderBy("turn", F.col(key).asc_nulls_last()).limit(limit)
    return first.withColumn("place", F.row_number().over(Window.orderBy("turn", F.col(key).asc_nulls_last())))


def share_capped(df: DataFrame, is_capped: Column, order: list, most: float) -> DataFrame:
    """Rows of one kind cut so that they are at most a share of the result; the others stay.

    The capped rows' ranks are needed only up to the allowed number, so a
    top-n of that size replaces a rank over all of them.
    """
    allowed = int(df.where(~is_capped).count() * most / (1 - most))
    return df.where(~is_capped).unionByName(df.where(is_capped).orderBy(*order).limit(allowed))


def split_by_hash(unit: Column, shares: dict[str, float]) -> Column:
    """The name of the share that a number in [0, 1] falls in."""
    out, edge, names = None, 0.0, list(shares)
    for name in names[:-1]:
        edge += shares[name]
        out = F.when(unit < edge, F.lit(name)) if out is None else out.when(unit < edge, F.lit(name))
    return out.otherwise(F.lit(names[-1])) if out is not None else F.lit(names[-1])


def held_out_values(df: DataFrame, key: str, share: float, tail: bool = True) -> DataFrame:
    """The last (or first) share of the key's distinct values in order; at least one from the head.

    One row a value: n is counted first, so no rank runs over all of df.
    """
    values = df.select(key).distinct()
    n = values.count()
    k = round(n * share) if tail else max(1, int(n * share))
    return values.orderBy(F.col(key).desc() if tail else F.col(key).asc()).limit(k)


def weighted_repeat(df: DataFrame, weight: float, unit: Column) -> DataFrame:
    """Each row floor(weight) times, and once more where its unit number is below the rest."""
    whole = int(weight)
    copies = F.lit(whole) + (unit < (weight - whole)).cast("int")
    return df.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
