"""Positions in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """df with `position` (from 0) in the order of a numeric key: rows are numbered inside ranges, ranges by the counts before.

    The ranges are the key's quantiles; rows with equal keys share a range.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.selectExpr(f"percentile_approx(`{key}`, array({', '.join(str(i / parts) for i in range(1, parts))}), 10000) AS q").head()[0] if parts > 1 else None
    edges = F.array(*[F.lit(x) for x in sorted(set(cuts or []))]) if cuts else F.array().cast("array<double>")
    at = df.withColumn("__part", F.size(F.filter(edges, lambda e: e < F.col(key))))
    before = at.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    local = at.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(key)))
    return local.join(F.broadcast(before), "__part").withColumn("position", F.col("__before") + F.col("__row") - 1).drop("__part", "__before", "__row")


def positions_by(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """positions() for an order of several columns of any type: the ranges' edges are taken from a sample of fixed size by hash."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("__key", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    kind = keyed.schema["__key"].dataType
    sample = sorted_sample(keyed, 20 * parts)[20::20]
    edges = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(e, kind.fields, strict=True)]) for e in sample]
    at = keyed.withColumn("__part", F.size(F.filter(F.array(*edges), lambda e: e < F.col("__key"))) if edges else F.lit(0))
    before = at.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    local = at.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy("__key")))
    return local.join(F.broadcast(before), "__part").withColumn("position", F.col("__before") + F.col("__row") - 1).drop("__part", "__before", "__row", "__key")


def sorted_sample(keyed: DataFrame, n: int) -> list:
    """n keys with the least hashes, in order."""
    few = keyed.select("__key").orderBy(F.xxhash64("__key"), "__key").limit(n)
    return [r["__key"] for r in few.select(F.sort_array(F.collect_list("__key")).alias("k")).select(F.explode("k").alias("__key")).collect()]


def numeric_first(c: Column) -> list[Column]:
    """The order of ids: those of digits only by number, of any length, before the rest as text; nulls last."""
    value = F.trim(c)
    digits = F.coalesce(value.rlike("^[0-9]+$"), F.lit(False))
    number = F.regexp_replace(value, "^0+", "")
    return [value.isNull(), ~digits, F.when(digits, F.length(number)).otherwise(0), F.when(digits, number), value, c]
