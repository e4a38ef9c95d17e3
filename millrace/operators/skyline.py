"""The Pareto skyline of two measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def skyline(df: DataFrame, more: str, less: str) -> DataFrame:
    """Rows that no other row beats: none has at least as much of one and at most as much of the other, one strictly.

    The least `less` of each value of `more` stands for all its rows; a running
    minimum over those (one row a distinct value, from the largest down) decides.
    """
    best = df.groupBy(more).agg(F.min(less).alias("__least"))
    above = F.min("__least").over(Window.orderBy(F.desc(more)).rowsBetween(Window.unboundedPreceding, -1))
    kept = best.withColumn("__above", above).where(F.col("__above").isNull() | (F.col("__least") < F.col("__above"))).drop("__above")
    return df.join(kept.withColumnRenamed(more, "__more"), (F.col(more) == F.col("__more")) & (F.col(less) == F.col("__least"))).drop("__more", "__least")
