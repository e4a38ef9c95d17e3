"""The best threshold of a grid in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_threshold(df: DataFrame, p: Column, y: Column, steps: int) -> DataFrame:
    """(threshold, acc): of the thresholds 1/steps .. (steps-1)/steps, the first of the best accuracy.

    Rows are counted by how many thresholds they reach; each threshold's hits are
    sums over those counts, so the grid is never multiplied with the rows.
    """
    reached = sum(((p >= k / steps).cast("int") for k in range(1, steps)), F.lit(0))
    n = df.select(reached.alias("k"), y.cast("int").alias("y")).groupBy("k").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    grid = df.sparkSession.range(1, steps).select(F.col("id").cast("int").alias("t"))
    # A row is predicted positive by threshold t if it reaches t of them.
    hits = grid.crossJoin(F.broadcast(n)).groupBy("t").agg(F.sum(F.when(F.col("k") >= F.col("t"), F.col("pos")).otherwise(F.col("n") - F.col("pos"))).alias("hit"), F.sum("n").alias("n"))
    acc = F.round(F.col("hit") / F.col("n"), 6)
    best = hits.withColumn("r", F.row_number().over(Window.orderBy(F.desc(acc), "t"))).where("r = 1")
    return best.select((F.col("t") / steps).alias("threshold"), acc.alias("acc"))
