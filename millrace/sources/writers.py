"""Sinks: JSON lines, CSV, partitioned tables, resumable appends, and their manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.rows import first_wins
from millrace.sources.readers import exists


def json_lines(df: DataFrame) -> DataFrame:
    """A line for each row, keys in order, nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    json_lines(df).write.text(path)


def head_sum(c: Column) -> Column:
    """An order-free digest of a group's values: the sum of the first 48 bits of their SHA-256, merged from partial sums."""
    return F.sum(F.conv(F.substring(F.sha2(c, 256), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string")


def digest(df: DataFrame, *keys: str) -> DataFrame:
    """A manifest row (or one for each key): rows, and an order-free digest of the rows' JSON lines."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.groupBy(*keys).agg(F.count("*").alias("row_count"), head_sum(line).alias("digest"))


def append_new(df: DataFrame, path: str, key: str, order: list | None = None) -> int:
    """Appends the rows whose key the table at path lacks; returns how many.

    Of rows with one key the first in `order` is written; without an order, the
    one with the least digest of all its columns.
    """
    spark = df.sparkSession
    new = first_wins(df, [key], order or [F.xxhash64(*[F.col(c) for c in sorted(df.columns)])])
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new = new.cache()
    n = new.count()
    if n:
        new.select(*df.columns).write.mode("append").parquet(path)
    new.unpersist()
    return n


def write_csv(df: DataFrame, path: str, order: list) -> None:
    """A CSV with header in a global order, as the part files' order; readers that need one file concatenate them."""
    df.orderBy(*order).write.options(header=True, quote='"', escape='"', lineSep="\n").csv(path)


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """A table in a folder for each value of keys; each key's rows are gathered first, large ones in several files."""
    df.hint("rebalance", *[F.col(k) for k in keys]).write.partitionBy(*keys).parquet(path)


def union_wide(frames: list[DataFrame]) -> DataFrame:
    """All rows, columns in name order, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, size, sha256) of files, read by the executors."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
