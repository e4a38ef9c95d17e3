"""What the operators of this folder share: tables, checkpoints (cut), names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.lineage import cut

__all__ = ["LOWER", "SPACE", "UPPER", "WORD", "cut", "hash128", "lower_ascii", "table", "with_outputs"]

#: The white space of the contracts: space, tab, LF, VT, FF, CR.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def hash128(c: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds."""
    return [F.xxhash64(c), F.xxhash64(F.lit(0x5EED), c)]


def with_outputs(df: DataFrame, **outputs: Column) -> DataFrame:
    """df's columns, those that clash with an output's name replaced."""
    low = {k.lower() for k in outputs}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in low], *[v.alias(k) for k, v in outputs.items()])
