"""Grouping sets by DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouping_sets(df: DataFrame, groups: list[list[str]], **measures: Column) -> DataFrame:
    """The measures by each set of keys; keys that are not in a set are null."""
    keys = list(dict.fromkeys(k for g in groups for k in g))
    grouped = df.groupingSets([[F.col(k) for k in g] for g in groups], *[F.col(k) for k in keys])
    return grouped.agg(*[v.alias(k) for k, v in measures.items()]).select(*keys, *measures)
