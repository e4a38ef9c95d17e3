"""All queries of the library by name, with their DuckDB SQL.

A query is a function of the driver tables; @query registers it under its name
with the SQL that gives the same rows, if SQL can.
"""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The driver tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function of Tables as a query."""

    def wrap(f: Callable[[Tables], DataFrame]):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return wrap


def load() -> None:
    for module in ("corpus", "reports", "sequences", "retrieval", "scalars", "files", "programs", "curriculum", "extras", "gates"):
        importlib.import_module(f"millrace.plans.{module}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus build: validated rows, first of each text, split, mixture shares."""
    return QUERIES["corpus_build"](spark, sf_dir)
