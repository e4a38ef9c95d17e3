"""Sources: files by suffix, strict or lenient, into DataFrames.

Paths go through Spark's readers only, so any store that Spark reads will do.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The keys under which an envelope object may hold its rows.
ENVELOPE = ("examples", "records", "items", "problems", "rows", "evaluations", "data")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, path: str, candidates: Iterable[str] = ()) -> str:
    """The first of path and candidates that exists; an error that names all if none does."""
    tried = [path, *candidates]
    for p in tried:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"none of these exists: {', '.join(tried)}")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object a line; blank lines are skipped; a bad line or a line that is no object fails the job with its text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = F.from_json("value", kind, {"mode": "FAILFAST"})
    is_object = F.btrim("value").startswith("{")
    checked = F.when(is_object, parsed).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.left("value", F.lit(200)))))
    return lines.select(checked.alias("r")).select("r.*")


def read_closed_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As read_jsonl, with `unknown`: the fields of each object that the schema lacks."""
    kind = T.StructType.fromDDL(schema)
    known = F.array(*[F.lit(n) for n in kind.names])
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", kind).alias("r"), F.array_except(F.json_object_keys("value"), known).alias("unknown")).select("r.*", "unknown")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A whole file as one JSON value; a list gives a row for each element."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_envelope(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a list, or of the list under the first envelope key an object has, or the object itself as one row."""
    kind = T.StructType.fromDDL(schema)
    whole = spark.read.option("wholetext", True).text(path)
    rows = T.ArrayType(kind)
    is_list = F.btrim("value").startswith("[")
    under = F.coalesce(*[F.from_json(F.get_json_object("value", f"$.{k}"), rows) for k in ENVELOPE])
    found = F.when(is_list, F.from_json("value", rows)).otherwise(F.coalesce(under, F.array(F.from_json("value", kind))))
    return whole.select(F.explode(found).alias("r")).select("r.*")


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """read_jsonl, or no rows if the path does not exist."""
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_csv(spark: SparkSession, path: str, required: Iterable[str], sep: str = ",") -> DataFrame:
    """A CSV with a header; quotes double, fields may hold line feeds. Missing columns raise; empty required values fail the job."""
    df = spark.read.options(header=True, multiLine=True, quote='"', escape='"', sep=sep).csv(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    for c in required:
        df = df.withColumn(c, F.when(F.trim(c) != "", F.col(c)).otherwise(F.raise_error(F.lit(f"empty {c}"))))
    return df


def read_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """By suffix: jsonl, json, csv, tsv, parquet."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    names = T.StructType.fromDDL(schema).names
    if suffix == "jsonl":
        return read_jsonl(spark, path, schema)
    if suffix == "json":
        return read_envelope(spark, path, schema)
    if suffix in ("csv", "tsv"):
        return read_csv(spark, path, (), "\t" if suffix == "tsv" else ",").select(*[F.col(n).cast(T.StructType.fromDDL(schema)[n].dataType) for n in names])
    if suffix == "parquet":
        return spark.read.parquet(path).select(*names)
    raise ValueError(f"unknown kind of file: {path}")


def selected(df: DataFrame, key: str, *, ids: list | None = None, start: int = 0, end: int | None = None, seed: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows by ids, then by place in key order, then in seeded order, then the first ones; in that order."""
    if ids is not None:
        df = df.where(F.col(key).isin(ids))
    if start or end is not None:
        head = df.orderBy(key).limit(end) if end is not None else df.orderBy(key)
        df = head.offset(start)
    if seed is not None:
        df = df.orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), key)
    return df.limit(limit) if limit is not None else df


def kind_of(df: DataFrame, kinds: dict[str, set[str]]) -> str:
    """The first kind all whose columns df has; "unknown" if none."""
    have = set(df.columns)
    return next((k for k, need in kinds.items() if need <= have), "unknown")
