"""Queries of sources and sinks: tables written to the shared folder in a format and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators.lineage import shared_folder
from millrace.plans.registry import query
from millrace.sources import readers, writers
from millrace.streaming import streams


def folder(t, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


_PART = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"
_SCHEMA = "p_partkey bigint, p_name string, p_size int, p_retailprice double"


def _part(t):
    return t.part.select("p_partkey", "p_name", "p_size", "p_retailprice")


@query("src01_jsonl", _PART)
def _(t):
    path = folder(t, "part") + ".jsonl"
    writers.write_jsonl(_part(t), path)
    return readers.read_jsonl(t.spark, path, _SCHEMA)


@query("src04_closed_jsonl", "SELECT p_partkey, p_name, len(['p_retailprice', 'p_size']) AS unknown FROM part")
def _(t):
    path = folder(t, "part") + ".jsonl"
    writers.write_jsonl(_part(t), path)
    return readers.read_closed_jsonl(t.spark, path, "p_partkey bigint, p_name string").select("p_partkey", "p_name", F.size("unknown").cast("long").alias("unknown"))


@query("src05_csv", _PART)
def _(t):
    path = folder(t, "part") + ".csv"
    writers.write_csv(_part(t), path, ["p_partkey"])
    return readers.read_any(t.spark, path, _SCHEMA)


@query("src06_csv_quoted", "SELECT item_id, sha256(text) AS h FROM benchmark")
def _(t):
    path = folder(t, "bench") + ".csv"
    t.benchmark.write.options(header=True, quote='"', escape='"').csv(path)
    return readers.read_csv(t.spark, path, ["item_id", "text"]).select(F.col("item_id").cast("long").alias("item_id"), F.sha2("text", 256).alias("h"))


@query("src07_parquet", _PART)
def _(t):
    path = folder(t, "part") + ".parquet"
    _part(t).write.parquet(path)
    return readers.read_any(t.spark, path, _SCHEMA)


@query("src08_selection", "SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 300 OFFSET 100) ORDER BY sha256('s' || doc_id::VARCHAR), doc_id LIMIT 20")
def _(t):
    return readers.selected(t.documents.select("doc_id"), "doc_id", start=100, end=400, seed="s", limit=20)


@query("src09_envelope", "SELECT r_regionkey, r_name FROM region")
def _(t):
    path = folder(t, "region") + ".json"
    rows = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("records")))
    t.region.agg(rows.alias("value")).coalesce(1).write.text(path)
    return readers.read_any(t.spark, path, "r_regionkey int, r_name string")


@query("src03_optional", "SELECT 0::BIGINT AS n")
def _(t):
    return readers.read_optional(t.spark, folder(t, "none"), _SCHEMA).agg(F.count("*").alias("n"))


@query("src12_kind", "SELECT 'lines' AS kind")
def _(t):
    kind = readers.kind_of(t.lineitem, {"docs": {"doc_id", "text"}, "lines": {"l_orderkey", "l_linenumber"}})
    return t.spark.range(1).select(F.lit(kind).alias("kind"))


@query("snk04_resumable_append", "SELECT count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents")
def _(t):
    path = folder(t, "append")
    docs = t.documents.select("doc_id", "lang")
    writers.append_new(docs.where("lang = 'en'"), path, "doc_id")
    writers.append_new(docs, path, "doc_id")
    return t.spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("snk06_wide_union", "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region, NULL::DOUBLE AS bal FROM nation UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def _(t):
    a = t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return writers.union_wide([a, t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))])


@query("snk08_partitioned", "SELECT lang, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY lang")
def _(t):
    path = folder(t, "bylang")
    writers.write_partitioned(t.documents.select("doc_id", "lang"), path, "lang")
    return t.spark.read.parquet(path).where("lang = 'de'").groupBy("lang").agg(F.count("*").alias("n"))


@query("man01_table_digest")
def _(t):
    return writers.digest(t.documents, "lang")


@query("stm01_stream_append", "SELECT count(*) AS n, sum(event_id)::BIGINT AS ids FROM events")
def _(t):
    path = folder(t, "stream")
    t.events.repartition(4).write.parquet(f"{path}/in")
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    streams.append_stream(stream, f"{path}/out", f"{path}/cp").awaitTermination()
    return t.spark.read.parquet(f"{path}/out").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("stm02_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY 1, 2")
def _(t):
    return streams.windowed_counts(t.events)
