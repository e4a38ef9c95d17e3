"""A corpus pipeline: drop toxic documents and common lines, keep one of each
group of near copies, mix the sources to their weights, encode.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
run() writes what a stage returns as Parquet to the folder that all executors
share and reads it again as the next one's docs.

Defined cases: null texts are empty; without labels of both classes no document
is toxic; rows that share a doc_id are one document to the line dedup and
separate texts to the other stages; repeated rows are near copies; ties go to
the least doc_id (near copies) or the largest (lines); very long texts pass
every stage whole; a missing column, or columns beside those of documents, are
not carried; empty tables give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from millrace.llm.common import table
from millrace.operators.lineage import remove, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labels that are not held out, finds toxic go."""
    scored = toxicity.score_texts(docs, toxicity.trained(spark, sf_dir, docs), spans=False)
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of five documents or more stay in the last one only."""
    done = line_dedup.line_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return done.select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row stays, that of the least doc_id; rows that share a doc_id are told apart by their texts."""
    return ngram_join.one_of_each(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix_sources(docs).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids and decoded text."""
    import public_tokenizers

    return bpe.bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json")).select(*COLUMNS, "n_tokens", "ids", "decoded")


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("n-gram join", drop_near_copies), ("mixing", mix), ("bpe", encode)]
#: No SQL: the model and the tokenizer can't be written in it. tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote goes when the next one has read it."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
