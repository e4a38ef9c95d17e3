"""Defined cases: disagreeing labels, shared ids, clashing names, null trees, texts without white space."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from millrace.llm import bpe, chat, knn, line_dedup, mixing, ngram_join, token_counts, toxicity  # noqa: E402
from tests.llm.test_llm import DOC, brute_components, corpus, toxic_corpus  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


# Token counts.


def test_texts_without_white_space_and_of_a_megabyte():
    lib, own, r = Tokenizer.from_file(PATH), token_counts.Counter(PATH, 16_384, 512), random.Random(4)
    for text in ("a" * 100_000, "".join(r.choices("abc.de1'", k=300_000)), "\u65e5\u672c" * 20_000, " " * 50_000, "x " * 500_000, "".join(r.choices("abcdefghij", k=200_000))):
        assert own.count([text]) == [len(lib.encode(text, add_special_tokens=False).ids)]


def test_overlaps_widen():
    """The only place that both chunks can share is far from the cut, or there is none."""
    lib, own = Tokenizer.from_file(PATH), token_counts.Counter(PATH, 1_000, 60)
    for text in ("a" * 700 + " " + "b" * 2_000 + " c" * 900, "a" * 5_000):
        before = own.widened
        assert own.spliced(text) == len(lib.encode(text, add_special_tokens=False).ids)
        assert own.widened > before


def test_added_tokens_at_every_cut():
    lib = Tokenizer.from_file(PATH)
    for lead in range(40):
        text = "ab." * 20 + "x" * lead + "<|endoftext|>" * 6 + ".cd" * 40
        own = token_counts.Counter(PATH, 50, 30)
        assert own.spliced(text) == len(lib.encode(text, add_special_tokens=False).ids)


def test_other_files_are_counted_whole(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "lower.json").write_text(json.dumps(spec), encoding="utf-8")
    own, lib = token_counts.Counter(str(tmp_path / "lower.json"), 20, 5), Tokenizer.from_file(str(tmp_path / "lower.json"))
    assert own.count(["Some TEXT " * 30]) == [len(lib.encode("Some TEXT " * 30, add_special_tokens=False).ids)]
    assert own.count == own.count_whole


def test_bpe_refuses_other_files(tmp_path):
    with pytest.raises(ValueError, match="normalizer"):
        bpe.Bpe(PATH)


# Toxicity.


def test_labels_of_absent_documents_are_not_sampled(spark):
    rows = toxic_corpus(200, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.range(10_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, (F.col("id") % 4 == 0).cast("int")).otherwise((F.col("id") % 2).cast("int")).alias("toxic"))
    crf = toxicity.train(docs, labels)
    assert crf is not None and any(f.startswith("=grim") or f.startswith("grim") for f in crf.index)


def test_reruns_agree_and_disagreeing_labels_count_as_toxic(spark):
    rows = toxic_corpus(160, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, "another text"), (None, "x"), (1, None)], "doc_id bigint, text string")
    pairs = [(i, y) for i, _, y in rows] + [(i, 0) for i, _, y in rows if y] + [(7, None), (8, 5), (None, 1)]
    one, two = (toxicity.train(docs.repartition(n), spark.createDataFrame(pairs, "doc_id bigint, toxic int").repartition(n)) for n in (1, 3))
    assert one.index == two.index and abs(one.weights - two.weights).max() < 1e-9 and abs(one.head - two.head).max() < 1e-9
    plain = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"))
    assert plain.index == one.index


def test_spans_of_the_query_and_clashing_columns(spark):
    rows = toxic_corpus(160, 6)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    crf = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"))
    long = "calm words here " * 60_000 + "grimwort vilefang scornly " * 3
    got = toxicity.score_texts(spark.createDataFrame([(1, long, 9, 9)], "doc_id bigint, text string, score int, spans int"), crf)
    assert got.columns == ["doc_id", "text", "score", "predicted", "spans"]
    spans = got.head()["spans"]
    assert spans and all(s["start"] >= 16 * 60_000 for s in spans)


# Near copies, lines, mixing.


def test_rows_that_share_ids_lose_no_text(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (5, a), (5, b), (7, b + " tail"), (8, b), (8, b), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC).withColumn("key", F.lit(1))
    kept = sorted((r["doc_id"], r["text"] or "") for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept == [(3, a), (5, b), (9, ""), (9, "")]
    again = spark.createDataFrame([(8, b, "en", "s", 0)] * 3 + [(9, b + " x", "en", "s", 0)], DOC)
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, again, "").collect()] == [8]


def test_one_of_each_against_brute_force(spark):
    texts = corpus(100, 8)
    got = sorted(r["doc_id"] for r in ngram_join.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect())
    roots, _ = brute_components(texts)
    assert got == [i for i in range(len(texts)) if roots[i] == i]


def test_join_of_text_ids(spark):
    b = " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([("None", b), (None, b + " x"), ("a\tb", "")], "key string, text string")
    got = ngram_join.ngram_join(df, "key").collect()
    assert {r["key"] for r in got} == {"None", None, "a\tb"}
    assert {r["component_id"] for r in got} == {"None", "a\tb"}


def test_empty_tables_and_clashing_columns_in_every_stage(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(corpus(30, 2))], DOC)
    for c in ("score", "key", "size", "n_lines", "copies", "component", "text_hash", "__h", "ids"):
        docs = docs.withColumn(c, F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == corpus_pipeline.COLUMNS


def test_a_common_line_is_joined_without_broadcast_too(spark, monkeypatch):
    line = "a line that very many documents of the table hold as it is"
    docs = spark.createDataFrame([(i, f"own {i}\n{line}") for i in range(40)], "doc_id bigint, text string")
    want = sorted(line_dedup.line_dedup(docs).collect())
    monkeypatch.setattr(line_dedup, "FEW", -1)
    assert sorted(line_dedup.line_dedup(docs).collect()) == want
    assert sum(r["n_dropped"] for r in want) == 39


def test_mixing_of_shared_ids(spark):
    rows = [(i // 3, " ".join(["w"] * (1 + i % 5)) + f" {i % 2}", f"s{i % 2}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    one = sorted(map(tuple, mixing.mix_sources(df).collect()))
    assert one == sorted(map(tuple, mixing.mix_sources(df.repartition(5)).collect()))
    assert len(one) == 60


# Neighbours, conversations.


def test_neighbours_with_a_clashing_id(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "rank bigint, embedding array<double>")
    assert knn.knn(df, F.col("rank") < 2, 3, "rank").columns == ["query_id", "rank", "candidate_id", "score"]


def test_the_null_tree_is_not_the_tree_of_that_name(spark):
    rows = [(None, 1, "user", "a"), (None, 2, "assistant", "c"), ("null", 1, "user", "b")]
    nodes = chat.reply_chain(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    got = {r["tree"]: [t["text"] for t in r["turns"]] for r in chat.read_back(chat.chat_format(nodes)).collect()}
    assert got == {None: ["a", "c"], "null": ["b"]}
