"""The pipeline's stages against brute force, and the queries' columns, on a small fixture in files."""

from __future__ import annotations

import hashlib
import os
import random
from collections import defaultdict

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from millrace.llm import queries, toxicity  # noqa: E402
from tests.llm.test_llm import DOC, FOLD, WORD, WORDS, brute_components  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels with toxic rows, near copies, a common line and a hot source."""
    r = random.Random(11)
    line = " ".join(["the"] * 3 + r.choices(WORDS[:50], k=12))
    rows, labels = [], []
    for i in range(160):
        words = [w.replace("w", "ab") + "x" for w in r.choices(WORDS[:300], k=r.randint(20, 60))]
        toxic = i % 5 == 0
        for _ in range(4 * toxic):
            words[r.randrange(len(words))] = r.choice(["vilefang", "scornly", "grimwort"])
        text = " ".join(words)
        if i % 7 == 3:
            text = text + "\n" + line
        if i > 20 and i % 9 == 1:
            text = rows[i - 10][1] + " tail"
        rows.append((i, text, "en", "src0" if i % 3 == 0 else f"src{i % 6}", len(text)))
        labels.append((i, 1, int(toxic and "vilefang" in text + "scornly" + "grimwort")))
    rows += [(900, None, None, None, None), (901, "", "en", "src1", 0)]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_pipeline_matches_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    crf = toxicity.trained(spark, folder, docs)
    kept = {r["doc_id"]: r for r in docs.collect() if crf.score(toxicity._WORD.findall(r["text"] or ""))[0] < 0.5}
    assert 100 < len(kept) < 150
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    holders = defaultdict(set)
    for i, r in kept.items():
        for line in (r["text"] or "").split("\n"):
            holders[key(line)].add(i)
    text = {i: "\n".join(x for x in (r["text"] or "").split("\n") if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == i) for i, r in kept.items()}
    order = sorted(kept)
    roots, _ = brute_components([text[i] for i in order])
    left = [i for k, i in enumerate(order) if roots[k] == k]
    assert len(left) < len(order)
    size = {i: len(WORD.findall(text[i])) for i in left}
    total = defaultdict(int)
    for i in left:
        total[kept[i]["source"]] += size[i]
    names = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    cap, budget = set(), sum(total.values())
    while True:
        rest = budget - sum(3 * total[s] for s in cap)
        free = sum(weight[s] for s in names if s not in cap)
        over = {s for s in names if s not in cap and rest * weight[s] / free > 3 * total[s]}
        if not over:
            break
        cap |= over
    target = {s: 3.0 * total[s] if s in cap else rest * weight[s] / free for s in names}
    queue = []
    for s in names:
        at = 0
        mine = sorted((i for i in left if kept[i]["source"] == s), key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest())
        for i in mine:
            at += size[i]
            queue += [((turn * total[s] + at) / target[s], names.index(s), turn * total[s] + at, i) for turn in range(3) if size[i] and target[s]]
    want, run = defaultdict(int), 0
    for *_, i in sorted(queue):
        run += size[i]
        if run > budget:
            break
        want[i] += 1
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r["doc_id"]] += 1
        assert r["text"] == text[r["doc_id"]]
        assert r["ids"] == lib.encode(r["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(r["ids"])
        assert r["decoded"] == lib.decode(r["ids"], skip_special_tokens=False)
    assert dict(got) == dict(want)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_document_queries_have_a_row_for_each_document(spark, folder):
    for n in ("op1_toxicity", "op2_line_dedup", "op4_bpe", "op5_fingerprint", "op7_token_counts", "op8_ngram_join", "op9_mix_sources"):
        assert queries.QUERIES[n](spark, folder).select("doc_id").distinct().count() == 162, n
