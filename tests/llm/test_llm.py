"""The training-data operators against brute force, round trips and held-out rows, and their defined cases."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from millrace.llm import bpe, chat, fingerprint, knn, line_dedup, mixing, ngram_join, token_counts, toxicity, wrapper  # noqa: E402
from millrace.llm import components as components_module  # noqa: E402
from millrace.llm.components import components  # noqa: E402

WORDS = [f"w{i}" for i in range(400)]
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that clash with outputs and with names used inside.
CLASH = ["n_tokens", "score", "size", "taken", "n_lines", "n_dropped", "component_id", "n_shingles", "key", "id", "__id", "pos", "copies"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def corpus(n=120, seed=1):
    """Documents with near and exact copies, shared lines, nulls, empty texts and one very long text."""
    r = random.Random(seed)
    line = " ".join(r.choices(WORDS, k=14))
    out = [None, "", "  \n\t ", "one two", "One TWO", "x " * 30_000]
    while len(out) < n:
        kind = r.random()
        if kind < 0.3 and len(out) > 12:
            words = (r.choice(out[6:]) or "").split(" ")
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(WORDS)
            out.append(" ".join(words))
        else:
            text = "\n".join(" ".join(r.choices(WORDS, k=r.randint(3, 40))) for _ in range(r.randint(1, 5)))
            out.append(text + "\n" + line if kind < 0.6 else text)
    return out


def frame(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)], DOC)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH]) if extra else df


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus(), extra=True)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_line_dedup_matches_brute_force(spark, docs):
    texts = corpus()
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    holders = defaultdict(set)
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    dropped = 0
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 5 or max(holders[key(x)]) == i]
        dropped += len(lines) - len(kept)
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["text"]) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert dropped > 10
    assert got[0]["pos"] == 7


def test_line_dedup_cases(spark, empty):
    assert line_dedup.line_dedup(empty).count() == 0
    long = "a" * 50
    rows = [(i, long) for i in range(5)] + [(None, long), (4, long + "\n" + long)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_dropped"]) for r in got) == [("0", 1), ("1", 1), ("2", 1), ("3", 1), ("4", 0), ("4", 0), ("None", 1)]


def test_mixing(spark, docs, empty):
    rows = mixing.mix_sources(docs).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or ""))
        assert r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert sum(taken.values()) <= sum(sizes.values())
    largest = max(r["size"] for r in rows)
    for s, t in target.items():
        assert t <= 3 * sizes[s] + 1e-6
        assert abs(taken[s] - t) <= largest
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs.repartition(3)).collect()}
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_caps_small_sources(spark):
    rows = [(i, "w " * 10, "big") for i in range(100)] + [(200 + i, "w " * 10, "alpha") for i in range(2)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    target = {r["source"]: r["target"] for r in got}
    assert target == {"alpha": 60.0, "big": 960.0}
    assert sum(r["taken"] for r in got if r["source"] == "alpha") == 60
    assert sum(r["taken"] for r in got) <= 1020


def test_bpe_is_the_library(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.load(path)
    r = random.Random(3)
    pool = [*"ab cdAB'stSİΣςé\n\t\x1c\x1f 中1²½_-$<|>ß😀\x00\x85ﬁ", "<|endoftext|>", "<|startoftext|>", "'ll", "ααΣ ", "é"]
    texts = ["".join(r.choices(pool, k=r.randint(0, 30))) for _ in range(600)] + ["a" * 3_000, ""]
    for text, (ids, tokens, n) in zip(texts, own.encode(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        flat = [int(x) for p in ids for x in p.split(" ")]
        assert (flat, n) == (want, len(want)), text
        assert " ".join(tokens) == own.decode(flat) == lib.decode(want, skip_special_tokens=False)
    for row in bpe.bpe_encode(docs, path).collect():
        assert row["ids"] == lib.encode(row["text"] or "", add_special_tokens=False).ids if "text" in row else True
    assert bpe.bpe_encode(empty, path).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 2), (7, 3), (100, 1)])
def test_token_counts_are_the_library(chunk, overlap):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own, r = Tokenizer.from_file(path), token_counts.Counter(path, chunk, overlap), random.Random(chunk)
    pool = [*"ab cdAB'stSé\n\t\x1c\x1f 中1_-$<|>😀\x85   ", "<|endoftext|>", "hello", "\n\n  "]
    for k in range(400):
        text = "".join(r.choices(pool, k=r.randint(0, 120))) + "a" * (k % 40 == 0) * 200
        assert own.count([text]) == [len(lib.encode(text, add_special_tokens=False).ids)], text


def test_token_counts_frame(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for row in token_counts.token_counts(docs, path).collect():
        text = row["text"] or ""
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len(text.encode()), n, n > 512)
    assert token_counts.token_counts(empty, path).count() == 0


def test_fingerprints_estimate_jaccard(spark, docs, empty):
    texts = corpus()
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_neighbours(docs).collect()}
    errors = []
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t), shingles(edited)
        want = len(a & b) / len(a | b) if a or b else 1.0
        errors.append(got[i]["near_edited"] - want)
    assert np.sqrt(np.mean(np.square(errors))) < 0.05
    by_text = defaultdict(set)
    for i, t in enumerate(texts):
        by_text[t or ""].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprint.fingerprint_neighbours(empty).count() == 0
    alone = fingerprint.fingerprint_neighbours(spark.createDataFrame([(3, "a b c d e f g h")], "doc_id bigint, text string")).collect()
    assert len(alone) == 1
    assert alone[0]["near_next"] == 1.0


def test_fingerprint_order_across_partitions(spark):
    r = random.Random(5)
    ids = r.sample(range(-10_000, 10_000), 500)
    rows = [(i, f"doc {i} " + " ".join(r.choices(WORDS, k=20))) for i in ids]
    text = dict(rows)
    order = sorted(ids)
    got = {x["doc_id"]: x for x in fingerprint.fingerprint_neighbours(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)).collect()}
    assert len(got) == 500
    for i, j in zip(order, [*order[1:], order[0]], strict=True):
        q = len(text[i]) // 4
        assert got[i]["edited_sha256"] == hashlib.sha256((text[i][: len(text[i]) - q] + text[j][:q]).encode()).hexdigest()


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_matches_brute_force(spark, seed):
    r = random.Random(seed)
    texts = corpus(60, seed)
    # A chain of copies, each a few words from the last, so that stars alone can't join it.
    words = r.choices(WORDS, k=200)
    for _ in range(25):
        for _ in range(3):
            words[r.randrange(len(words))] = r.choice(WORDS)
        texts.append(" ".join(words))
    # Texts made of the same few passages: all their shingles are shared, few of them link.
    passages = [" ".join(r.choices(WORDS, k=30)) for _ in range(8)]
    texts += [" ".join(r.sample(passages, r.randint(3, 7))) for _ in range(30)]
    want, sizes = brute_components(texts)
    got = {x["doc_id"]: x for x in ngram_join.ngram_join(frame(spark, texts, extra=True)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == want


def test_ngram_join_cases(spark, empty):
    assert ngram_join.ngram_join(empty).count() == 0
    rows = [(None, "a b c d e f"), (5, "A b c d e f"), (5, "A b c d e f"), (6, None), (7, "")]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == [("5", 2, "5"), ("5", 2, "5"), ("6", 0, "6"), ("7", 0, "7"), ("None", 2, "5")]


@pytest.mark.parametrize("one_task", [0, 200_000])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components_module, "ONE_TASK", one_task)
    r = random.Random(9)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(80)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for p in links if p[0] != p[1] for x in p}


def test_knn(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(900, 24)) * r.uniform(0.2, 3, (900, 1))
    x[300:420] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [1.0]), (2020, None), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").union(spark.createDataFrame([rows[7]], "vec_id bigint, embedding array<double>"))
    got = defaultdict(list)
    for row in knn.knn(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got[row["query_id"]].append((row["rank"], row["vec_id"], row["score"]))
    hits = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[300:420] = s[5]
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -s))[:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        hits += len(set(want.tolist()) & {m[1] for m in mine})
    assert hits / (20 * 45) >= 0.9
    assert knn.knn(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = knn.knn(df.where("vec_id < 4"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3]


def toxic_corpus(n, seed):
    r = random.Random(seed)
    bad = ["grimwort", "vilefang", "scornly"]
    out = []
    for i in range(n):
        words = r.choices(WORDS[:200], k=r.randint(20, 60))
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words[r.randrange(len(words))] = r.choice(bad) + r.choice(["", "er", "ing"])
        out.append((i, re.sub(r"\d", "x", " ".join(words)), int(toxic)))
    return out


def test_toxicity(spark, empty):
    rows = toxic_corpus(400, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    crf = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    fresh = toxic_corpus(200, 2)
    scored = {r["doc_id"]: r for r in toxicity.score_texts(spark.createDataFrame([(i, t) for i, t, _ in fresh], "doc_id bigint, text string"), crf).collect()}
    assert np.mean([scored[i]["predicted"] == y for i, _, y in fresh]) > 0.97
    for i, t, y in fresh:
        found = {t[s["start"] : s["start"] + s["length"]][:4] for s in scored[i]["spans"]}
        assert found <= {"grim", "vile", "scor"}
        assert not y or found
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!")], "doc_id bigint, text string")
    assert all(0 <= r["score"] < 0.5 for r in toxicity.score_texts(odd, crf).collect())
    assert toxicity.train(docs, labels.limit(0)) is None
    assert toxicity.score_texts(empty, None).count() == 0
    assert {r["score"] for r in toxicity.score_texts(odd, None).collect()} == {0.0}


def test_crf_marginals_are_exact():
    crf = toxicity.Crf({"=bad": 0, "=worse": 1})
    crf.weights, crf.bias, crf.start, crf.trans = np.array([2.0, 3.5]), -2.0, np.array([0.2, -0.5]), np.array([[0.7, -1.0], [-0.3, 0.9]])
    crf.ready()
    r = random.Random(2)
    for _ in range(50):
        words = r.choices(["ok", "fine", "so", "bad", "worse"], weights=[5, 5, 5, 1, 1], k=r.randint(1, 400))
        emit = [np.array([1.0, np.exp(crf.bias + sum(crf.weights[crf.index[f]] for f in toxicity.features(w) if f in crf.index))]) for w in words]
        fwd = [np.exp(crf.start) * emit[0]]
        for e in emit[1:]:
            nxt = (fwd[-1] @ np.exp(crf.trans)) * e
            fwd.append(nxt / nxt.sum())
        bwd = [np.ones(2)]
        for e in emit[:0:-1]:
            b = np.exp(crf.trans) @ (e * bwd[0])
            bwd.insert(0, b / b.sum())
        at, probs = crf.marginals(words)
        for i, p in zip(at, probs, strict=True):
            post = fwd[i] * bwd[i]
            assert abs(post[1] / post.sum() - p) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>x";</script></head><body><!-- c > d -->
<nav><ul><li><a href=/a>Home {n}</a></ul></nav><div class="ad">Buy {n}</div><div class="wrap"><div id="story"><h1>Title {n} &amp; more</h1><p>First {n}   para<b>graph<br><p>Second &lt;{n}&gt;
line<ul><li>one {n}<li>two</ul><div class="comments"><p>Reader {n} says</p></div></div></div><aside>Side {n}</aside><footer>&copy; site</footer></body></html>"""


def test_html_extract(spark):
    rows = [(i, "http://a.example/x", PAGE.replace("{n}", f"n{i} " + " ".join(random.Random(i).choices(WORDS, k=8)))) for i in range(12)]
    rows += [(50, None, None), (51, "http://b.example", ""), (52, "http://b.example", "just text"), (53, "::", "<p>unclosed <b>bold<p>next<!-- open"), (54, "http://b.example", "<article class='post'><header><h1>T</h1></header><p>x</article><article class='comment'><p>bad</article>")]
    got = {r["page_id"]: r for r in wrapper.html_extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert len(got) == len(rows)
    site = "<div class='site-header'>Logo</div><main><div class='entry-header'><h1>T</h1></div><div class='cookie-notice'>c</div><p>x<form><p>f</form><p>y</main>"
    assert wrapper.extract(site) == "T\nx\ny"
    for i in range(12):
        n = f"n{i} " + " ".join(random.Random(i).choices(WORDS, k=8))
        assert got[i]["text"] == f"Title {n} & more\nFirst {n} paragraph\nSecond <{n}> line\none {n}\ntwo"
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert (got[50]["text"], got[51]["text"], got[52]["text"], got[53]["text"], got[54]["text"]) == ("", "", "just text", "unclosed bold\nnext", "T\nx")
    assert wrapper.html_extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_simple_tree_matching():
    a = wrapper.skeleton(wrapper.parse("<div><p>a</p><ul><li>x</ul><p>b</p></div><div class=q></div>"))[0]
    b = wrapper.skeleton(wrapper.parse("<div><p>a</p><p>c</p></div><section></section><div class=q></div>"))[0]
    pairs = wrapper.match(a, b)
    assert pairs and all(a[i][0] == b[j][0] for i, j in pairs)
    assert len(pairs) == 5


def test_escape_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\l \\b \\\\n", "<|turn|>x\n<|end|>", "<s", "<<SYS>>", "a\nb", "", None, "<|a|><|b|>[INST][[INST]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert row["u"] == (row["t"] or "")
        assert not re.search(r"<\|\w+\|>|</?s>|\[/?INST\]|<</?SYS>>", row["e"])


def test_chat_paths(spark):
    nodes = [("t", "a", None, "user", "hi", 1.0), ("t", "b", "a", "assistant", "low", 1.0), ("t", "c", "a", "assistant", "high</s>", 2.0), ("t", "d", "c", "user", "x", 0.5), ("t", "e", "c", "user", "y", 0.5), ("u", "f", "gone", None, None, 0.0), ("v", "g", "h", "user", "loop", 1.0), ("v", "h", "g", "user", "loop", 1.0)]
    df = spark.createDataFrame(nodes, "tree string, node string, parent string, role string, text string, score double")
    got = {r["tree"]: r for r in chat.read_back(chat.chat_format(df)).collect()}
    assert set(got) == {"t", "u"}
    assert [(x["role"], x["text"]) for x in got["t"]["turns"]] == [("user", "hi"), ("assistant", "high</s>"), ("user", "x")]
    assert got["t"]["loss"] == "high</s>"
    assert [(x["role"], x["text"]) for x in got["u"]["turns"]] == [("", "")]
    assert chat.chat_format(df, all_branches=True).count() == 4
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", None), (None, 1, "assistant", "z")]
    chain = chat.reply_chain(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {r["tree"]: [(x["role"], x["text"]) for x in r["turns"]] for r in chat.read_back(chat.chat_format(chain)).collect()}
    assert got == {1: [("system", ""), ("user", "a"), ("user", "a")], None: [("assistant", "z")]}
    assert chat.chat_format(chain.limit(0)).count() == 0
    deep = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(150)], "conv_id bigint, turn bigint, role string, text string")
    (row,) = chat.read_back(chat.chat_format(chat.reply_chain(deep))).collect()
    assert [x["text"] for x in row["turns"]] == [f"m{i}" for i in range(150)]
