"""Toxicity: a linear-chain conditional random field over a text's words.

Only documents are labelled, so tokens get their training labels from them: a
word of a toxic document is toxic if one of its features (the word, or how it
begins) is found in toxic documents nearly only. The chain has two states; a
word's features and a bias weigh the toxic one, and transitions tie neighbours.
Forward-backward marginals of a document's suspect words give its score, by a
logistic function of their number and height, and the offending offsets.

Words without a weighted feature all have the same factor, so the chain between
two suspect words is a power of one 2 x 2 matrix; powers settle to a limit, and
the marginals are exact at the cost of the suspect words alone.

The model is fitted on the driver on a bounded sample, whose bounds are the
constants below: of the labelled documents that are there and have at most
TRAIN_CHARS code points, the TOXIC_ROWS and CLEAN_ROWS with the least hash of
their id. Class sizes are counted over all labelled documents and weigh the
sample. At most FEATURES features have a weight. Of n sequences of a class,
SEQUENCES or more, each (n // SEQUENCES)th is fitted, with that weight: fewer
than 2 * SEQUENCES, spread over all its documents. Every whole text is scored,
very long ones too, some megabytes of text at once.

Defined cases: null text is empty; a text without words is scored as one without
suspect words; without labelled documents of both classes every score is 0; a
label that is null, or neither 0 nor 1, is none; of labels that disagree the
toxic one counts; of rows that share an id the one of least text hash is trained
on, and all are scored; ties of the hash go to the smaller id; an empty table
gives an empty result; columns of the input pass through unless an output has
their name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrow import released, short_batches
from millrace.llm.common import cut, table

#: Bounds of the training sample: documents of each class, code points of one, words of a training sequence, features,
#: and sequences of a class from which only each second, third ... takes part.
TOXIC_ROWS, CLEAN_ROWS, TRAIN_CHARS, SEQUENCE, FEATURES, SEQUENCES = 1_500, 3_000, 50_000, 48, 4_000, 12_000
_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 5, 6, 7, 8)
_SETTLED = 256


def features(word: str) -> list[str]:
    """A word's features: itself and its beginnings."""
    w = word.lower()
    return ["=" + w, *(w[:n] for n in _PREFIXES if len(w) >= n)]


class Texts:
    """Training texts as numbers of their words, so that a word is held once."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.words: list[str] = []

    def add(self, text: str) -> np.ndarray:
        out = np.empty(0, np.int32) if not (found := _WORD.findall(text)) else np.fromiter((self.number.setdefault(w, len(self.number)) for w in found), np.int32, len(found))
        if len(self.number) > len(self.words):
            self.words += [w for w in dict.fromkeys(found) if self.number[w] >= len(self.words)]
        return out

    def of(self, numbers: np.ndarray) -> list[str]:
        words = self.words
        return [words[i] for i in numbers.tolist()]


def _select(toxic: list[np.ndarray], clean: list[np.ndarray], clean_weight: float, texts: Texts, least: int = 3, purity: float = 0.6) -> dict[str, float]:
    """Features that toxic documents have nearly alone, with their (smoothed) share of toxic documents. One kind of feature is held at a time."""
    found: list[tuple[float, str, float]] = []
    for kind in (0, *_PREFIXES):
        names: dict[str, int] = {}
        of = np.full(len(texts.words), -1, np.int32)
        for i, w in enumerate(texts.words):
            w = w.lower()
            if not kind or len(w) >= kind:
                of[i] = names.setdefault(w[:kind] if kind else "=" + w, len(names))
        counts = []
        for docs in (toxic, clean):
            n = np.zeros(len(names) + 1, np.int64)  # the last one is for words without the feature
            for numbers in docs:
                n[np.unique(of[numbers])] += 1
            counts.append(n[:-1])
        a, b = counts
        share = a / (a + clean_weight * b + 1.0)
        good = set(np.flatnonzero((a >= least) & (share >= purity)).tolist())
        found += [(-a[i] * share[i], f, float(share[i])) for f, i in names.items() if i in good]
    return {f: share for _, f, share in sorted(found)[:FEATURES]}


def _chains(docs: list[np.ndarray], toxic: bool, index: dict[str, int], pure: set[str], texts: Texts) -> tuple[list[list[list[int]]], list[list[int]]]:
    """Sequences of at most SEQUENCE words with a suspect word, and one without in every document: features' numbers, and labels."""
    seqs, labels = [], []
    none: list[int] = []
    known = {i: fs for i, w in enumerate(texts.words) if (fs := [index[f] for f in features(w) if f in index])}
    bad = {i for i in known if toxic and any(f in pure for f in features(texts.words[i]))}
    for numbers in docs:
        plain = True
        for lo in range(0, len(numbers), SEQUENCE):
            part = numbers[lo : lo + SEQUENCE].tolist()
            found = [known.get(i, none) for i in part]
            if any(found) or plain:
                plain = plain and any(found)
                seqs.append(found)
                labels.append([int(i in bad) for i in part])
    return seqs, labels


class Block:
    """Training sequences, longest first: a place's row holds those that reach it."""

    def __init__(self, seqs: list, labels: list, weight: np.ndarray):
        self.n, self.width = len(seqs), max(1, len(seqs[0]))
        size = np.array([len(s) for s in seqs])
        self.live = [int((size > t).sum()) for t in range(self.width)]
        self.spot = np.array([t * self.n + i for i, s in enumerate(seqs) for t, fs in enumerate(s) for _ in fs], dtype=np.int64)
        self.feat = np.array([f for s in seqs for fs in s for f in fs], dtype=np.int64)
        self.y = np.zeros((self.width, self.n))
        for i, l in enumerate(labels):
            self.y[: len(l), i] = l
        self.weight = weight
        self.mass = np.where(np.arange(self.width)[:, None] < size[None, :], weight[None, :], 0.0)
        y, pair = self.y, self.mass[1:]
        self.gold_t = np.array([(pair * ((y[:-1] == i) & (y[1:] == j))).sum() for i in (0, 1) for j in (0, 1)])
        self.gold_s = np.array([(self.mass[0] * (y[0] == i)).sum() for i in (0, 1)])

    def gradient(self, crf: Crf) -> np.ndarray:
        """Of the weighted log-likelihood by weights, bias, start and transitions. Of two states only ratios matter, so forward and backward are one number a word."""
        live, n, width = self.live, self.n, self.width
        score = crf.bias + np.bincount(self.spot, weights=crf.weights[self.feat], minlength=n * width).reshape(width, n)
        emit = np.exp(np.clip(score, -30, 30))
        m00, m01, m10, m11 = np.exp(crf.trans).ravel().tolist()
        fwd, bwd = np.ones((width, n)), np.ones((width, n))
        fwd[0] = np.exp(crf.start[1] - crf.start[0]) * emit[0]
        for t in range(1, width):
            f = fwd[t - 1, : live[t]]
            fwd[t, : live[t]] = emit[t, : live[t]] * (m01 + m11 * f) / (m00 + m10 * f)
        for t in range(width - 2, -1, -1):
            g = emit[t + 1, : live[t + 1]] * bwd[t + 1, : live[t + 1]]
            bwd[t, : live[t + 1]] = (m10 + m11 * g) / (m00 + m01 * g)
        post = fwd * bwd
        post /= 1.0 + post
        f, g = fwd[:-1], emit[1:] * bwd[1:]
        both = [np.full_like(f, m00), m01 * g, m10 * f, m11 * f * g]
        share = self.mass[1:] / sum(both)
        miss = self.mass * (self.y - post)
        toxic_start = float((self.weight * post[0]).sum())
        start = self.gold_s - np.array([self.weight.sum() - toxic_start, toxic_start])
        moves = self.gold_t - np.array([(share * x).sum() for x in both])
        return np.concatenate([np.bincount(self.feat, weights=miss.ravel()[self.spot], minlength=len(crf.weights)), [miss.sum()], start, moves])


class Crf:
    """start (2), trans (2 x 2), bias and weights of the toxic state, all as logarithms of factors."""

    def __init__(self, index: dict[str, int]):
        self.index = index
        self.weights = np.zeros(len(index))
        self.bias, self.start, self.trans = -3.0, np.zeros(2), np.array([[1.0, -1.0], [0.0, 0.0]])
        self.head = np.zeros(4)
        self.memo: dict[str, float] = {}

    def fit(self, seqs: list, labels: list, weight: np.ndarray, rounds: int = 120, rate: float = 0.25, ridge: float = 1e-3) -> None:
        """Gradient ascent (Adam) of the weighted mean log-likelihood, the gradient summed over blocks of sequences of like length."""
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        weight = weight / weight.sum()
        parts = [order[lo : lo + 2_048] for lo in range(0, len(order), 2_048)]
        blocks = [Block([seqs[i] for i in part], [labels[i] for i in part], weight[part]) for part in parts]
        k = len(self.weights)
        state = [np.zeros(k + 7), np.zeros(k + 7)]
        for step in range(1, rounds + 1):
            grad = sum(b.gradient(self) for b in blocks)
            grad[:k] -= ridge / k * self.weights
            state[0] = 0.9 * state[0] + 0.1 * grad
            state[1] = 0.99 * state[1] + 0.01 * grad * grad
            move_by = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
            self.weights = self.weights + move_by[:k]
            self.bias += float(move_by[k])
            self.start = self.start + move_by[k + 1 : k + 3]
            self.trans = self.trans + move_by[k + 3 :].reshape(2, 2)
        self.ready()

    def ready(self) -> None:
        """The powers of the plain word's matrix, each scaled to a sum of 1."""
        plain = np.exp(self.trans) * np.array([1.0, np.exp(self.bias)])[None, :]
        powers = [np.eye(2)]
        for _ in range(_SETTLED):
            nxt = powers[-1] @ plain
            powers.append(nxt / nxt.sum())
        self.powers = [tuple(p.ravel().tolist()) for p in powers]
        self.memo = {}

    def suspect(self, word: str) -> float | None:
        """A word's score for the toxic state; None for a plain word."""
        got = [self.weights[self.index[f]] for f in features(word) if f in self.index]
        return float(self.bias + sum(got)) if got else None

    def suspects(self, words: list[str]) -> list[int]:
        memo = self.memo
        if len(memo) > 200_000:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = self.suspect(w)
        return [i for i, w in enumerate(words) if memo[w] is not None]

    def marginals(self, words: list[str]) -> tuple[list[int], list[float]]:
        """Places of the suspect words, and each one's probability of the toxic state."""
        at = self.suspects(words)
        if not at:
            return [], []
        move = np.exp(self.trans)
        m00, m01, m10, m11 = move.ravel().tolist()
        s0, s1 = np.exp(self.start).tolist()
        plain = float(np.exp(self.bias))
        emit = [float(np.exp(min(30.0, max(-30.0, self.memo[words[i]])))) for i in at]
        fwd: list[tuple[float, float]] = []
        # a: what reaches a place before its own factor.
        for j, i in enumerate(at):
            if j == 0:
                if i == 0:
                    a0, a1 = s0, s1
                else:
                    p = self.powers[min(i - 1, _SETTLED)]
                    f0, f1 = s0, s1 * plain
                    f0, f1 = f0 * p[0] + f1 * p[2], f0 * p[1] + f1 * p[3]
                    a0, a1 = f0 * m00 + f1 * m10, f0 * m01 + f1 * m11
            else:
                p = self.powers[min(i - at[j - 1] - 1, _SETTLED)]
                f0, f1 = fwd[-1]
                f0, f1 = f0 * p[0] + f1 * p[2], f0 * p[1] + f1 * p[3]
                a0, a1 = f0 * m00 + f1 * m10, f0 * m01 + f1 * m11
            a1 *= emit[j]
            fwd.append((a0 / (a0 + a1), a1 / (a0 + a1)))
        out = [0.0] * len(at)
        p = self.powers[min(len(words) - 1 - at[-1], _SETTLED)]
        b0, b1 = p[0] + p[1], p[2] + p[3]
        for j in range(len(at) - 1, -1, -1):
            f0, f1 = fwd[j]
            out[j] = f1 * b1 / (f0 * b0 + f1 * b1)
            if j:
                b1 *= emit[j]
                b0, b1 = m00 * b0 + m01 * b1, m10 * b0 + m11 * b1
                p = self.powers[min(at[j] - at[j - 1] - 1, _SETTLED)]
                b0, b1 = p[0] * b0 + p[1] * b1, p[2] * b0 + p[3] * b1
                b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
        return at, out

    @staticmethod
    def summary(n_words: int, probs: list[float]) -> list[float]:
        top = sorted(probs, reverse=True)[:2]
        total = sum(probs)
        return [1.0, np.log1p(total), top[1] if len(top) > 1 else 0.0, 100.0 * total / (n_words + 20.0)]

    def fit_head(self, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> None:
        """Weighted logistic regression by Newton steps."""
        self.head = np.zeros(rows.shape[1])
        weight = weight / weight.mean()
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(rows @ self.head, -30, 30)))
            grad = rows.T @ (weight * (y - p)) - ridge * len(y) * self.head
            hess = (rows * (weight * p * (1 - p))[:, None]).T @ rows + ridge * len(y) * np.eye(rows.shape[1])
            self.head = self.head + np.linalg.solve(hess, grad)

    def score(self, words: list[str]) -> tuple[float, list[int], list[float]]:
        at, probs = self.marginals(words)
        z = float(np.dot(self.head, self.summary(len(words), probs)))
        return 1 / (1 + float(np.exp(-min(30.0, max(-30.0, z))))), at, probs


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Crf | None:
    """A model from labels (id, label 0 or 1) of docs; None without documents of both classes."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).where("__id IS NOT NULL AND __y IN (0, 1)").groupBy("__id").agg(F.max("__y").cast("int").alias("__y"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("__id"), F.when(F.char_length(text) <= TRAIN_CHARS, F.xxhash64(text)).alias("__h"))
    # Labelled documents that are there, without their texts: counted by class, then a bounded number chosen.
    there = cut(slim.join(known, "__id").groupBy("__id", "__y").agg(F.min("__h").alias("__h")))
    sizes = {r["__y"]: r["count"] for r in there.groupBy("__y").count().collect()}
    if len(sizes) < 2:
        return None
    pick = lambda y, n: there.where((F.col("__y") == y) & F.col("__h").isNotNull()).orderBy(F.xxhash64("__id"), "__id").limit(n)
    chosen = F.broadcast(pick(1, TOXIC_ROWS).unionByName(pick(0, CLEAN_ROWS)))  # at most TOXIC_ROWS + CLEAN_ROWS ids
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("__t")).withColumn("__h", F.xxhash64("__t")).join(chosen, ["__id", "__h"]).dropDuplicates(["__id"]).select("__id", "__y", "__t").collect()
    rows.sort(key=lambda r: (r["__y"], str(r["__id"])))
    texts = Texts()
    toxic, clean = ([texts.add(r["__t"]) for r in rows if r["__y"] == y] for y in (1, 0))
    del rows
    if not toxic or not clean:
        return None
    per_clean = (sizes[0] / len(clean)) / (sizes[1] / len(toxic))
    share = _select(toxic, clean, per_clean, texts)
    if not share:
        return None
    crf = Crf({f: i for i, f in enumerate(share)})
    pure = {f for f, p in share.items() if p >= 0.75}
    a, la = _chains(toxic, True, crf.index, pure, texts)
    b, lb = _chains(clean, False, crf.index, pure, texts)
    i, j = (max(1, len(x) // SEQUENCES) for x in (a, b))
    crf.fit(a[::i] + b[::j], la[::i] + lb[::j], np.r_[np.full(len(a[::i]), float(i)), np.full(len(b[::j]), per_clean * j)])
    table_ = [crf.summary(len(x), crf.marginals(texts.of(x))[1]) for x in (*toxic, *clean)]
    crf.fit_head(np.array(table_), np.r_[np.ones(len(toxic)), np.zeros(len(clean))], np.r_[np.ones(len(toxic)), np.full(len(clean), per_clean)])
    crf.memo = {}
    return crf


def score_texts(df: DataFrame, crf: Crf | None, text_col: str = "text", spans: bool = True, threshold: float = 0.5) -> DataFrame:
    """df with score, predicted and, if asked for, spans: offset (code points), length and probability of offending words."""
    mine = ["score", "predicted", *(["spans"] if spans else [])]
    names = [f"__c{i}" for i in range(len(df.columns))]
    keep = [(n, c) for n, c in zip(names, df.columns, strict=True) if c.lower() not in mine]
    carried = [n for n, _ in keep]
    rows = df.toDF(*names).select(*carried, F.coalesce(F.col(names[df.columns.index(text_col)]), F.lit("")).alias("__text"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in short_batches(whole, len(carried))):
            scores, marked = [], []
            for text in batch.column(len(carried)).to_pylist():
                words = _WORD.findall(text)
                s, at, probs = crf.score(words) if crf else (0.0, [], [])
                scores.append(s)
                if spans:
                    hot = {i: p for i, p in zip(at, probs, strict=True) if p >= 0.5}
                    marked.append([{"start": m.start(), "length": len(m.group()), "probability": hot[i]} for i, m in enumerate(_WORD.finditer(text)) if i in hot] if hot else [])
            out = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), *([pa.array(marked, span)] if spans else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *out], names=[*carried, *(f"__o{i}" for i in range(len(out)))])

    more = "__o0 double, __o1 int" + (", __o2 array<struct<start: int, length: int, probability: double>>" if spans else "")
    return rows.mapInArrow(released(run), kinds + more).toDF(*[c for _, c in keep], *mine)


def held_out(ids: Column) -> Column:
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Crf | None:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return train(docs, labels.where(~held_out(F.col("doc_id"))))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, trained(spark, sf_dir, docs))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")
