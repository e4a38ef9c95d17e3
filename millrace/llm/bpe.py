"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round finds the rank of
every adjacent pair that is new by binary search over the sorted keys of the
vocabulary's merges, then merges the lowest-ranked pair of every word at once;
finished words leave the array. A worker keeps the encodings of words it has
met (a bounded table that is emptied when full), so a round only sees new ones.

Supported files: `tokenizers` JSON with a BPE model, no decoder, and the
normaliser and splitter of word_bpe_49k.json (NFC, white space, lower case;
contractions, letters, single digits, other runs; byte symbols; word ends).
Added tokens are found in the raw text first, as that library does. Any other
file is an error, and so is one of that kind with parts that encode otherwise.

Defined cases: null text is empty and has no tokens; repeated rows each have
their tokens; very long texts are encoded alone; rows pass through with their
columns, but for those with an output's name; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrow import released
from millrace.llm.common import table

#: The splitter's pattern, and white space as the normaliser's \s has it.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE = regex.compile(r"[\t-\r \x85\p{Z}]+")
_ODD = regex.compile("[\x1c-\x1f]")
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte, as byte-level vocabularies have it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


def unsupported(spec: dict) -> list[str]:
    """The parts of a vocabulary file that encode otherwise than this module does."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model = spec.get("model") or {}
    fine = {
        "normalizer": [x.get("type") for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1].get("pattern") == {"Regex": "\\s+"} and steps[1].get("content") == " ",
        "pre_tokenizer": [x.get("type") for x in cuts] == ["Split", "ByteLevel"] and cuts[0].get("pattern") == {"Regex": _SPLIT} and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex"),
        "model": model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")),
        "decoder": spec.get("decoder") is None,
        "added_tokens": not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or not t["special"] for t in spec.get("added_tokens") or []),
    }
    return [k for k, ok in fine.items() if not ok]


class Bpe:
    """A vocabulary and its merges as arrays."""

    def __init__(self, path: str, memo: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if odd := unsupported(spec):
            raise ValueError(f"{path}: not supported: {', '.join(odd)}")
        model = spec["model"]
        vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.size = max(vocab.values()) + 1
        self.token = {i: t for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.added.items()}
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([vocab[s + self.end] for s in symbols], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        self.split = regex.compile(_SPLIT)
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in self.added) + ")") if self.added else None
        self.memo, self.most = {}, memo

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Each pair's rank among the merges, _NONE for pairs that never merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each (non-empty) word."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids = self.first[data]
        ends = np.cumsum(lengths)
        ids[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list = [None] * len(words)
        rank = np.full(len(ids), _NONE, dtype=np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.ranks(ids[inner], ids[inner + 1])
        while len(ids):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, start)
            count = np.diff(np.r_[start, len(ids)])
            over = best == _NONE
            if over.any():
                for w, s, c in zip(word[start[over]].tolist(), start[over].tolist(), count[over].tolist(), strict=True):
                    done[w] = ids[s : s + c]
                if over.all():
                    break
                keep = np.repeat(~over, count)
                ids, word, rank = ids[keep], word[keep], rank[keep]
                best, count = best[~over], count[~over]
            hit = rank == np.repeat(best, count)
            at = np.flatnonzero(hit)
            # Of overlapping pairs (a a a) the left ones merge: every second hit of a run.
            run = np.cumsum(np.r_[True, np.diff(at) != 1])
            within = np.arange(len(at)) - np.searchsorted(run, run, side="left")
            at = at[within % 2 == 0]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            ids, word, rank = ids[keep], word[keep], rank[keep]
            stale = np.concatenate([moved, moved[moved > 0] - 1])
            last = len(ids) - 1
            rank[stale] = _NONE
            stale = stale[stale < last]
            stale = stale[word[stale] == word[stale + 1]]
            rank[stale] = self.ranks(ids[stale], ids[stale + 1])
        return done

    def normalise(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower() would make the last sigma of a word another letter
            text = text.replace("Σ", "σ")
        return text.lower()

    def pieces(self, text: str) -> list[str]:
        """Runs between white space; what the splitter makes of a run does not depend on its neighbours."""
        return [x for x in _SPACE.split(text) if x] if _ODD.search(text) else text.split()  # split() also cuts at four controls

    def learn(self, pieces: list[str]) -> None:
        """Puts pieces into the memo: (ids and tokens as text, number of ids)."""
        parts, owner = [], []
        for k, piece in enumerate(pieces):
            found = [piece] if piece.isalpha() else self.split.findall(piece)
            parts += found
            owner += [k] * len(found)
        new = list(dict.fromkeys(parts))
        merged = {}
        lo = 0
        while lo < len(new):
            hi, size = lo, 0
            while hi < len(new) and (size < 400_000 or hi == lo):
                size += len(new[hi])
                hi += 1
            data = [x.encode() for x in new[lo:hi]]
            for x, ids in zip(new[lo:hi], self.merge(data), strict=True):
                merged[x] = ids.tolist()
            lo = hi
        ids_of: list = [[] for _ in pieces]
        for k, part in zip(owner, parts, strict=True):
            ids_of[k] += merged[part]
        for piece, ids in zip(pieces, ids_of, strict=True):
            self.memo[piece] = (" ".join(map(str, ids)), " ".join([self.token[i] for i in ids]), len(ids))

    def encode(self, texts: list[str]) -> Iterator[tuple[list[str], list[str], int]]:
        """For each text its pieces' ids and tokens as texts, and the number of ids."""
        cut = []
        for text in texts:
            spans = self.special.split(text) if self.special and any(t in text for t in self.added) else [text]
            parts: list = []
            for j, span in enumerate(spans):
                if j % 2:
                    parts.append(self.added[span])
                elif span:
                    parts += self.pieces(self.normalise(span))
            cut.append(parts)
        if len(self.memo) > self.most:
            self.memo.clear()
        memo = self.memo
        new = {p for parts in cut for p in parts if p not in memo}
        if new:
            known = [p for p in new if isinstance(p, int)]
            for p in known:
                memo[p] = (str(p), self.token[p], 1)
            self.learn(sorted(new.difference(known)) if known else list(new))
        for parts in cut:
            got = [memo[p] for p in parts]
            yield [g[0] for g in got if g[2]], [g[1] for g in got if g[2]], sum([g[2] for g in got])

    def decode(self, ids: list[int]) -> str:
        """As a tokenizer without decoder does: known tokens joined by spaces."""
        return " ".join(self.token[i] for i in ids if i in self.token)


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def slices(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes of text, one row at least, so that what is made of them stays small."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", what: str = "ids") -> DataFrame:
    """df with n_tokens and, for what = "ids", ids (array) and decoded (text); for "digest", ids_sha256 and decoded_sha256."""
    names = [f"__c{i}" for i in range(len(df.columns))]
    mine = {"ids": ["n_tokens", "ids", "decoded"], "digest": ["n_tokens", "ids_sha256", "decoded_sha256"]}[what]
    keep = [(n, c) for n, c in zip(names, df.columns, strict=True) if c.lower() not in mine]
    text_name = names[df.columns.index(text_col)]
    base = df.toDF(*names)
    carried = [n for n, _ in keep]
    rows = base.select(*carried, F.coalesce(F.col(text_name), F.lit("")).alias("__text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    second = "__ids array<int>, __dec string" if what == "ids" else "__ids string, __dec string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for lo, hi in slices(batch.column(len(carried))):
                part = batch.slice(lo, hi - lo)
                n_tokens, ids, decoded = [], [], []
                for i, t, n in bpe.encode(part.column(len(carried)).to_pylist()):
                    n_tokens.append(n)
                    if what == "ids":
                        ids.append(np.array(" ".join(i).split(), dtype=np.int32))
                        decoded.append(" ".join(t))
                    else:
                        ids.append(hashlib.sha256(" ".join(i).encode()).hexdigest())
                        decoded.append(hashlib.sha256(" ".join(t).encode()).hexdigest())
                if what == "ids":
                    ends = np.concatenate([[0], np.cumsum(n_tokens)]).astype(np.int32)
                    column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                else:
                    column = pa.array(ids, pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carried)], pa.array(n_tokens, pa.int64()), column, pa.array(decoded, pa.string())], names=[*carried, "__n", "__ids", "__dec"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            load(path).memo.clear()  # up to 150,000 words that would stay in the worker

    done = rows.mapInArrow(released(task), ", ".join(x for x in (kinds, "__n bigint", second) if x))
    return done.toDF(*[c for _, c in keep], *mine)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"), what="digest").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
