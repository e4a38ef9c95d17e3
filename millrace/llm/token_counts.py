"""Token counts by overlap resynchronisation.

A huge text (of more than chunk_chars code points) is encoded by the library as
overlapping chunks, and the chunks' tokens are counted up to a place where both
neighbours have a token boundary that is proven to be one of the whole text.

Proof, for a byte-level BPE with the GPT-2 splitter and no normaliser: a match
of the splitter is white space, or at most one white space and then letters
only, numbers only or other characters only, or an apostrophe with letters. So
no match goes on from a character that is no white space to white space, and
none from an ASCII letter, number or other character to an ASCII one of another
of these kinds, but for an apostrophe before a letter. At such a place each
match ends whatever follows, and the next begins whatever came before (the one
look-ahead is past white space). Tokens don't cross matches. An added token can
hold such a place, so the place is as far from the end of the left chunk and
from the begin of the right one as the longest added token is: both chunks then
have it whole and neither has a boundary there. The ends of a spliced piece are
both such places (or the text's ends), so its tokens are the whole text's.

If the neighbours have no such place in common, their overlap doubles, until at
last one chunk holds both. A file that the proof does not fit (another
splitter, a normaliser, added tokens that strip or want whole words, offsets that
are trimmed) and a .model file are counted over whole texts.

Texts that are not huge are one chunk, encoded piece by piece from one proven
place (before white space) to the next; a worker keeps the counts of pieces it
has met in a bounded table.

Defined cases: null text is empty and has no tokens; repeated rows each have
their count; very long texts are cut as above, without white space too; columns
of the input pass through unless an output has their name; an empty table gives
an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrow import short_batches
from millrace.llm.common import table

#: A piece begins with white space or the text's start and ends before the next white space.
#: Python's \s has four control characters more than the splitter's; they are not cut at.
_WHITE = r"\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_PIECE = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_PLAIN = re.compile(r"\s*\S+|\s+")
_ODD = re.compile("[\x1c-\x1f]")


class Chunk:
    """A part of a text from lo to hi: its proven token boundaries (places in the text, in order) with the tokens up to each, and all its tokens."""

    __slots__ = ("hi", "lo", "places", "tokens", "total")

    def __init__(self, lo: int, hi: int, places: np.ndarray, tokens: np.ndarray, total: int):
        self.lo, self.hi, self.places, self.tokens, self.total = lo, hi, places, tokens, total


def _kinds() -> np.ndarray:
    """Of each ASCII character: 0 white space, 1 letter, 2 number, 3 other; 4 is for all that are not ASCII."""
    out = np.full(129, 3, dtype=np.int8)
    for c in range(128):
        if chr(c) in " \t\n\x0b\x0c\r":
            out[c] = 0
        elif chr(c).isalpha():
            out[c] = 1
        elif chr(c).isdigit():
            out[c] = 2
    out[0x1C:0x20] = 4
    out[128] = 4
    return out


_KINDS = _kinds()
_WHITE_CODES = np.array(sorted({ord(c) for c in re.findall(f"[{_WHITE}\x1c-\x1f]", "".join(map(chr, range(0x3001))))}), dtype=np.uint32)


def proven(text: str, places: np.ndarray) -> np.ndarray:
    """Which places (each between two characters of text) are ends of a splitter's match in every context."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    before, after = codes[places - 1], codes[places]
    kb, ka = _KINDS[np.minimum(before, 128)], _KINDS[np.minimum(after, 128)]
    to_white = (ka == 0) & ~np.isin(before, _WHITE_CODES)
    changes = (kb != ka) & (kb > 0) & (kb < 4) & (ka > 0) & (ka < 4) & ~((before == ord("'")) & (ka == 1))
    return to_white | changes


class Counter:
    """Counts the tokens of texts for one vocabulary file."""

    def __init__(self, path: str, chunk_chars: int, overlap_chars: int, memo: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.chunk, self.most = chunk_chars, memo
        self.memo: dict[str, int] = {}
        self.widened = 0
        if path.endswith(".model"):
            import sentencepiece

            whole = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count: Callable[[list[str]], list[int]] = lambda texts: [len(x) for x in whole.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_file(path)
            self.lib.no_truncation()
            self.lib.no_padding()
            file = json.loads(self.lib.to_str())
            added = file.get("added_tokens") or []
            # What an added token can hide of a place's surroundings, on each side.
            self.margin = max((len(t["content"]) for t in added), default=0)
            self.overlap = max(overlap_chars, 4 * self.margin + 1)
            splitter = file.get("pre_tokenizer") or {}
            fits = (
                (file.get("model") or {}).get("type") == "BPE" and splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
                and file.get("normalizer") is None and file.get("post_processor") is None
                and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
            )
            self.count = self.count_chunks if fits else self.count_whole

    def count_whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str]:
        return (_PIECE if _ODD.search(text) else _PLAIN).findall(text)

    def learn(self, pieces: set[str]) -> None:
        new = list(pieces)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.memo.update(zip(part, self.count_whole(part), strict=True))

    def encode(self, text: str, lo: int, hi: int) -> Chunk:
        """text[lo:hi] by the library, with its offsets."""
        part = text[lo:hi]
        offsets = np.array(self.lib.encode(part, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
        # Tokens that share a character have overlapping offsets, and no boundary between them.
        ends = np.flatnonzero(offsets[:-1, 1] == offsets[1:, 0])
        places = offsets[ends, 1]
        ends, places = ends[(places > 0) & (places < len(part))], places[(places > 0) & (places < len(part))]
        good = proven(part, places)
        return Chunk(lo, hi, places[good] + lo, ends[good] + 1, len(offsets))

    def common(self, left: Chunk, right: Chunk, at: int) -> tuple[int, int, int] | None:
        """A place after `at` that is proven in both, with the tokens of each up to it."""
        low = at if right.lo == at else right.lo + self.margin
        both, i, j = np.intersect1d(left.places, right.places, assume_unique=False, return_indices=True)
        fine = np.flatnonzero((both > at) & (both >= low) & (both <= left.hi - self.margin))
        if not len(fine):
            return None
        k = fine[len(fine) // 2]
        return int(both[k]), int(left.tokens[i[k]]), int(right.tokens[j[k]])

    def spliced(self, text: str) -> int:
        """Tokens of a huge text. at: where the last splice is; before: the left chunk's tokens up to there."""
        size, n, at, before, edge, step = len(text), 0, 0, 0, self.chunk, self.chunk
        left = self.encode(text, 0, min(size, edge + self.overlap))
        while left.hi < size:
            width, hi = self.overlap, min(size, edge + step + self.overlap)
            right = self.encode(text, max(at, edge - width), hi)
            while (found := self.common(left, right, at)) is None and right.lo > at:
                # The overlap doubles until it reaches a place that the left chunk has; without one, both are one chunk.
                usable = left.places[(left.places > at) & (left.places <= left.hi - self.margin)]
                width, self.widened = 2 * width, self.widened + 1
                while len(usable) and max(at, edge - width) > max(at, usable[-1] - self.margin):
                    width *= 2
                right = self.encode(text, max(at, edge - width) if len(usable) else at, hi)
            if found is not None:
                n, at, before, left, step = n + found[1] - before, found[0], found[2], right, self.chunk
            else:
                # As much again is added to a text without such places, so that all its chunks together stay in proportion to it.
                left, before, step = right, 0, right.hi - at
            edge = left.hi - self.overlap
        return n + left.total - before

    def count_chunks(self, texts: list[str]) -> list[int]:
        if len(self.memo) > self.most:
            self.memo.clear()
        memo, cut = self.memo, [self.pieces(t) if len(t) <= self.chunk else None for t in texts]
        if new := {p for parts in cut if parts for p in parts if p not in memo}:
            self.learn(new)
        return [sum([memo[p] for p in parts]) if parts is not None else self.spliced(t) for t, parts in zip(texts, cut, strict=True)]


_loaded: dict[tuple, Counter] = {}


def load(*key) -> Counter:
    if key not in _loaded:
        _loaded[key] = Counter(*key)
    return _loaded[key]


def token_counts(df: DataFrame, path: str, text_col: str = "text", limit: int = 512, chunk_chars: int = 16_384, overlap_chars: int = 512) -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and over_limit."""
    names = [f"__c{i}" for i in range(len(df.columns))]
    mine = ["n_bytes", "n_tokens", "over_limit"]
    keep = [(n, c) for n, c in zip(names, df.columns, strict=True) if c.lower() not in mine]
    carried = [n for n, _ in keep]
    rows = df.toDF(*names).select(*carried, F.coalesce(F.col(names[df.columns.index(text_col)]), F.lit("")).alias("__text"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path, chunk_chars, overlap_chars)
        for batch in (part for whole in batches for part in short_batches(whole, len(carried))):
            texts, counts, part, size = batch.column(len(carried)), [], [], 0
            for t in texts.to_pylist():
                part.append(t)
                size += len(t)
                if size > 1 << 19:
                    counts += counter.count(part)
                    part, size = [], 0
            counts += counter.count(part) if part else []
            sizes = [len(t) for t in texts.cast(pa.binary()).to_pylist()]
            out = [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *out], names=[*carried, *(f"__o{i}" for i in range(3))])

    return rows.mapInArrow(run, kinds + "__o0 bigint, __o1 bigint, __o2 boolean").toDF(*[c for _, c in keep], *mine)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
