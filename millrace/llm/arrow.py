"""Arrow batches as flat numpy arrays: words, shingles and their hashes.

A word's hash is sum(T[byte] * R**i) mod 2**64 over its bytes, from a prefix
sum over the whole batch, so no word becomes a Python object. T is a table of
pseudo-random numbers that gives A-Z the numbers of a-z.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
_R = 0x9E3779B97F4A7C15 | 1
#: Bytes of text worked on at once: the flat arrays take some 60 bytes for each.
SLICE_BYTES = 1 << 20


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, giving what Arrow keeps for later back to the system at its end: workers outlive tasks and stages."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (xor-shift and multiply rounds)."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_table() -> np.ndarray:
    t = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))
    t[65:91] = t[97:123]
    return t


_T = _byte_table()
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_R_INV = pow(_R, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) mod 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_POW = _powers(_R, 1 << 16)
_INV = _powers(_R_INV, 1 << 16)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if n > len(_POW):
        size = 1 << (n - 1).bit_length()
        _POW, _INV = _powers(_R, size), _powers(_R_INV, size)
    return _POW, _INV


def words(blob: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word of the texts that begin at starts in blob (bytes)."""
    n = len(blob)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_IS_SPACE[blob]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = starts[(starts > 0) & (starts < n)]
    first[edges] = inside[edges]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pow_, inv = _grown(n)
    with np.errstate(over="ignore"):
        terms = np.where(inside, _T[blob] * pow_[:n], np.uint64(0))
        sums = np.add.reduceat(terms, begin)
        hashes = mix64(sums * inv[begin])
    return hashes, np.searchsorted(starts, begin, side="right") - 1


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of width words; texts with fewer words give one run of all."""
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.bincount(text, minlength=n_texts)
    coef = mix64(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    m = len(hashes) - width + 1
    with np.errstate(over="ignore"):
        if m > 0:
            acc = hashes[:m] * coef[0]
            for i in range(1, width):
                acc = acc + hashes[i : i + m] * coef[i]
            whole = text[:m] == text[width - 1 :]
            out, where = mix64(acc[whole]), text[:m][whole]
        else:
            out, where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            ends = np.cumsum(count)
            pick = np.zeros(n_texts, dtype=bool)
            pick[short] = True
            kept = pick[text]
            spot = np.arange(len(text)) - (ends - count)[text]
            part = hashes[kept] * coef[spot[kept]] + count[text[kept]].astype(np.uint64)
            sums = np.zeros(n_texts, dtype=np.uint64)
            np.add.at(sums, text[kept], part)
            out = np.concatenate([out, mix64(sums[short])])
            where = np.concatenate([where, short])
            order = np.argsort(where, kind="stable")
            out, where = out[order], where[order]
    return out, where


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One blob of bytes and each text's start in it."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum(lengths) - lengths


def sliced(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes, one text at least."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if texts:
        yield lo, len(texts)


def text_shingles(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each shingle, in text order."""
    blob, starts = joined(texts)
    # Of texts that begin at the same byte (empty ones), words belong to the last.
    return shingles(*words(blob, starts), len(texts), width)


def short_batches(batch: pa.RecordBatch, column: int, most: int = 4 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in parts whose texts in one column have about `most` bytes, one row at least."""
    kind = batch.column(column)
    sizes = np.fromiter((0 if n is None else n for n in pc.binary_length(kind).to_pylist()), dtype=np.int64, count=batch.num_rows)
    ends, lo, size = np.cumsum(sizes), 0, 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, size + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo, size = hi, int(ends[hi - 1])


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
