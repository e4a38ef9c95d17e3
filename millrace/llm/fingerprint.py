"""Document fingerprints: one-permutation MinHash.

Every shingle is hashed once; its high bits choose one of `bins` bins, which
keeps the least of the rest. Empty bins are filled by optimal densification:
a hash of (bin, attempt), the same for all documents, names the bin to copy
from until one that was not empty is named. The low `bits` bits of each bin are
stored, packed; a likeness is the share of equal bins, corrected for the equal
low bits that chance gives.

Shingles are runs of five words, A-Z lower-cased; a text of fewer words is one
shingle, a text without words has an empty fingerprint, which is like (1)
another empty one and unlike (0) all others.

fingerprint_neighbours() also needs the next document in the order of ids. The
ids' quantiles (a bounded number) cut the ids into ranges; a range's first
document goes to the range before it too, and each range is read in order.
Defined cases: null text is empty; a null id comes first; rows that share an id
follow each other by text, repeated rows are each other's next; a table of one
row is its own next; very long texts are hashed alone; fingerprint() passes the
input's columns through unless one is named fingerprint, of
fingerprint_neighbours() only the id is carried; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrow import mix64, short_batches, sliced, text_shingles, utf8
from millrace.llm.common import table

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def densify(least: np.ndarray) -> np.ndarray:
    """Rows of bins with the empty ones filled; rows that are all empty stay so."""
    n, bins = least.shape
    full = least != _EMPTY
    some = full.sum(axis=1)
    out = least.copy()
    single = np.flatnonzero(some == 1)
    if len(single):
        out[single] = least[single].min(axis=1)[:, None]
    row, col = np.nonzero(~full & (some > 1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        source = (mix64(np.arange(attempt * bins, (attempt + 1) * bins, dtype=np.uint64)) % np.uint64(bins)).astype(np.int64)[col]
        hit = full[row, source]
        out[row[hit], col[hit]] = least[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    return out


def fingerprints(texts: list[bytes], bins: int = 512, bits: int = 4, width: int = 5) -> np.ndarray:
    """A row of low bits (uint8) for each text; 255 throughout where it has no words."""
    out = np.full((len(texts), bins), 255, dtype=np.uint8)
    shift = np.uint64(64 - int(bins - 1).bit_length())
    for lo, hi in sliced(texts):
        h, where = text_shingles(texts[lo:hi], width)
        least = np.full((hi - lo) * bins, _EMPTY, dtype=np.uint64)
        np.minimum.at(least, where * bins + (h >> shift).astype(np.int64), mix64(h) >> np.uint64(1))
        least = least.reshape(hi - lo, bins)
        some = (least != _EMPTY).any(axis=1)
        out[lo:hi][some] = (densify(least[some]) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return out


def packed(low: np.ndarray, bits: int = 4) -> list[str]:
    """The bins' low bits as text; empty for texts without words."""
    some = low[:, 0] != 255
    planes = ((low[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1).reshape(len(low), -1)
    return [base64.b64encode(np.packbits(p).tobytes()).decode() if s else "" for p, s in zip(planes, some, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, bits: int = 4) -> np.ndarray:
    """Of each row of a to that of b, between 0 and 1."""
    equal = (a == b).mean(axis=1)
    chance = 2.0**-bits
    out = np.clip((equal - chance) / (1 - chance), 0.0, 1.0)
    empty = (a[:, 0] == 255).astype(int) + (b[:, 0] == 255)
    return np.where(empty == 2, 1.0, np.where(empty == 1, 0.0, out))


def fingerprint(df: DataFrame, text_col: str = "text", bins: int = 512, bits: int = 4) -> DataFrame:
    """df with its texts' packed fingerprint."""
    names = [f"__c{i}" for i in range(len(df.columns))]
    keep = [(n, c) for n, c in zip(names, df.columns, strict=True) if c.lower() != "fingerprint"]
    carried = [n for n, _ in keep]
    rows = df.toDF(*names).select(*carried, F.coalesce(F.col(names[df.columns.index(text_col)]), F.lit("")).alias("__text"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in short_batches(whole, len(carried))):
            texts = utf8(batch.column(len(carried)))
            prints = [p for lo, hi in sliced(texts) for p in packed(fingerprints(texts[lo:hi], bins, bits), bits)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(prints, pa.string())], names=[*carried, "__f"])

    return rows.mapInArrow(run, kinds + "__f string").toDF(*[c for _, c in keep], "fingerprint")


def fingerprint_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = 512, bits: int = 4) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for an integer id.

    The edited text is the text with its last quarter replaced by as much of the
    next document's beginning.
    """
    spark = df.sparkSession
    lowest = -(2**63)
    rows = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("__at"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    ids = rows.select("__at")
    n, parts = ids.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(65_536, 8 * parts) if n else 1
    shares = json.dumps([i / ranges for i in range(1, ranges)])
    cuts = sorted({lowest, *(int(x) for x in ids.selectExpr(f"percentile_approx(__at, from_json('{shares}', 'array<double>'), 20000) AS q").head()[0])}) if ranges > 1 else [lowest]
    # A range goes from one cut, with it, to the next. It is found in two steps of about the root of their number.
    # Tables of ranges are one literal each (JSON that the optimizer folds), however many ranges there are.
    step = max(1, int(len(cuts) ** 0.5))
    literal = lambda xs, kind: F.from_json(F.lit(json.dumps(xs)), f"array<{kind}>")
    below = lambda xs: F.size(F.filter(xs, lambda e: e <= F.col("__at")))
    coarse = below(literal(cuts[::step], "bigint"))
    bucket = ((coarse - 1) * step + below(F.element_at(literal([cuts[i : i + step] for i in range(0, len(cuts), step)], "array<bigint>"), coarse)) - 1).cast("int")
    firsts = {r["b"]: r["m"] for r in ids.select(bucket.alias("b"), "__at").groupBy("b").agg(F.min("__at").alias("m")).collect()}  # one row a range
    order = sorted(firsts)
    # By range: its first document's id, and the range that holds the document before.
    first_id = F.element_at(literal([firsts.get(b, lowest) for b in range(len(cuts))], "bigint"), bucket + 1)
    previous = {b: order[i - 1] for i, b in enumerate(order)}
    extra = F.when(first_id == F.col("__at"), F.element_at(literal([previous.get(b, 0) for b in range(len(cuts))], "int"), bucket + 1))
    copies = F.when(extra.isNotNull(), F.array(F.struct(bucket.alias("b"), F.lit(0).alias("tail")), F.struct(extra.alias("b"), F.lit(1).alias("tail")))).otherwise(F.array(F.struct(bucket.alias("b"), F.lit(0).alias("tail"))))
    dealt = rows.withColumn("__x", F.explode(copies)).select("__id", "__at", "__text", F.col("__x.b").alias("__b"), F.col("__x.tail").alias("__tail"))
    dealt = dealt.repartition(parts, "__b").sortWithinPartitions("__b", "__tail", "__at", "__text")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one is yet to come

        def done(rows_: list, nexts: list) -> pa.RecordBatch:
            texts = [r[1] for r in rows_]
            edited = [t[: len(t) - len(t) // 4] + x[: len(t) // 4] for t, x in zip(texts, nexts, strict=True)]
            raw, raw_edited = [t.encode() for t in texts], [t.encode() for t in edited]
            own, changed = fingerprints(raw, bins, bits), fingerprints(raw_edited, bins, bits)
            follow = fingerprints([nexts[-1].encode()], bins, bits)
            after = np.concatenate([own[1:], follow])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows_], batch.column(0).type), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in raw_edited], pa.string()),
                    pa.array(packed(own, bits), pa.string()), pa.array(packed(changed, bits), pa.string()), pa.array(likeness(own, changed, bits), pa.float64()), pa.array(likeness(own, after, bits), pa.float64()),
                ],
                names=["__id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in (part for whole in batches for part in short_batches(whole, 2)):
            part, nexts, size = [], [], 0
            for i, t, b, tail in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if held is not None and held[2] == b and not held[3]:
                    part.append(held)
                    nexts.append(t)
                    size += len(t)
                if size > 1 << 20 or (held is not None and held[2] != b):
                    if part:
                        yield done(part, nexts)
                    part, nexts, size = [], [], 0
                if not (tail and held is not None and held[2] == b and held[3]):
                    held = (i, t, b, tail)
            if part:
                yield done(part, nexts)

    out = dealt.mapInArrow(run, f"__id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("__id", id_col)


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))
