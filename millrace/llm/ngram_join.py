"""N-gram Jaccard join by a token-group matrix; components of its links.

Texts are sets of shingles (runs of five words, A-Z lower-cased, as 52-bit
hashes). Two texts link when their sets' Jaccard similarity is `threshold` or
more. No step emits the pairs of a group, and the result is exact:

1. Texts with equal sets (128-bit digest) are one node.
2. A text can only link if threshold of its shingles are in some other set.
   Shingles travel in packed blocks (4 bytes each), a block sends each shingle
   once, and the answers are counts; most texts end here.
3. The others are grouped by their least shingle under a permutation, and each
   is compared with its group's leaders: stars that hold nearly all near copies.
4. The stars' components are cut into groups of similar texts; each group stores
   the union of its shingles. A group whose union shares too few shingles with
   other components to reach the bound of its smallest text stays closed.
5. Texts of open groups are grouped anew; groups that share a shingle in their
   texts' prefixes of rarest shingles are a candidate pair, and one whose unions
   reach the overlap bound opens: a product of two 0-1 matrices, texts by
   shingles, counts the common shingles of all its texts at once.
6. All links found make the components.

Exact means exact up to hashes: shingles are told apart by 52 bits and equal
sets found by 128. Two different shingles of a pair of texts with a million
shingles in all meet with a chance of about 1 in 9,000, and only a pair within
one shingle of the threshold would change.

Defined cases: null or empty text and text without words have an empty set and
link with nothing; a text of fewer words than five has one shingle of all its
words; a very long text is one set, cut by shingle when it travels; rows that
share an id are separate texts, repeated rows are one node; a component's id is
its least id, null if all are null; other columns are not carried; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrow import mix64, released, sliced, text_shingles
from millrace.llm.common import cut, table
from millrace.llm.components import components

_BITS = 52
_TEXTS = 1 << (64 - _BITS)
#: Parameters of work, not of the result: shingles in a bucket, bytes and texts of a block, texts in a group, texts that meet leaders
#: in one place, rows broadcast; leaders of a group, links that a text keeps, shingles in a group, pairs of groups in a task, bytes of groups broadcast.
BUCKET_TOKENS, BLOCK_BYTES, BLOCK_TEXTS, GROUP_TEXTS, SALT_ROWS, SMALL_ROWS = 2_000_000, 4 << 20, 60_000, 256, 256, 50_000
LEADERS, LINKS, GROUP_TOKENS, PAIRS, SMALL_BYTES = 32, 4, 100_000, 8, 12_000_000


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of texts: their range, and their distinct shingles in order, with text numbers within the slice."""
    for lo, hi in sliced(texts):
        for a in range(lo, hi, _TEXTS):
            b = min(hi, a + _TEXTS)
            h, where = text_shingles(texts[a:b], width)
            key = np.sort((where.astype(np.uint64) << np.uint64(_BITS)) | (h >> np.uint64(64 - _BITS)))
            if len(key):
                key = key[np.r_[True, key[1:] != key[:-1]]]
            yield a, b, key & np.uint64((1 << _BITS) - 1), (key >> np.uint64(_BITS)).astype(np.int64)


def digests(token: np.ndarray, where: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two order-free 64-bit digests of each set."""
    size = np.bincount(where, minlength=n)
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        start = (np.cumsum(size) - size)[full]
        with np.errstate(over="ignore"):
            one[full] = np.add.reduceat(mix64(token + np.uint64(0x51ED270B)), start)
            two[full] = np.add.reduceat(mix64(token ^ np.uint64(0xA5A5A5A5F00DF00D)), start)
    return size, one, two


def _key(one: np.ndarray, two: np.ndarray) -> list[str]:
    return [f"{a:016x}{b:016x}" for a, b in zip(one.tolist(), two.tolist(), strict=True)]


_WIRE = pa.schema([("bucket", pa.int32()), ("block", pa.string()), ("self", pa.bool_()), ("idx", pa.binary()), ("sig", pa.binary()), ("cnt", pa.binary()), ("tok", pa.binary()), ("seen", pa.binary()), ("keys", pa.list_(pa.string()))])
_WIRE_DDL = "bucket int, block string, self boolean, idx binary, sig binary, cnt binary, tok binary, seen binary, keys array<string>"


def _wire(block: str, keys: list[str], sig: np.ndarray, size: np.ndarray, token: np.ndarray, where: np.ndarray, buckets: int) -> pa.RecordBatch:
    """What a block of sets sends: a row for each bucket, and one for itself.

    keys, sig (64-bit group digests) and size: of each set. A shingle that two
    sets of different groups hold is known to be shared; its holders count it
    at once, and one copy goes out without a holder.
    """
    order = np.argsort(token, kind="stable")
    t, w = token[order], where[order]
    start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
    run = np.diff(np.r_[start, len(t)])
    g = sig[w]
    mixed = (np.minimum.reduceat(g, start) != np.maximum.reduceat(g, start)) if len(t) else np.zeros(0, bool)
    local = np.bincount(w[np.repeat(mixed, run)], minlength=len(keys))
    seen = t[start[mixed]]
    rest = np.repeat(~mixed, run)
    t, w = t[rest], w[rest]
    place = lambda x: ((x * np.uint64(buckets)) >> np.uint64(_BITS)).astype(np.int64) if buckets < 4096 else (mix64(x) % np.uint64(buckets)).astype(np.int64)
    tb, sb = place(t), place(seen)
    order = np.lexsort((w, tb))
    t, w, tb = t[order], w[order], tb[order]
    cols: dict[str, list] = {f.name: [] for f in _WIRE}
    edges, sedges = np.searchsorted(tb, np.arange(buckets + 1)), np.searchsorted(sb[(so := np.argsort(sb, kind="stable"))], np.arange(buckets + 1))
    seen = seen[so]
    low = np.uint64(0xFFFFFFFF)
    for b in range(buckets):
        lo, hi, slo, shi = edges[b], edges[b + 1], sedges[b], sedges[b + 1]
        if lo == hi and slo == shi:
            continue
        idx, cnt = np.unique(w[lo:hi], return_counts=True)
        for name, value in (("bucket", b), ("block", block), ("self", False), ("idx", idx.astype(np.uint16).tobytes()), ("sig", sig[idx].tobytes()), ("cnt", cnt.astype(np.uint32).tobytes()), ("tok", (t[lo:hi] & low).astype(np.uint32).tobytes()), ("seen", (seen[slo:shi] & low).astype(np.uint32).tobytes()), ("keys", None)):
            cols[name].append(value)
    own = int(mix64(np.uint64([abs(hash_text(block))]))[0] % np.uint64(buckets))
    for name, value in (("bucket", own), ("block", block), ("self", True), ("idx", None), ("sig", None), ("cnt", local.astype(np.uint32).tobytes()), ("tok", size.astype(np.uint32).tobytes()), ("seen", None), ("keys", keys)):
        cols[name].append(value)
    return pa.RecordBatch.from_pydict(cols, schema=_WIRE)


def hash_text(s: str) -> int:
    """A small stable hash of a name."""
    h = 0
    for c in s.encode():
        h = (h * 131 + c) & 0x7FFFFFFFFFFFFFFF
    return h


def _answer(group: pa.Table) -> pa.Table:
    """A bucket's answers: for each block and set, how many of the shingles it sent are in sets of other groups."""
    get = lambda name, dtype: [np.frombuffer(x or b"", dtype=dtype) for x in group.column(name).to_pylist()]
    selfs = group.column("self").to_pylist()
    idx, sig, cnt, tok, seen = (get(n, d) for n, d in (("idx", np.uint16), ("sig", np.uint64), ("cnt", np.uint32), ("tok", np.uint32), ("seen", np.uint32)))
    rows = [i for i, s in enumerate(selfs) if not s]
    cols: dict[str, list] = {f.name: [] for f in _WIRE}
    table_ = group.select([f.name for f in _WIRE])
    if rows:
        t = np.concatenate([tok[i] for i in rows])
        per_idx = np.concatenate([cnt[i] for i in rows])
        slot = np.repeat(np.arange(len(per_idx), dtype=np.uint32), per_idx)
        g = np.unique(np.concatenate([sig[i] for i in rows]), return_inverse=True)[1].astype(np.uint32)[slot]
        known = np.unique(np.concatenate([seen[i] for i in rows]))
        order = np.argsort(t, kind="stable")
        ts, gs = t[order], g[order]
        del t, g
        shared = np.zeros(len(ts), dtype=bool)
        if len(ts):
            start = np.flatnonzero(np.r_[True, ts[1:] != ts[:-1]])
            run = np.diff(np.r_[start, len(ts)])
            mixed = np.minimum.reduceat(gs, start) != np.maximum.reduceat(gs, start)
            if len(known):
                at = np.minimum(np.searchsorted(known, ts[start]), len(known) - 1)
                mixed |= known[at] == ts[start]
            shared[order] = np.repeat(mixed, run)
        hits = np.bincount(slot[shared], minlength=len(per_idx))
        at = 0
        for i in rows:
            n = len(idx[i])
            mine = hits[at : at + n]
            at += n
            keep = mine > 0
            if keep.any():
                for name, value in (("bucket", None), ("block", group.column("block")[i].as_py()), ("self", False), ("idx", idx[i][keep].tobytes()), ("sig", None), ("cnt", mine[keep].astype(np.uint32).tobytes()), ("tok", None), ("seen", None), ("keys", None)):
                    cols[name].append(value)
    out = pa.Table.from_pydict(cols, schema=_WIRE)
    own = table_.filter(pa.array(selfs, pa.bool_())) if any(selfs) else None
    return pa.concat_tables([out, own.cast(_WIRE)]) if own is not None else out


def _gather(group: pa.Table) -> pa.Table:
    """A block's sets with their size and how many of their shingles other groups hold."""
    selfs = group.column("self").to_pylist()
    own = selfs.index(True)
    keys = group.column("keys")[own].as_py()
    size = np.frombuffer(group.column("tok")[own].as_py() or b"", dtype=np.uint32)
    shared = np.frombuffer(group.column("cnt")[own].as_py() or b"", dtype=np.uint32).astype(np.int64)
    for i, s in enumerate(selfs):
        if not s:
            shared[np.frombuffer(group.column("idx")[i].as_py(), dtype=np.uint16)] += np.frombuffer(group.column("cnt")[i].as_py(), dtype=np.uint32)
    return pa.table({"key": pa.array(keys, pa.string()), "n": pa.array(size.astype(np.int64)), "shared": pa.array(shared)})


def _exchange(wire: DataFrame) -> DataFrame:
    answered = wire.groupBy("bucket").applyInArrow(_answer, _WIRE_DDL)
    return answered.groupBy("block").applyInArrow(_gather, "key string, n bigint, shared bigint")


def _buckets(tokens: int) -> int:
    return max(4, math.ceil(tokens / BUCKET_TOKENS))


def _overlaps(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _set(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=np.int64)


def _small(df: DataFrame) -> DataFrame:
    """df (a checkpoint of short rows), to be broadcast if it has at most SMALL_ROWS rows (some 7 MB); else joins shuffle it."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _stars(sets: DataFrame, slot: int, percent: int) -> DataFrame:
    """(a, b): links between texts with the same slot-th least shingle and the LEADERS least keys among them.

    A text meets a bounded number of leaders and keeps at most LINKS links; links
    that this leaves out are found by _across() unless a component has them
    already. The shingles are shuffled once: texts go to their leaders' place.
    """
    slim = sets.select("key", F.element_at("mins", slot + 1).alias("m"))
    counts = slim.groupBy("m").agg(F.count("*").alias("c")).where("c > 1").select("m", F.ceil(F.col("c") / SALT_ROWS).cast("int").alias("salts"))
    # The first LEADERS of parts of a group, then of these: no task sees all of a large group.
    part = slim.withColumn("s", F.pmod(F.xxhash64("key"), F.lit(LEADERS)).cast("int")).withColumn("r", F.expr("row_number() OVER (PARTITION BY m, s ORDER BY key)")).where(F.col("r") <= LEADERS).drop("r")
    chief = cut(part.select("key", "m")).withColumn("r", F.expr("row_number() OVER (PARTITION BY m ORDER BY key)")).where(F.col("r") <= LEADERS).select("key", "r")
    grouped = slim.join(counts, "m").join(_small(cut(chief)), "key", "left")
    # Leaders go to every salt of their group and are told apart from its members by their rank.
    places = F.when(F.col("r").isNotNull(), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")))
    placed = cut(grouped.select("key", "m", F.coalesce("r", F.lit(LEADERS + 1)).alias("part"), places.alias("places")))
    met = sets.select("key", "tokens").join(_small(placed), "key").select("m", F.explode("places").alias("salt"), "part", "key", "tokens")
    met = met.repartition("m", "salt").sortWithinPartitions("m", "salt", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaders = None, []
        for batch in batches:
            a, b = [], []
            rows = (row for lo in range(0, batch.num_rows, 256) for row in zip(*(batch.column(i).slice(lo, 256).to_pylist() for i in range(5)), strict=True))
            for m, salt, part, key, tokens in rows:
                if at != (m, salt):
                    at, leaders = (m, salt), []
                mine, found = _set(tokens), 0
                if part > LEADERS or salt == 0:
                    for other, theirs in leaders:
                        small, large = sorted((len(mine), len(theirs)))
                        if 100 * small < percent * large:
                            continue
                        both = _overlaps(theirs, mine)
                        if 100 * both >= percent * (small + large - both):
                            a.append(key)
                            b.append(other)
                            found += 1
                            if found == LINKS:
                                break
                if part <= LEADERS:
                    leaders.append((key, mine))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    return met.mapInArrow(released(run), "a string, b string")


def _unions(grouped: DataFrame) -> DataFrame:
    """Each group's component, least and largest size, and union of shingles."""

    def union(t: pa.Table) -> pa.Table:
        sizes = t.column("n").to_pylist()
        all_ = np.unique(np.concatenate([_set(x) for x in t.column("tokens").to_pylist()]))
        return pa.table({"grp": t.column("grp")[:1], "component": t.column("component")[:1], "least": pa.array([min(sizes)], pa.int64()), "most": pa.array([max(sizes)], pa.int64()), "tokens": pa.array([all_.tobytes()], pa.binary())})

    return grouped.groupBy("grp").applyInArrow(union, "grp string, component string, least bigint, most bigint, tokens binary")


def _token_rows(sets: DataFrame, *keep: str) -> DataFrame:
    """A row for each shingle of the sets."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sets.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                tokens = [_set(x) for x in part.column(len(keep)).to_pylist()]
                which = pa.array(np.repeat(np.arange(len(tokens)), [len(t) for t in tokens]))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(which) for i in range(len(keep))), pa.array(np.concatenate(tokens))], names=[*keep, "token"])

    return sets.select(*keep, "tokens").mapInArrow(released(run), f"{kinds}, token bigint")


def _across(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): all links between texts of different components. sets: key, n, tokens, component, grp (a part of the component)."""
    unions = cut(_unions(sets))
    total = unions.agg(F.sum(F.octet_length("tokens"))).head()[0] or 0
    if not total:
        return sets.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0)
    buckets = _buckets(total // 8)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step, size, lo = batch.column(2).to_pylist(), 0, 0
            for hi in range(1, batch.num_rows + 1):
                size += len(step[hi - 1])
                if size > 1 << 24 or hi == batch.num_rows:
                    tokens = [_set(x) for x in step[lo:hi]]
                    sizes_ = np.array([len(x) for x in tokens])
                    keys = batch.column(0).to_pylist()[lo:hi]
                    sig = np.array([hash_text(c) for c in batch.column(1).to_pylist()[lo:hi]], dtype=np.uint64)
                    yield _wire("|".join((keys[0], keys[-1], str(len(keys)))), keys, mix64(sig), sizes_, np.concatenate(tokens).astype(np.uint64), np.repeat(np.arange(len(keys)), sizes_), buckets)
                    lo, size = hi, 0

    met = _exchange(unions.select("grp", "component", "tokens").mapInArrow(released(send), _WIRE_DDL))
    open_ = met.join(unions.select(F.col("grp").alias("key"), "least"), "key").where(F.col("shared") * 100 >= F.col("least") * percent).select(F.col("key").alias("grp"))
    inside = cut(sets.join(_small(cut(open_)), "grp", "left_semi"))
    if inside.isEmpty():
        return sets.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0)
    # Of the open groups' texts, those with enough shingles that other components hold; prefixes are by rarity.
    rows = _token_rows(inside, "key", "n", "component")
    known = rows.select("token", "component").distinct().groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    rows = cut(rows.join(known, "token"))
    need = F.ceil(F.col("n") * percent / 100)
    held = rows.groupBy("key", "n", "component").agg(F.count("*").alias("shared"), F.min(F.xxhash64("token")).alias("m")).where(F.col("shared") >= need)
    # Texts of a larger component are grouped together, others with the same least shared shingle; groups are cut to size.
    held = cut(held.join(held.groupBy("component").agg(F.count("*").alias("c")), "component").withColumn("kind", F.when(F.col("c") >= 8, F.concat(F.lit("c"), "component")).otherwise(F.concat(F.lit("m"), F.col("m").cast("string")))))
    parts = held.groupBy("kind").agg(F.ceil(F.greatest(F.count("*") / GROUP_TEXTS, F.sum("n") / GROUP_TOKENS)).alias("parts"))
    texts = cut(held.join(parts, "kind").select("key", "n", "component", "shared", F.concat_ws("/", "kind", F.pmod(F.xxhash64("key"), F.col("parts")).cast("string")).alias("g")))
    packed = cut(_packed(inside.select("key", "tokens").join(_small(texts), "key").select("g", "key", "component", "tokens")))
    # All unshared shingles come first in a prefix of n - need + 1, so n - shared of it are used up.
    ranked = rows.select("key", "token", "df").join(texts, "key").withColumn("r", F.expr("row_number() OVER (PARTITION BY key ORDER BY df, token)"))
    prefix = cut(ranked.where(F.col("r") <= F.col("shared") - need + 1).select("g", "token").distinct())
    queries = prefix.join(prefix.withColumnRenamed("g", "h"), "token").where("g <= h").select("g", "h").distinct()
    sizes = packed.select("g", "least", "most", "only")
    sizes2 = packed.select(F.col("g").alias("h"), F.col("least").alias("least2"), F.col("most").alias("most2"), F.col("only").alias("only2"))
    possible = (F.col("most") * 100 >= F.col("least2") * percent) & (F.col("most2") * 100 >= F.col("least") * percent) & ~F.coalesce(F.col("only") == F.col("only2"), F.lit(False))
    queries = cut(queries.join(sizes, "g").join(sizes2, "h").where(possible).select("g", "h"))
    # A pair is a large row and a batch holds a task's rows, so a task gets PAIRS of them.
    spread = max(1, math.ceil(queries.count() / PAIRS))
    volume = packed.agg(F.sum(F.octet_length("tokens"))).head()[0] or 0
    lookup = F.broadcast if volume <= SMALL_BYTES else (lambda df: df)  # groups are as large as their shingles; else they are shuffled
    both = queries.repartition(spread, "g", "h").join(lookup(packed.select("g", "keys", "components", "sizes", "tokens")), "g")
    both = both.join(lookup(packed.select(F.col("g").alias("h"), F.col("keys").alias("keys2"), F.col("components").alias("components2"), F.col("sizes").alias("sizes2"), F.col("tokens").alias("tokens2"))), "h")
    return _opened(both if volume <= SMALL_BYTES else both.repartition(spread, "g", "h"), percent).distinct()


def _packed(texts: DataFrame) -> DataFrame:
    """A row for each group g: its texts' keys, components, sizes and shingles, least and largest size, and its component if it has one only."""

    def pack(t: pa.Table) -> pa.Table:
        sets = [_set(x) for x in t.column("tokens").to_pylist()]
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        components_ = t.column("component").to_pylist()
        return pa.table({
            "g": t.column("g")[:1], "keys": pa.array([t.column("key").to_pylist()], pa.list_(pa.string())), "components": pa.array([components_], pa.list_(pa.string())),
            "sizes": pa.array([sizes.tolist()], pa.list_(pa.int64())), "tokens": pa.array([np.concatenate(sets).tobytes()], pa.binary()),
            "least": pa.array([int(sizes.min())], pa.int64()), "most": pa.array([int(sizes.max())], pa.int64()), "only": pa.array([components_[0] if len(set(components_)) == 1 else None], pa.string()),
        })

    return texts.groupBy("g").applyInArrow(pack, "g string, keys array<string>, components array<string>, sizes array<bigint>, tokens binary, least bigint, most bigint, only string")


def _opened(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join the components of two groups. A pair of groups opens if their unions share enough for their smallest texts.

    The texts' common shingles are one product of two 0-1 matrices over the
    shingles that the unions share; of the links, a spanning forest of the components goes out.
    """

    def incidence(tokens: np.ndarray, sizes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        hit = common[at] == tokens
        return owner[hit], at[hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for k in range(batch.num_rows):
                one, two = ({n: batch.column(f"{n}{end}")[k].as_py() for n in ("keys", "components", "sizes", "tokens")} for end in ("", "2"))
                x, y = _set(one["tokens"]), _set(two["tokens"])
                nx, ny = np.array(one["sizes"]), np.array(two["sizes"])
                common = np.intersect1d(x, y)
                if 100 * len(common) < percent * max(nx.min(), ny.min()):
                    continue
                ox, tx = incidence(x, nx, common)
                oy, ty = incidence(y, ny, common)
                overlap = np.zeros((len(nx), len(ny)), dtype=np.float32)
                for lo in range(0, len(common), 8192):
                    width = min(8192, len(common) - lo)
                    m, n = np.zeros((len(nx), width), np.float32), np.zeros((len(ny), width), np.float32)
                    p, q = (tx >= lo) & (tx < lo + width), (ty >= lo) & (ty < lo + width)
                    m[ox[p], tx[p] - lo] = 1
                    n[oy[q], ty[q] - lo] = 1
                    overlap += m @ n.T
                whole = overlap.astype(np.int64)
                i, j = np.nonzero(100 * whole >= percent * (nx[:, None] + ny[None, :] - whole))
                root: dict[str, str] = {}

                def find(c: str, root: dict[str, str] = root) -> str:
                    while c in root:
                        c = root[c]
                    return c

                for p, q in zip(i.tolist(), j.tolist(), strict=True):
                    c, d = find(one["components"][p]), find(two["components"][q])
                    if c != d:
                        root[max(c, d)] = min(c, d)
                        a.append(one["keys"][p])
                        b.append(two["keys"][q])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    return pairs.mapInArrow(released(run), "a string, b string")


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of df: id, key (its set; null if empty), n_shingles, component (of keys), component_id, text_hash (Spark's xxhash64).

    An output that has the id column's name is left out.
    """
    docs = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    volume = docs.agg(F.sum(F.octet_length("__text"))).head()[0] or 0
    buckets = _buckets(volume // 6)
    kind = df.schema[id_col].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = 0
        for batch in batches:
            sizes_ = np.diff(np.frombuffer(batch.column(1).buffers()[1], dtype=np.int32)[batch.column(1).offset :][: batch.num_rows + 1]) if pa.types.is_string(batch.column(1).type) else np.array([len(x) for x in batch.column(1).to_pylist()])
            lo = 0
            while lo < batch.num_rows:
                hi, size = lo, 0
                while hi < batch.num_rows and hi - lo < BLOCK_TEXTS and (size < BLOCK_BYTES or hi == lo):
                    size += int(sizes_[hi])
                    hi += 1
                part = batch.slice(lo, hi - lo)
                texts = [t.encode() for t in part.column(1).to_pylist()]
                # A row is named by the hash of its text and its id, null apart from all texts.
                ids = [f"{xxhash.xxh64_hexdigest(t, seed=42)}{'-' if x is None else f'={x}'}" for x, t in zip(part.column(0).to_pylist(), texts, strict=True)]
                found: dict[tuple[int, int], int] = {}
                tokens, where, sizes, sigs, keys = [], [], [], [], []
                for a, b, token, at in shingle_sets(texts, width):
                    n, one, two = digests(token, at, b - a)
                    names = _key(one, two)
                    new = np.full(b - a, -1, dtype=np.int64)
                    for i in range(b - a):
                        spot = (int(one[i]), int(two[i]))
                        keys.append((ids[a + i], names[i] if n[i] else "", int(n[i])))
                        if n[i] and spot not in found:
                            found[spot] = new[i] = len(found)
                            sizes.append(int(n[i]))
                            sigs.append(spot[0])
                    kept = new[at] >= 0
                    tokens.append(token[kept])
                    where.append(new[at[kept]])
                # Every row is named in the block's own part; equal sets answer together.
                names = [f"{k}\t{i}" for i, k, _ in keys]
                name = f"{TaskContext.get().partitionId()}|{serial}|{len(keys)}|{keys[0][0]}|{keys[0][1]}|{keys[-1][0]}|{keys[-1][1]}|{hash_text(''.join(names)):x}"
                wire = _wire(name, [f"{a:016x}{b:016x}" for a, b in found], np.array(sigs, dtype=np.uint64), np.array(sizes, dtype=np.int64), np.concatenate(tokens), np.concatenate(where), buckets)
                yield from _with_rows(wire, names)
                lo, serial = hi, serial + 1

    def _with_rows(wire: pa.RecordBatch, names: list[str]) -> Iterator[pa.RecordBatch]:
        own = wire.column("keys").to_pylist()
        own[-1] = [*own[-1], "", *names]
        yield pa.RecordBatch.from_arrays([*wire.columns[:-1], pa.array(own, pa.list_(pa.string()))], schema=_WIRE)

    def rows_of(group: pa.Table) -> pa.Table:
        selfs = group.column("self").to_pylist()
        own = selfs.index(True)
        keys = group.column("keys")[own].as_py()
        split = keys.index("")
        names = keys[split + 1 :]
        size = np.frombuffer(group.column("tok")[own].as_py() or b"", dtype=np.uint32)
        shared = np.frombuffer(group.column("cnt")[own].as_py() or b"", dtype=np.uint32).astype(np.int64)
        for i, s in enumerate(selfs):
            if not s:
                shared[np.frombuffer(group.column("idx")[i].as_py(), dtype=np.uint16)] += np.frombuffer(group.column("cnt")[i].as_py(), dtype=np.uint32)
        of = {k: (int(n), int(c)) for k, n, c in zip(keys[:split], size, shared, strict=True)}
        parts = [x.split("\t", 1) for x in names]
        got = [of.get(k, (0, 0)) for k, _ in parts]
        return pa.table({"id": pa.array([i for _, i in parts], pa.string()), "key": pa.array([k or None for k, _ in parts], pa.string()), "n": pa.array([g[0] for g in got], pa.int64()), "shared": pa.array([g[1] for g in got], pa.int64())})

    wire = docs.mapInArrow(released(blocks), _WIRE_DDL)
    answered = wire.groupBy("bucket").applyInArrow(_answer, _WIRE_DDL)
    rows = answered.groupBy("block").applyInArrow(rows_of, "id string, key string, n bigint, shared bigint")
    name = F.when(F.substring("id", 17, 1) == "=", F.substring(F.col("id"), 18, 1 << 30))
    rows = cut(rows.select(name.cast(kind).alias("id"), F.conv(F.substring("id", 1, 16), 16, -10).cast("long").alias("text_hash"), "key", "n", "shared"))
    nodes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least"), F.max("n").alias("n"), F.max("shared").alias("shared"))
    nodes = cut(nodes)
    likely = nodes.where(F.col("shared") * 100 >= F.col("n") * percent)

    # The sets of the texts that may link, from one text of each node.
    wanted = likely.select(F.col("least").alias("__wanted"))
    chosen = docs.join(_small(wanted), F.col("__id").eqNullSafe(F.col("__wanted")), "left_semi")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mix64(np.arange(1, 4, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        for batch in batches:
            for a, b, token, at in shingle_sets([t.encode() for t in batch.column(1).to_pylist()], width):
                n, one, two = digests(token, at, b - a)
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                ends = np.cumsum(n)
                start = ends - n
                mins = [np.minimum.reduceat(mix64(token ^ s) >> np.uint64(1), start[full]).astype(np.int64) for s in salts]
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(_key(one[full], two[full]), pa.string()), "n": pa.array(n[full].astype(np.int64)),
                    "mins": pa.array(np.stack(mins, axis=1).tolist(), pa.list_(pa.int64())),
                    "tokens": pa.array([token[start[i] : ends[i]].astype(np.int64).tobytes() for i in full], pa.binary()),
                })

    sets = chosen.mapInArrow(released(sets_of), "key string, n bigint, mins array<bigint>, tokens binary")
    sets = cut(sets.join(_small(likely.select("key")), "key", "left_semi").dropDuplicates(["key"]))
    links = None
    rest = sets
    for slot in range(3):
        found = cut(_stars(rest, slot, percent))
        links = found if links is None else links.unionByName(found)
        # Leaders stand for their group in the next slots, texts linked to one are done.
        linked = cut(found.select(F.col("a").alias("key")).distinct().join(found.select(F.col("b").alias("key")), "key", "left_anti"))
        rest = rest.join(_small(linked), "key", "left_anti")
    stars = cut(components(links))
    slim = sets.select("key").join(stars.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("component", "key").alias("component"))
    sizes = slim.groupBy("component").agg(F.ceil(F.count("*") / GROUP_TEXTS).alias("groups"))
    slim = cut(slim.join(sizes, "component").select("key", "component", F.concat_ws("/", "component", F.pmod(F.xxhash64("key"), F.col("groups")).cast("string")).alias("grp")))
    placed = sets.select("key", "n", "tokens").join(_small(slim), "key")
    more = cut(_across(placed, percent))
    if not more.isEmpty():
        stars = cut(components(links.unionByName(more)))
    of = nodes.select("key", "least").join(stars.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("component", "key").alias("component"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.select("key", "component").join(least, "component")
    outputs = {
        "key": F.col("key"), "n_shingles": F.col("n"), "component": F.col("component"),
        "component_id": F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")), "text_hash": F.col("text_hash"),
    }
    mine = [v.alias(k) for k, v in outputs.items() if k != id_col.lower()]
    return rows.join(of, "key", "left").select(F.col("id").alias(id_col), *mine)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """df without near copies: of the rows of a component the one of least id and, of these, least text hash stays.

    A row is its id and its text (by a 64-bit hash, xxhash64), so rows that share an id but not a text are
    kept or dropped apart; of repeated rows one stays, the least of its other
    columns. Rows without words are in no component and all stay.
    """
    names = [f"__c{i}" for i in range(len(df.columns))]
    ids, text = (F.col(names[df.columns.index(c)]) for c in (id_col, text_col))
    base = df.toDF(*names)
    placed = ngram_join(base.select(ids.alias("__i"), text.alias("__t")), "__i", "__t", width, percent)
    placed = placed.where("component IS NOT NULL").select("__i", F.col("text_hash").alias("__th"), "component")
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("__i").isNull().alias("no"), "__i", "__th")).alias("f"), F.count("*").alias("c")).where("c > 1").drop("c")
    named = placed.join(_small(cut(first)), "component").withColumn("stays", (F.col("__i").eqNullSafe(F.col("f.__i"))) & (F.col("__th") == F.col("f.__th")))
    of = cut(named.groupBy("__i", "__th").agg(F.max("stays").alias("__stays"), F.count("*").alias("times")).where("NOT __stays OR times > 1").drop("times"))
    rows = base.withColumn("__h", F.xxhash64(F.coalesce(text, F.lit(""))))
    met = lambda found, how: rows.join(_small(found), ids.eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__th")), how)
    out = met(of, "left").where("__stays IS NULL").select(*names)
    again = cut(of.where("__stays"))
    if not again.isEmpty():
        out = out.unionByName(met(again, "left_semi").groupBy(ids.alias("__i"), "__h").agg(F.min(F.struct(*names)).alias("r")).select("r.*"))
    return out.toDF(*df.columns)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join(docs).select("doc_id", "n_shingles", "component_id")
