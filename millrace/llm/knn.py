"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to the unit ball and, where their norms differ, given one
more coordinate that makes them unit vectors, so the largest inner product is
the nearest direction. Each of `tables` pseudo-rotations (three rounds of
random signs and a Hadamard transform) assigns a vector to its nearest signed
axis. A query probes the axes nearest to it in every table and ranks the
candidates found there by their inner products on the original vectors.

Equal vectors are one candidate: only the k + 1 smallest ids among them can be
in a result, and those are kept exactly. A bucket is dealt in blocks of
BLOCK vectors and BLOCK queries, without a cap. The nearest FIRST axes of every
table are probed first; the best products found there bound what the other
probes pass on, which changes no result and keeps their rows in proportion to
the queries. A query left with k products or fewer is asked of all vectors,
block by block.

Defined cases: vectors that are null, zero, of another than the commonest
length, or hold null or non-finite components take no part; a null id is no
query and no candidate; repeated rows count once, and of different vectors with
one id as query the one with the least digest asks; fewer candidates than k give
all of them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, hash128, table

BLOCK, FIRST = 4_096, 2


def rotations(dim: int, tables: int, seed: int) -> np.ndarray:
    """Signs of the three rounds of each table."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, dim))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of x (of a power of two columns) under one pseudo-rotation."""
    n, dim = x.shape
    for s in signs:
        x = x * s
        step = 1
        while step < dim:
            y = x.reshape(n, dim // (2 * step), 2, step)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, dim)
            step *= 2
        x = x / np.sqrt(dim)
    return x


def _placed(x: np.ndarray, width: int, norm: float, query: bool) -> np.ndarray:
    """Unit vectors of `width` coordinates; a candidate's last one takes up what its norm lacks."""
    out = np.zeros((len(x), width))
    scaled = x / (np.linalg.norm(x, axis=1, keepdims=True) if query else norm)
    out[:, : x.shape[1]] = scaled
    if not query and width > x.shape[1]:
        out[:, x.shape[1]] = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def knn(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = 8, probe_share: float = 0.125, seed: int = 7) -> DataFrame:
    """(query_id, rank, id, score): each query row's k candidates of largest inner product found."""
    v = F.col("v")
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(v.isNotNull() & F.coalesce(fine, F.lit(False)))
    h1, h2 = hash128(v)
    rows = cut(rows.select("id", "q", "v", h1.alias("h1"), h2.alias("h2")))
    out_id = id_col if id_col.lower() not in ("query_id", "rank", "score") else "candidate_id"
    out_kind = f"query_id bigint, rank int, {out_id} bigint, score double"
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head()
    if dims is None:
        return df.sparkSession.createDataFrame([], out_kind)
    rows = rows.where(F.size("v") == dims["d"])
    kept = rows.select("h1", "h2", "id").withColumn("place", F.expr("dense_rank() OVER (PARTITION BY h1, h2 ORDER BY id)")).where(F.col("place") <= k + 1).distinct()
    kept = cut(kept)
    vectors = cut(rows.join(kept.where("place = 1").select("h1", "h2", "id"), ["h1", "h2", "id"], "left_semi").dropDuplicates(["h1", "h2"]).select("h1", "h2", F.col("id").alias("least"), "v"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    low, high = vectors.select(F.sqrt(norm2).alias("n")).agg(F.min("n"), F.max("n")).head()
    plain = high - low <= 1e-6 * high
    width = 1 << max(1, (int(dims["d"]) + (0 if plain else 1) - 1).bit_length())
    norm = float(high)
    probes = max(1, round(2 * width * probe_share))
    signs = rotations(width, tables, seed)
    asked = cut(rows.where("q").select("id", "h1", "h2").groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2").join(vectors.select("h1", "h2", "v"), ["h1", "h2"]))

    def axes(x: np.ndarray, query: bool, t: int, lo: int = 0, hi: int = 1) -> np.ndarray:
        turned = rotate(_placed(x, width, norm, query), signs[t])
        both = np.concatenate([turned, -turned], axis=1)
        return np.argsort(-both, axis=1, kind="stable")[:, lo:hi] if query else np.argmax(both, axis=1)[:, None]

    def deal(query: bool, first: int = 0, last: int = 1):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 2_048):
                    part = batch.slice(lo, 2_048)
                    x = _matrix(part.column(2))
                    floor = part.column(4).to_numpy(zero_copy_only=False) if query else np.zeros(len(x))
                    packed = pa.array([r.tobytes() for r in x], pa.binary())
                    for t in range(tables):
                        at = axes(x, query, t, first, last)
                        which = pa.array(np.repeat(np.arange(len(x)), at.shape[1]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(at.size, t, np.int32)), pa.array(at.ravel().astype(np.int32)), *(part.column(i).take(which) for i in (0, 1)), part.column(3).take(which), pa.array(np.repeat(floor, at.shape[1])), packed.take(which)],
                            names=["t", "b", "h1", "h2", "qid", "floor", "v"],
                        )

        return run

    def packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([r.tobytes() for r in _matrix(batch.column(6))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], packed], names=["t", "b", "h1", "h2", "qid", "floor", "v"])

    kinds = "t int, b int, h1 bigint, h2 bigint, qid bigint, floor double, v binary"
    held = vectors.select("h1", "h2", "v", "least").mapInArrow(deal(False), kinds)
    probing = asked.select("h1", "h2", "v", "id").mapInArrow(deal(True), kinds)
    names = ["t", "b", "cv", "cq"]
    spread = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    blocks = lambda rows_, name: rows_.groupBy("t", "b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    def rank(vs: pa.Table, qs: pa.Table) -> pa.Table:
        data = lambda tab: np.frombuffer(b"".join(tab.column("v").to_pylist()), dtype=np.float64).reshape(tab.num_rows, -1)
        none = np.zeros(0, np.int64)
        a, b, s = none, none, np.zeros(0)
        if vs.num_rows and qs.num_rows:
            x, y, floor = data(vs), data(qs), qs.column("floor").to_numpy().copy()
            qi, vi = [], []
            for lo in range(0, len(y), 256):
                s_ = y[lo : lo + 256] @ x.T
                if s_.shape[1] > k + 2:
                    floor[lo : lo + 256] = np.maximum(floor[lo : lo + 256], -np.partition(-s_, k + 1, axis=1)[:, k + 1] - 1e-9)
                i, j = np.nonzero(s_ >= floor[lo : lo + 256, None])
                qi.append(i + lo)
                vi.append(j)
            a, b = np.concatenate(qi), np.concatenate(vi)
            # Summed in one order whatever the block, so equal vectors have equal scores.
            s = np.concatenate([(y[a[i : i + 8192]] * x[b[i : i + 8192]]).sum(axis=1) for i in range(0, len(a), 8192)] or [s])
        return pa.table({"qid": qs.column("qid").take(pa.array(a)), "h1": vs.column("h1").take(pa.array(b)), "h2": vs.column("h2").take(pa.array(b)), "least": vs.column("qid").take(pa.array(b)), "score": pa.array(s)})

    def meet(held: DataFrame, probing: DataFrame) -> DataFrame:
        """Queries against the vectors of the buckets they probe."""
        counts = F.broadcast(cut(blocks(held, "nv").join(blocks(probing, "nq"), ["t", "b"])))  # one row a bucket: tables * 2 * width at most
        left = held.join(counts, ["t", "b"]).withColumn("cv", F.pmod(F.xxhash64("h1", "h2"), F.col("nv")).cast("int")).withColumn("cq", spread("nq"))
        right = probing.join(counts, ["t", "b"]).withColumn("cq", F.pmod(F.xxhash64("qid"), F.col("nq")).cast("int")).withColumn("cv", spread("nv"))
        found = left.select(*names, "h1", "h2", "qid", "v").groupBy(*names).cogroup(right.select(*names, "qid", "floor", "v").groupBy(*names)).applyInArrow(rank, "qid bigint, h1 bigint, h2 bigint, least bigint, score double")
        return found.groupBy("qid", "h1", "h2", "least").agg(F.max("score").alias("score"))

    held = cut(vectors.select("h1", "h2", "v", "least").mapInArrow(deal(False), kinds))
    near = min(FIRST, probes)
    ask = lambda rows_, floor, lo, hi: rows_.select("h1", "h2", "v", "id", floor.alias("floor")).mapInArrow(deal(True, lo, hi), kinds)
    found = cut(meet(held, ask(asked, F.lit(float("-inf")), 0, near)))
    if probes > near:
        # k + 1 other vectors at least as good as this bound are known already.
        best = found.withColumn("r", F.expr("row_number() OVER (PARTITION BY qid ORDER BY score DESC)")).where(F.col("r") <= k + 1)
        floors = best.groupBy(F.col("qid").alias("id")).agg(F.when(F.count("*") > k, F.min("score") - 1e-9).otherwise(F.lit(float("-inf"))).alias("floor"))
        bounded = cut(asked.join(floors, "id", "left"))
        found = cut(found.unionByName(meet(held, ask(bounded, F.coalesce("floor", F.lit(float("-inf"))), near, probes))).groupBy("qid", "h1", "h2", "least").agg(F.max("score").alias("score")))
    # Queries that met too few vectors above their bound are asked of all vectors, in blocks.
    met = found.groupBy("qid").agg(F.count("*").alias("c")).where(F.col("c") > k).select(F.col("qid").alias("id"))
    short = cut(asked.join(met, "id", "left_anti"))
    if not short.isEmpty():
        all_in_one = [F.lit(-1).alias("t"), F.lit(0).alias("b"), "h1", "h2"]
        pack = lambda rows_, qid: rows_.select(*all_in_one, qid.alias("qid"), F.lit(float("-inf")).alias("floor"), "v").mapInArrow(packed_rows, kinds)
        found = found.join(short.select(F.col("id").alias("qid")), "qid", "left_anti").unionByName(meet(pack(vectors, F.col("least")), pack(short, F.col("id"))))
    # k + 1 different vectors hold the k best rows: one may be the query's own.
    best = found.withColumn("r", F.expr("row_number() OVER (PARTITION BY qid ORDER BY score DESC, least)")).where(F.col("r") <= k + 1)
    each = best.join(kept, ["h1", "h2"]).where("id <> qid")
    each = each.withColumn("rank", F.expr("row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)")).where(F.col("rank") <= k)
    return each.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias(out_id), "score")


def op6_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
