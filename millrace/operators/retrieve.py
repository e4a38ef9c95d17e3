"""Retrieval: dense and lexical top-k, diversification, threshold clusters, linear heads.

Queries are a stated set asked of all rows. The dense product runs block
against block in numpy, and each block keeps k rows a query, so no pair of rows
becomes a row of a table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators.lineage import cut
from millrace.operators.ordering import positions_by

#: Rows of a block of vectors and of queries.
BLOCK = 8_192


def dense_top_k(df: DataFrame, is_query: Column, key: str, vec: str, k: int, label: str) -> DataFrame:
    """(query_id, query_label, key, label, score, rank): the k rows of largest cosine, ties to the smaller key; the query's own row is left out."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vec).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("v IS NOT NULL")
    n = df.count()
    blocks = max(1, -(-n // BLOCK))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = rows.where("q").withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(max(1, blocks // 8))).cast("int"))
    qblocks = max(1, blocks // 8)
    left = dealt.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1)))).select("b", "qb", "id", "label", "v")
    right = asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = right.select(F.col("b").alias("b2"), F.col("qb").alias("qb2"), F.col("id").alias("q_id"), F.col("label").alias("q_label"), F.col("v").alias("q_v"))

    def meet(x: pa.Table, q: pa.Table) -> pa.Table:
        names = ["query_id", "query_label", "id", "label", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        if not x.num_rows or not q.num_rows:
            return pa.table({n_: pa.array([], t_) for n_, t_ in zip(names, kinds, strict=True)})

        def unit(c: pa.ChunkedArray) -> np.ndarray:
            m = np.array(c.to_pylist(), dtype=np.float64)
            return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

        a, b = unit(x.column("v")), unit(q.column("q_v"))
        xid, qid = x.column("id").to_numpy(), q.column("q_id").to_numpy()
        out: list[list] = [[] for _ in names]
        for i in range(len(b)):
            s = np.round(a @ b[i], 6) + 0.0
            s[xid == qid[i]] = -np.inf
            top = np.lexsort((xid, -s))[:k]
            top = top[s[top] > -np.inf]
            for c, v in zip(out, (np.full(len(top), qid[i]), np.full(len(top), q.column("q_label")[i].as_py()), xid[top], x.column("label").to_numpy()[top], s[top]), strict=True):
                c.append(v)
        return pa.table({n_: pa.array(np.concatenate(c), t_) for n_, c, t_ in zip(names, out, kinds, strict=True)})

    found = left.groupBy("b", "qb").cogroup(right.groupBy("b2", "qb2")).applyInArrow(meet, "query_id bigint, query_label bigint, id bigint, label bigint, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.withColumnRenamed("id", key)


def structural_top_k(df: DataFrame, is_query: Column, key: str, exact: dict[str, float], near: str, weight: float, span: float, k: int) -> DataFrame:
    """(query_id, key, score): the k rows of largest score, rounded to 6 places, ties to the smaller key; rows with the query's own key are left out.

    The score is the weights of the exact columns (text, whole numbers or dates)
    that agree, and weight * (1 - |difference| / span) of the near column (whole
    numbers); it is null, and last, if one of these is null in either row.

    No pairs of rows are made: rows that agree in all columns are one class, of
    which only the smallest keys can be found. Of rows that agree with a query in
    some exact columns, those nearest in the near column are ahead of all others,
    whatever else agrees. So a class of queries meets, for each set of exact columns,
    the few next values of the near column to both sides, by their position.
    """
    if min([weight, *exact.values()]) < 0 or weight / span < 1e-5:
        raise ValueError("weights must not be negative, and a step of the near column must show in the rounded score")
    cols = [f"e{i}" for i in range(len(exact))] + ["s"]
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), *[F.col(c).alias(n) for c, n in zip(exact, cols, strict=False)], F.col(near).cast("long").alias("s"), F.coalesce(is_query, F.lit(False)).alias("q"))
    ids = rows.groupBy(*cols, "id").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    # A query's key is in so many classes at most; of any so many entries, k have another key.
    enough = k + (ids.groupBy("id").count().agg(F.max("count")).head()[0] or 1)
    first_of = lambda by, *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order)) <= enough
    classes = cut(ids.withColumn("kept", first_of(cols, "id")).where("kept").drop("kept"))
    known = F.lit(True)
    for c in cols:
        known = known & F.col(c).isNotNull()
    levels = lambda names: F.explode(F.array(*[F.array(F.lit(str(bits)), *[F.col(c).cast("string") if bits >> i & 1 else F.lit("") for i, c in enumerate(names[:-1])]) for bits in range(1 << len(exact))]))
    # Of each set of agreeing columns and value of the near column, the smallest keys.
    held = classes.where(known).withColumn("g", levels(cols)).withColumn("kept", first_of(["g", "s"], "id")).where("kept")
    values = cut(held.groupBy("g", "s").agg(F.collect_list(F.struct("id", "n", *cols)).alias("has")))
    placed = positions_by(values, [F.col("g"), F.col("s")])
    steps = placed.select("g", F.col("s").alias("qs"), F.explode(F.sequence(F.col("position") - enough, F.col("position") + enough)).alias("position"))
    around = steps.join(placed.select("g", "position", "has"), ["g", "position"]).select("g", "qs", "has")

    queries = rows.where("q").groupBy(*cols, "id").agg(F.least(F.count("*"), F.lit(k)).alias("m"))
    queries = queries.select(F.col("id").alias("query_id"), "m", *[F.col(c).alias(f"q{c}") for c in cols], known.alias("known"))
    own = [f"q{c}" for c in cols]
    asked = queries.where("known").select(*own).distinct().withColumn("g", levels(own))
    met = asked.join(around, ["g", "qs"]).select(*own, F.explode("has").alias("h")).select(*own, "h.*").distinct()
    score = F.lit(0.0)
    for c, w in zip(cols, exact.values(), strict=False):
        score = score + w * (F.col(f"q{c}") == F.col(c)).cast("int")
    score = score + weight * (1 - F.abs(F.col("qs") - F.col("s")) / span)
    scored = met.select(*own, "id", "n", F.round(score, 6).alias("score"))
    best = scored.withColumn("kept", first_of(own, F.desc("score"), "id")).where("kept").groupBy(*own).agg(F.collect_list(F.struct("id", "n", "score")).alias("best"))
    found = queries.where("known").join(best, own).select("query_id", "m", F.explode("best").alias("b")).select("query_id", "m", "b.*")
    # Without a score: the smallest keys of all for such queries, of such rows for the others.
    for mine, theirs in ((F.col("known"), classes.where(~known)), (~F.col("known"), classes)):
        least = theirs.orderBy("id").limit(enough).select("id", "n", F.lit(None).cast("double").alias("score"))
        found = found.unionByName(queries.where(mine).select("query_id", "m").crossJoin(F.broadcast(least)))
    copies = found.where("id <> query_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n") * F.col("m"), F.lit(k)))))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return copies.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query_id", F.col("id").alias(key), "score")


def lexical_scores(queries: DataFrame, docs: DataFrame, qid: str, did: str, text: str) -> DataFrame:
    """(qid, did, score): token Jaccard above 0, by an inverted index; texts are not shuffled, only tokens."""
    token_sets = lambda df, key: df.select(key, F.array_distinct(tx.tokens(F.col(text))).alias("w"))
    post = lambda df, key, size: token_sets(df, key).select(key, F.size("w").alias(size), F.explode("w").alias("tok"))
    both = post(queries, qid, "nq").join(post(docs, did, "nd"), "tok").groupBy(qid, did, "nq", "nd").agg(F.count("*").alias("c"))
    return both.select(qid, did, F.round(F.col("c") / (F.col("nq") + F.col("nd") - F.col("c")), 6).alias("score"))


def length_scores(queries: DataFrame, docs: DataFrame, qid: str, did: str, text: str, size: str, slack: int) -> DataFrame:
    """(qid, did, score): texts of nearly the same length, by an equi-join on each length within the slack."""
    q = queries.select(qid, F.char_length(text).cast("long").alias("m")).withColumn(size, F.explode(F.sequence(F.col("m") - slack, F.col("m") + slack)))
    gap = F.abs(F.col("m") - F.col(size))
    return q.join(docs.select(did, size), size).select(qid, did, F.round(1 - gap / F.greatest("m", size), 6).alias("score"))


def jaccard_links(sets: DataFrame, key: str, items: str, least: float) -> DataFrame:
    """(x, y): keys x < y whose item sets reach a Jaccard similarity.

    Exact by prefixes: two such sets share one of their rarest size - ceil(least *
    size) + 1 items, so only those are joined, and the candidates' whole sets are compared.
    """
    posts = sets.select(F.col(key).alias("k"), F.size(items).alias("n"), F.explode(items).alias("item"))
    df = posts.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    rank = F.row_number().over(Window.partitionBy("k").orderBy("df", "item"))
    # Items that no other set holds come first in the order; they use up places of the prefix.
    held = posts.join(df, "item").withColumn("shared", F.count("*").over(Window.partitionBy("k"))).withColumn("r", rank)
    prefix = held.where(F.col("r") + F.col("n") - F.col("shared") <= F.col("n") - F.ceil(F.col("n") * F.lit(least)) + 1).select("k", "n", "item")
    a, b = prefix.select(F.col("k").alias("x"), F.col("n").alias("nx"), "item"), prefix.select(F.col("k").alias("y"), F.col("n").alias("ny"), "item")
    near = a.join(b, "item").where((F.col("x") < F.col("y")) & (F.col("nx") >= F.col("ny") * least) & (F.col("ny") >= F.col("nx") * least)).select("x", "y").distinct()
    side = lambda name, col: sets.select(F.col(key).alias(name), F.col(items).alias(col))
    return near.join(side("x", "wx"), "x").join(side("y", "wy"), "y").where(tx.jaccard(F.col("wx"), F.col("wy")) >= least).select("x", "y")


def threshold_clusters(sets: DataFrame, key: str, items: str, least: float, most_rounds: int = 60) -> DataFrame:
    """(key, cluster): components of keys whose sets reach a Jaccard similarity, named by the smallest key.

    Labels spread by a minimum over neighbours, with a jump to the label's own label, until nothing changes.
    """
    e = jaccard_links(sets, key, items, least)
    e = cut(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = cut(sets.select(F.col(key).alias("id"), F.col(key).alias("cluster")))
    for _ in range(most_rounds):
        near = e.join(label.select(F.col("id").alias("y"), "cluster"), "y").groupBy(F.col("x").alias("id")).agg(F.min("cluster").alias("m"))
        low = label.join(near, "id", "left").select("id", F.least("cluster", F.coalesce("m", "cluster")).alias("cluster"), F.col("cluster").alias("was"))
        own = low.select(F.col("id").alias("cluster"), F.col("cluster").alias("c2"))
        label = cut(low.join(own, "cluster").select("id", F.col("c2").alias("cluster"), "was"))
        if label.where("cluster <> was").isEmpty():
            return label.select(F.col("id").alias(key), "cluster")
    raise RuntimeError(f"clusters did not settle in {most_rounds} rounds")


def hash_embedding(df: DataFrame, key: str, text: str, dims: int = 384) -> DataFrame:
    """(key, vec): tokens, token pairs and character triples of tokens, each a signed count in the dimension its digest names, scaled to length 1."""
    word = re.compile(r"[a-z0-9_]+")

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            toks = word.findall((t or "").lower())
            grams = [*toks, *(f"{a} {b}" for a, b in zip(toks, toks[1:], strict=False)), *(w[i : i + 3] for w in toks for i in range(len(w) - 2))]
            v = np.zeros(dims)
            for g in grams:
                h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big")
                v[h % dims] += 1.0 if (h >> 63) & 1 else -1.0
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).astype(np.float32))
        return pd.Series(out)

    return df.select(key, embed(F.col(text)).alias("vec"))


def diversified(df: DataFrame, query: str, key: str, score: str, vec: str, k: int, trade: float = 0.8) -> DataFrame:
    """(query, key, place): greedy choice of k candidates by score less likeness to those chosen. Groups are short top lists."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        x = np.array(pdf[vec].tolist(), dtype=np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        chosen: list[int] = []
        while len(chosen) < min(k, len(pdf)):
            like = (x @ x[chosen].T).max(axis=1) if chosen else np.zeros(len(pdf))
            gain = trade * pdf[score].to_numpy() - (1 - trade) * like
            gain[chosen] = -np.inf
            chosen.append(int(np.argmax(np.round(gain, 9))))
        return pd.DataFrame({query: pdf[query].iloc[0], key: pdf[key].iloc[chosen].to_numpy(), "place": np.arange(1, len(chosen) + 1)})

    return df.select(query, key, score, vec).groupBy(query).applyInPandas(choose, f"{query} bigint, {key} bigint, place bigint")


def ridge_head(df: DataFrame, vec: str, target: Column, ridge: float, epsilon: float = 1e-4) -> DataFrame:
    """(term, weight): least squares of the target's logit on all components, with an unpenalised bias.

    Targets are in 0..1, clipped by epsilon; rows without one are left out, and
    missing components are 0. Sums of products are aggregated by blocks of rows;
    only the (components + 2)^2 matrix reaches the driver.
    """
    p = F.least(F.greatest(target, F.lit(epsilon)), F.lit(1 - epsilon))
    known = df.where(target.isNotNull()).select(F.coalesce(F.col(vec).cast("array<double>"), F.array().cast("array<double>")).alias("x"), F.log(p / (1 - p)).alias("z"))
    dims = known.agg(F.max(F.size("x"))).head()[0]
    if dims is None:
        return df.sparkSession.createDataFrame([], "term string, weight double")
    size = dims + 2

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            row = np.zeros((b.num_rows, size))
            row[:, 0] = 1.0
            row[:, -1] = b.column(1).to_numpy()
            lists = b.column(0)
            n = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().fill_null(0.0).to_numpy()
            row[np.repeat(np.arange(len(n)), n), 1 + np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
            total += row.T @ row
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(size * size), pa.int64()), "s": pa.array(total.ravel())})

    sums = known.mapInArrow(gram, "i bigint, s double").groupBy("i").agg(F.sum("s").alias("s"))
    m = np.zeros(size * size)
    for r in sums.collect():
        m[r["i"]] = r["s"]
    m = m.reshape(size, size)
    pen = np.eye(size - 1) * ridge
    pen[0, 0] = 0.0
    w = np.linalg.solve(m[:-1, :-1] + pen, m[:-1, -1])
    return df.sparkSession.createDataFrame([("bias" if i == 0 else f"x{i}", round(float(v), 6)) for i, v in enumerate(w)], "term string, weight double")
