"""Queries of similarity, retrieval and clustering over embeddings, documents and benchmark."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import numbers as num
from millrace.functions import text as tx
from millrace.operators import measures, retrieve
from millrace.plans.registry import query
from millrace.sources import writers

_COS = "list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / nullif(sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 0)"
_TOP = f"SELECT q.vec_id AS query_id, e.vec_id, e.label, q.label AS query_label, round({_COS}, 6) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id"


def _neighbours(t, k=5):
    """The k nearest of each query row, by rounded cosine, ties to the smaller id."""
    return retrieve.dense_top_k(t.embeddings, F.col("vec_id") % 50 == 0, "vec_id", "embedding", k, "label")


@query("top02_dense_top_k", f"WITH s AS ({_TOP}) SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5")
def _(t):
    return _neighbours(t).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query("ret02_cosine_to_centroid", """
WITH d AS (SELECT label, i, avg(x) AS c FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
c AS (SELECT label, list(c ORDER BY i) AS c FROM d GROUP BY label)
SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], c) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(c, c))), 5) AS cosine FROM embeddings JOIN c USING (label)""")
def _(t):
    # One row a label: a third of all rows with one label is summed by component first.
    d = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    c = d.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"))
    return t.embeddings.join(c, "label").select("vec_id", F.round(num.cosine(F.col("embedding"), F.col("c")), 5).alias("cosine"))


@query("evl07_knn_vote", f"""
WITH s AS ({_TOP}), r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5),
v AS (SELECT query_id, query_label, label, count(*) AS n FROM r GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS k FROM v)
SELECT query_id, label::BIGINT AS vote, n::DOUBLE / 5 AS agreement, label = query_label AS correct FROM w WHERE k = 1""")
def _(t):
    n = _neighbours(t).groupBy("query_id", "query_label", "label").agg(F.count("*").alias("n"))
    best = n.groupBy("query_id", "query_label").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b"))
    return best.select("query_id", F.col("b.label").alias("vote"), (-F.col("b.m") / 5).alias("agreement"), (F.col("b.label") == F.col("query_label")).alias("correct"))


@query("evl05_vote_calibration", f"""
WITH s AS ({_TOP}), r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5),
v AS (SELECT query_id, query_label, label, count(*) AS n FROM r GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS k FROM v),
p AS (SELECT n::DOUBLE / 5 AS p, (label = query_label)::INT AS y FROM w WHERE k = 1), g AS (SELECT least(4, floor(p * 5)) AS b, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum((p - y) ** 2) AS sb, sum(((p >= 0.5) = (y >= 0.5))::INT) AS hit FROM p GROUP BY 1)
SELECT sum(n)::BIGINT AS n, round(sum(hit) / sum(n), 6) AS accuracy, round(sum(sb) / sum(n), 6) AS brier, round(sum(abs(sp - sy)) / sum(n), 6) AS ece, round(max(abs(sp - sy) / n), 6) AS mce FROM g""")
def _(t):
    n = _neighbours(t).groupBy("query_id", "query_label", "label").agg(F.count("*").alias("n"))
    best = n.groupBy("query_id", "query_label").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b"))
    return measures.calibration_errors(best, -F.col("b.m") / 5, (F.col("b.label") == F.col("query_label")).cast("int"), 5)


@query("ret10_retrieval_quality", f"WITH s AS ({_TOP}), r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5) SELECT query_id, round(avg(score), 5) AS mean, max(score) AS top, count(DISTINCT label) AS diversity FROM r GROUP BY query_id")
def _(t):
    return _neighbours(t).groupBy("query_id").agg(F.round(F.avg("score"), 5).alias("mean"), F.max("score").alias("top"), F.count_distinct("label").alias("diversity"))


@query("ret08_support_sum", f"WITH s AS ({_TOP}), r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5), g AS (SELECT query_id, label, sum(score) AS w FROM r GROUP BY ALL) SELECT query_id, label::BIGINT AS label, round(w / sum(w) OVER (PARTITION BY query_id), 5) AS support FROM g")
def _(t):
    g = _neighbours(t).groupBy("query_id", "label").agg(F.sum("score").alias("w"))
    return g.select("query_id", "label", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("query_id")), 5).alias("support"))


_TOK = r"list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))"
_LEX = f"""
d AS (SELECT doc_id, {_TOK} AS w FROM documents), b AS (SELECT item_id, {_TOK} AS w FROM benchmark),
dt AS (SELECT doc_id, unnest(w) AS tok FROM d), bt AS (SELECT item_id, unnest(w) AS tok FROM b),
x AS (SELECT item_id, doc_id, count(*) AS both_ FROM bt JOIN dt USING (tok) GROUP BY ALL),
lex AS (SELECT x.item_id, x.doc_id, round(both_::DOUBLE / (len(b.w) + len(d.w) - both_), 6) AS score FROM x JOIN d USING (doc_id) JOIN b USING (item_id))"""


def _lexical(t):
    return retrieve.lexical_scores(t.benchmark, t.documents, "item_id", "doc_id", "text")


@query("top03_lexical_top_k", f"WITH {_LEX} SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM lex QUALIFY rank <= 5")
def _(t):
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return _lexical(t).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5")


_PAIRS = f"b AS (SELECT item_id, {_TOK} AS w FROM benchmark), p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) AS score FROM b a JOIN b ON a.item_id < b.item_id)"


@query("nbk19_pairwise_jaccard", f"WITH {_PAIRS} SELECT a, b, round(score, 6) AS score FROM p WHERE score > 0")
def _(t):
    other = t.benchmark.select(F.col("item_id").alias("other_id"), "text")
    s = retrieve.lexical_scores(t.benchmark, other, "item_id", "other_id", "text").where("item_id < other_id")
    return s.select(F.col("item_id").alias("a"), F.col("other_id").alias("b"), "score")


@query("nbk20_threshold_clusters", f"WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM p WHERE score >= 0.4 UNION SELECT b, a FROM p WHERE score >= 0.4), r AS (SELECT item_id AS n, item_id AS m FROM benchmark UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a) SELECT n AS item_id, min(m) AS cluster FROM r GROUP BY n")
def _(t):
    sets = t.benchmark.select("item_id", F.array_distinct(tx.tokens(F.col("text"))).alias("w"))
    return retrieve.threshold_clusters(sets, "item_id", "w", 0.4)


@query("jn22_outer_fusion", f"""
WITH {_LEX}, l AS (SELECT * FROM lex QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 5),
s AS (SELECT b.item_id, d.doc_id, round(1 - abs(length(b.text) - d.n_chars)::DOUBLE / greatest(length(b.text), d.n_chars), 6) AS score FROM benchmark b JOIN documents d ON abs(length(b.text) - d.n_chars) <= 3)
SELECT coalesce(l.item_id, s.item_id) AS item_id, coalesce(l.doc_id, s.doc_id) AS doc_id, round(0.6 * coalesce(l.score, 0) + 0.4 * coalesce(s.score, 0), 6) AS fused FROM l FULL JOIN s ON l.item_id = s.item_id AND l.doc_id = s.doc_id""")
def _(t):
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    l = _lexical(t).withColumn("r", F.row_number().over(w)).where("r <= 5").select("item_id", "doc_id", F.col("score").alias("lexical"))
    s = retrieve.length_scores(t.benchmark, t.documents, "item_id", "doc_id", "text", "n_chars", 3).withColumnRenamed("score", "shape")
    fused = 0.6 * F.coalesce("lexical", F.lit(0.0)) + 0.4 * F.coalesce("shape", F.lit(0.0))
    return l.join(s, ["item_id", "doc_id"], "full").select("item_id", "doc_id", F.round(fused, 6).alias("fused"))


@query("ret05_confidence_gate", f"""
WITH {_LEX}, l AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM lex QUALIFY r <= 5)
SELECT item_id, doc_id, round(score + CASE WHEN r = 1 THEN 0.05 ELSE 0 END + CASE WHEN score > 0.2 THEN 0.03 ELSE 0 END, 6) AS confidence FROM l WHERE score + CASE WHEN r = 1 THEN 0.05 ELSE 0 END + CASE WHEN score > 0.2 THEN 0.03 ELSE 0 END >= 0.12""")
def _(t):
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    l = _lexical(t).withColumn("r", F.row_number().over(w)).where("r <= 5")
    c = F.col("score") + F.when(F.col("r") == 1, 0.05).otherwise(0.0) + F.when(F.col("score") > 0.2, 0.03).otherwise(0.0)
    return l.where(c >= 0.12).select("item_id", "doc_id", F.round(c, 6).alias("confidence"))


@query("ret07_position_support", r"WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w, regexp_extract_all(lower(text), '[a-z0-9_]+') AS a FROM benchmark) SELECT item_id, len(a) AS tokens, round(list_sum(list_transform(range(len(a)), lambda i: 1.0::DOUBLE / (1 + i))), 6) AS weight FROM t")
def _(t):
    a = tx.tokens(F.col("text"))
    return t.benchmark.select("item_id", F.size(a).cast("long").alias("tokens"), F.round(F.aggregate(F.transform(a, lambda x, i: 1 / (1 + i)), F.lit(0.0), lambda s, v: s + v), 6).alias("weight"))


@query("top04_structural_top_k", "SELECT a.p_partkey AS query_id, b.p_partkey, round(0.35 * (a.p_type = b.p_type)::INT + 0.25 * (a.p_brand = b.p_brand)::INT + 0.4 * (1 - abs(a.p_size - b.p_size) / 50.0), 6)::DOUBLE AS score FROM part a JOIN part b ON a.p_partkey % 50 = 0 AND a.p_partkey <> b.p_partkey QUALIFY row_number() OVER (PARTITION BY a.p_partkey ORDER BY score DESC, b.p_partkey) <= 3")
def _(t):
    return retrieve.structural_top_k(t.part, F.col("p_partkey") % 50 == 0, "p_partkey", {"p_type": 0.35, "p_brand": 0.25}, "p_size", 0.4, 50.0, 3)


@query("agg21_cluster_summary", "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, round(n::DOUBLE / sum(n) OVER (), 6) AS share, n >= 30 AS promoted FROM n")
def _(t):
    s = measures.shares(t.embeddings, "label")
    return s.select("label", "n", "share", (F.col("n") >= 30).alias("promoted"))


@query("ret03_index_build", r"SELECT source, count(*) AS n, sum(('0x' || substr(sha256(doc_id::VARCHAR), 1, 12))::BIGINT)::VARCHAR AS fingerprint, sum(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))))::BIGINT AS postings FROM documents GROUP BY source")
def _(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), writers.head_sum(F.col("doc_id").cast("string")).alias("fingerprint"), F.sum(F.size(F.array_distinct(tx.tokens(F.col("text"))))).alias("postings"))


@query("ret01_hash_embedding")
def _(t):
    return retrieve.hash_embedding(t.benchmark, "item_id", "text")


@query("top05_mmr")
def _(t):
    return retrieve.diversified(_neighbours(t, 20).join(t.embeddings.select("vec_id", "embedding"), "vec_id"), "query_id", "vec_id", "score", "embedding", 5)


@query("evl10_ridge_head")
def _(t):
    return retrieve.ridge_head(t.embeddings, "embedding", F.col("label") / 9, 0.1)
