"""Queries of the remaining operators: sinks, parsers, fusion, selection scores, solver families."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import canonical
from millrace.functions import numbers as num
from millrace.functions import text as tx
from millrace.operators import retrieve, rows, solvers
from millrace.plans.files import folder
from millrace.plans.programs import puzzles
from millrace.plans.registry import query
from millrace.plans.retrieval import _LEX
from millrace.streaming import streams


@query("snk03_append_writer", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    path = folder(t, "appended")
    t.events.select("event_id", "event_type").write.parquet(f"{path}/in")
    stream = t.spark.readStream.schema("event_id bigint, event_type string").parquet(f"{path}/in")
    stream.writeStream.format("json").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("event_id bigint, event_type string").json(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("snk07_json_sink", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(t):
    path = folder(t, "suppliers")
    t.supplier.select("s_suppkey", "s_name", "s_acctbal").write.json(path)
    return t.spark.read.schema("s_suppkey bigint, s_name string, s_acctbal double").json(path)


@query("src11_file_discovery", "SELECT TRUE AS found")
def _(t):
    files = t.spark.read.format("binaryFile").load(f"{t.folder}/region.parquet").select("length")
    return files.agg((F.sum("length") > 0).alias("found"))


@query("str09_numeric_template", r"SELECT item_id, array_to_string(list_transform(string_split(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'), ' ')[1:24], lambda x: CASE WHEN regexp_matches(x, '^[-+]?\d+(\.\d+)?$') THEN '0' ELSE x END), ' ') AS template FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", tx.numeric_template(F.col("text")).alias("template"))


@query("str19_latex", "SELECT p_partkey, p_size || '/7+sqrt(' || p_partkey % 50 || ')' AS plain FROM part")
def _(t):
    raw = F.concat(F.lit("$\\frac{"), F.col("p_size").cast("string"), F.lit("}{7} + \\sqrt{"), (F.col("p_partkey") % 50).cast("string"), F.lit("}$"))
    return t.part.select("p_partkey", canonical.latex(raw).alias("plain"))


@query("str25_round_trip", r"WITH b AS (SELECT item_id, lower(text) AS t, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM benchmark) SELECT item_id, round(len(list_filter(w, lambda x: contains(t, ' ' || x || ' ')))::DOUBLE / len(w), 6) AS score FROM b")
def _(t):
    low = F.lower("text")
    b = t.benchmark.select("item_id", low.alias("t"), F.array_distinct(tx.tokens(F.col("text"))).alias("w"))
    hit = F.filter("w", lambda x: F.contains(F.col("t"), F.concat(F.lit(" "), x, F.lit(" "))))
    return b.select("item_id", F.round(F.size(hit) / F.size("w"), 6).alias("score"))


@query("str29_constraints", r"SELECT item_id, len(string_split(text, '.')) - 1 AS sentences, len(string_split(text, ',')) - 1 AS commas, len(regexp_extract_all(text, '\d+')) AS numbers FROM benchmark")
def _(t):
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return t.benchmark.select("item_id", count(r"\.").alias("sentences"), count(",").alias("commas"), count(r"\d+").alias("numbers"))


@query("ret04_hybrid_fusion", f"""
WITH {_LEX}, l AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM lex QUALIFY r <= 8)
SELECT l.item_id, l.doc_id, round(0.42 * l.score + 0.23 / l.r + 0.35 * coalesce(b.quality, 0), 6)::DOUBLE AS fused FROM l LEFT JOIN labels b ON l.doc_id = b.doc_id""")
def _(t):
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    l = retrieve.lexical_scores(t.benchmark, t.documents, "item_id", "doc_id", "text").withColumn("r", F.row_number().over(w)).where("r <= 8")
    j = l.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return j.select("item_id", "doc_id", F.round(0.42 * F.col("score") + 0.23 / F.col("r") + 0.35 * F.coalesce("quality", F.lit(0)), 6).alias("fused"))


@query("ret09_query_facets", r"WITH b AS (SELECT item_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}'))) AS w FROM benchmark) SELECT item_id, len(w) AS facets, array_to_string(w, ',') AS names FROM b")
def _(t):
    w = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0))))
    return t.benchmark.select("item_id", F.size(w).cast("long").alias("facets"), F.array_join(w, ",").alias("names"))


@query("smp17_parent_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY r, source NULLS LAST) AS place FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents)) WHERE place <= 90")
def _(t):
    return rows.interleaved(t.documents, "source", [F.desc("n_chars"), "doc_id"], 90).select("doc_id")


@query("evl08_final_selection", "WITH c AS (SELECT o_custkey, o_orderstatus, count(*) + 0.1 * max(o_totalprice) / 500000 - 0.05 * min(o_orderkey % 3) AS s FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY round(s, 6) DESC, o_orderstatus) AS r, count(*) OVER (PARTITION BY o_custkey) AS k FROM c) SELECT o_custkey, o_orderstatus AS chosen, k > 2 AS disputed FROM r WHERE r = 1")
def _(t):
    s = F.count("*") + 0.1 * F.max("o_totalprice") / 500000 - 0.05 * F.min(F.col("o_orderkey") % 3)
    c = t.orders.groupBy("o_custkey", "o_orderstatus").agg(s.alias("s"))
    best = F.min(F.struct((-F.round("s", 6)).alias("m"), "o_orderstatus"))
    return c.groupBy("o_custkey").agg(best.alias("b"), (F.count("*") > 2).alias("disputed")).select("o_custkey", F.col("b.o_orderstatus").alias("chosen"), "disputed")


@query("evl15_verifier_bundle", "SELECT event_id, round(0.5 * least(1.0, value / 200) + 0.3 * (event_type <> 'error')::INT + 0.2 * (user_id % 2), 6)::DOUBLE AS score, CASE WHEN event_type = 'error' THEN 'distrust' WHEN value > 100 THEN 'trust' ELSE 'check' END AS policy FROM events")
def _(t):
    s = 0.5 * F.least(F.lit(1.0), F.col("value") / 200) + 0.3 * (F.col("event_type") != "error").cast("int") + 0.2 * (F.col("user_id") % 2)
    return t.events.select("event_id", F.round(s, 6).alias("score"), F.when(F.col("event_type") == "error", "distrust").when(F.col("value") > 100, "trust").otherwise("check").alias("policy"))


@query("evl17_domain_prediction", r"WITH s AS (SELECT item_id, len(regexp_extract_all(lower(text), '\b(the|of|and)\b')) + 1 AS en, len(regexp_extract_all(lower(text), '\b(der|die|das)\b')) + 1 AS de, len(regexp_extract_all(lower(text), '\b(les|des|une)\b')) + 1 AS fr FROM benchmark) SELECT item_id, CASE WHEN en >= de AND en >= fr THEN 'en' WHEN de >= fr THEN 'de' ELSE 'fr' END AS domain, round(greatest(en, de, fr)::DOUBLE / (en + de + fr), 6) AS confidence FROM s")
def _(t):
    cue = lambda p: F.regexp_count(F.lower("text"), F.lit(rf"(?<![A-Za-z0-9_])({p})(?![A-Za-z0-9_])")) + 1
    s = t.benchmark.select("item_id", cue("the|of|and").alias("en"), cue("der|die|das").alias("de"), cue("les|des|une").alias("fr"))
    top = F.when((F.col("en") >= F.col("de")) & (F.col("en") >= F.col("fr")), "en").when(F.col("de") >= F.col("fr"), "de").otherwise("fr")
    return s.select("item_id", top.alias("domain"), F.round(F.greatest("en", "de", "fr") / (F.col("en") + F.col("de") + F.col("fr")), 6).alias("confidence"))


@query("evl19_branch_failures", "SELECT CASE WHEN event_type = 'error' AND value > 100 THEN 'expensive_error' WHEN event_type = 'error' THEN 'error' WHEN value < 1 THEN 'no_gain' ELSE 'none' END AS failure, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def _(t):
    err = F.col("event_type") == "error"
    f = F.when(err & (F.col("value") > 100), "expensive_error").when(err, "error").when(F.col("value") < 1, "no_gain").otherwise("none")
    return t.events.groupBy(f.alias("failure")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("udf01_solver_interface", "SELECT p_partkey, NULL::VARCHAR AS answer, 'no_rule' AS reason FROM part")
def _(t):
    p = t.part.select("p_partkey", F.array(F.lit("a"), F.lit("b")).alias("inputs"), F.array(F.lit("xx"), F.lit("y")).alias("outputs"), F.col("p_name").alias("query"))
    return solvers.solve(p, "p_partkey").select("p_partkey", "answer", "reason")


@query("udf11_format_only", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size::VARCHAR END AS answer FROM part")
def _(t):
    said = F.when(F.col("p_size") % 4 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" or so, I think"))).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")))
    return t.part.select("p_partkey", F.when(F.trim(said).rlike(r"^\d+$"), F.trim(said)).alias("answer"))


@query("udf15_bit_composition", "SELECT p_partkey, translate(substr(b, 4) || substr(b, 1, 3), '01', '10') AS answer FROM (SELECT p_partkey, lpad(bin(p_partkey % 200), 8, '0') AS b FROM part)")
def _(t):
    bits = lambda c: F.lpad(F.bin(c), 8, "0")
    rule = lambda b: F.translate(F.concat(F.substring(b, 4, 5), F.substring(b, 1, 3)), "01", "10")
    xs = [F.lit(k) for k in (11, 37, 150, 201)]
    p = t.part.select("p_partkey", F.array(*[bits(x) for x in xs]).alias("inputs"), F.array(*[rule(bits(x)) for x in xs]).alias("outputs"), bits(F.col("p_partkey") % 200).alias("query"))
    return solvers.solve(p, "p_partkey", ["bits"]).select("p_partkey", "answer")


@query("udf16_equation_search", "SELECT p_partkey, ((p_partkey % 7 + 1) * (p_partkey % 500) + p_partkey % 13)::VARCHAR AS answer FROM part")
def _(t):
    m, b = F.col("p_partkey") % 7 + 1, F.col("p_partkey") % 13
    return solvers.solve(puzzles(t, lambda x: m * x + b, F.col("p_partkey") % 500), "p_partkey", ["number"]).select("p_partkey", "answer")


@query("udf17_unit_solver", "SELECT p_partkey, printf('%.1f', (p_partkey % 300) * 2.5) AS answer FROM part")
def _(t):
    return solvers.solve(puzzles(t, lambda x: F.format_string("%.1f", x * F.lit(2.5)), F.col("p_partkey") % 300), "p_partkey", ["number"]).select("p_partkey", "answer")


@query("udf18_cipher_solver", "SELECT p_partkey, reverse(p_name) AS answer FROM part")
def _(t):
    p = t.part.select("p_partkey", F.array(F.lit("quick brown"), F.lit("fox")).alias("inputs"), F.array(F.lit("nworb kciuq"), F.lit("xof")).alias("outputs"), F.col("p_name").alias("query"))
    return solvers.solve(p, "p_partkey", ["shift"]).select("p_partkey", "answer")


@query("udf20_ratio_solver", "SELECT p_partkey, ((p_partkey % 5 + 2) * pow(p_partkey % 3 + 2, 5)::BIGINT)::VARCHAR AS answer FROM part")
def _(t):
    first, ratio = F.col("p_partkey") % 5 + 2, F.col("p_partkey") % 3 + 2
    text = lambda k: (first * F.pow(ratio, F.lit(k)).cast("long")).cast("string")
    p = t.part.select("p_partkey", F.array(*[F.lit(str(k)) for k in (1, 2, 3)]).alias("inputs"), F.array(*[text(k) for k in (0, 1, 2)]).alias("outputs"), F.lit("6").alias("query"))
    return solvers.solve(p, "p_partkey", ["sequence"]).select("p_partkey", "answer")


@query("udf23_generator", "SELECT n_nationkey::BIGINT AS seed, i AS k, (n_nationkey * 31 + i * 17) % 97 AS value FROM nation, range(5) r(i)")
def _(t):
    r = t.nation.select(F.col("n_nationkey").cast("long").alias("seed"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("k"))
    return r.select("seed", "k", ((F.col("seed") * 31 + F.col("k") * 17) % 97).alias("value"))


@query("event_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS c FROM events), s AS (SELECT user_id, ts, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def _(t):
    return streams.sessions(t.events, "6 hours")


@query("mth_share_check", "SELECT l_returnflag, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY l_returnflag")
def _(t):
    n = t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return n.select("l_returnflag", F.round(num.ratio(F.col("n"), F.sum("n").over(Window.partitionBy())), 6).alias("share"))
