"""Queries of row programs: puzzles made from the tables, solved, and checked against the rule that made them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import solvers
from millrace.plans.registry import query


def puzzles(t, make, asked):
    """Puzzles of parts: examples of make() at three numbers that depend on the part, and a query."""
    xs = [F.col("p_partkey") % 40 + k for k in (3, 8, 21)]
    text = lambda c: c.cast("string")
    return t.part.select("p_partkey", F.array(*[text(x) for x in xs]).alias("inputs"), F.array(*[text(make(x)) for x in xs]).alias("outputs"), text(asked).alias("query"))


def _bits(c: Column) -> Column:
    return F.lpad(F.bin(c), 8, "0")


@query("udf04_bit_rules", "SELECT p_partkey, lpad(bin(xor(p_partkey % 200, p_partkey % 127 + 1)), 8, '0') AS answer FROM part")
def _(t):
    mask = F.col("p_partkey") % 127 + 1
    xs = [F.col("p_partkey") % 40 + k for k in (3, 8, 21)]
    p = t.part.select("p_partkey", F.array(*[_bits(x) for x in xs]).alias("inputs"), F.array(*[_bits(x.bitwiseXOR(mask)) for x in xs]).alias("outputs"), _bits(F.col("p_partkey") % 200).alias("query"))
    return solvers.solve(p, "p_partkey", ["bits"]).select("p_partkey", "answer")


@query("udf05_unit_fit", "SELECT p_partkey, ((p_partkey % 300) * (p_partkey % 9 + 2))::VARCHAR AS answer FROM part")
def _(t):
    scale = F.col("p_partkey") % 9 + 2
    return solvers.solve(puzzles(t, lambda x: x * scale, F.col("p_partkey") % 300), "p_partkey", ["number"]).select("p_partkey", "answer")


@query("udf06_formula_fit", "SELECT p_partkey, ((p_partkey % 60) * (p_partkey % 60) * (p_partkey % 5 + 2))::VARCHAR AS answer FROM part")
def _(t):
    scale = F.col("p_partkey") % 5 + 2
    return solvers.solve(puzzles(t, lambda x: x * x * scale, F.col("p_partkey") % 60), "p_partkey", ["number"]).select("p_partkey", "answer")


@query("udf10_roman_solver", "SELECT p_partkey, 'verified' AS reason, length(answer) > 0 AS answered FROM (SELECT p_partkey, 'x' AS answer FROM part)")
def _(t):
    s = solvers.solve(puzzles(t, tx.roman, F.col("p_partkey") % 3998 + 1), "p_partkey", ["roman"])
    return s.select("p_partkey", "reason", (F.char_length("answer") > 0).alias("answered"))


@query("udf19_sequence_solver", "SELECT p_partkey, (5 + (p_partkey % 11 + 1) * (p_partkey % 90))::VARCHAR AS answer FROM part")
def _(t):
    step = F.col("p_partkey") % 11 + 1
    return solvers.solve(puzzles(t, lambda x: 5 + step * x, F.col("p_partkey") % 90), "p_partkey", ["sequence"]).select("p_partkey", "answer")


@query("udf07_cipher_fit", "SELECT p_partkey, translate(p_name, 'abcdefghijklmnopqrstuvwxyz', substr('abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz', (p_partkey % 25 + 2)::INT, 26)) AS answer FROM part")
def _(t):
    a = "abcdefghijklmnopqrstuvwxyz"
    code = lambda c: F.expr(f"translate({c}, '{a}', substring('{a}{a}', CAST(p_partkey % 25 + 2 AS INT), 26))")
    p = t.part.select("p_partkey", F.array(F.lit("quick brown fox"), F.lit("lazy dogs")).alias("inputs"), F.array(code("'quick brown fox'"), code("'lazy dogs'")).alias("outputs"), F.col("p_name").alias("query"))
    return solvers.solve(p, "p_partkey", ["shift"]).select("p_partkey", "answer")


@query("udf09_symbol_map", "SELECT p_partkey, CASE WHEN regexp_matches((p_partkey % 500)::VARCHAR, '^[0-5]+$') THEN translate((p_partkey % 500)::VARCHAR, '012345', '@#$%&*') END AS answer FROM part")
def _(t):
    p = t.part.select("p_partkey", F.array(F.lit("0123"), F.lit("4520")).alias("inputs"), F.array(F.lit("@#$%"), F.lit("&*$@")).alias("outputs"), (F.col("p_partkey") % 500).cast("string").alias("query"))
    return solvers.solve(p, "p_partkey", ["map"]).select("p_partkey", "answer")


@query("udf02_ensemble")
def _(t):
    scale = F.col("p_partkey") % 9 + 2
    s = solvers.solve(puzzles(t, lambda x: x * scale, F.col("p_partkey") % 300), "p_partkey")
    return s.groupBy("solvers", "reason").agg(F.count("*").alias("n"), F.count("answer").alias("answered"))


@query("udf21_unique_verified", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS answer FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey")
def _(t):
    return t.orders.where("o_totalprice > 300000").groupBy("o_custkey").agg(F.when(F.count_distinct("o_orderstatus") == 1, F.min("o_orderstatus")).alias("answer"))


@query("udf12_dsl", "SELECT p_partkey, program, CASE program WHEN 'split|reverse|join:-' THEN string_split(p_name, ' ')[2] || '-' || string_split(p_name, ' ')[1] WHEN 'upper|mirror' THEN reverse(upper(p_name)) ELSE len(string_split(p_name, ' '))::VARCHAR END AS result FROM part, (VALUES ('split|reverse|join:-'), ('upper|mirror'), ('split|count')) v(program)")
def _(t):
    return solvers.run_programs(t.part, "p_partkey", "p_name", ["split|reverse|join:-", "upper|mirror", "split|count"])


@query("udf03_verifier", "SELECT p_partkey, round(0.5 + 0.3 * (p_size > 25)::INT + 0.2 * regexp_matches(p_name, '^[a-z ]+$')::INT, 6)::DOUBLE AS confidence, CASE WHEN p_retailprice > 1500 THEN 'high' ELSE 'low' END AS risk FROM part")
def _(t):
    c = 0.5 + 0.3 * (F.col("p_size") > 25).cast("int") + 0.2 * F.col("p_name").rlike("^[a-z ]+$").cast("int")
    return t.part.select("p_partkey", F.round(c, 6).alias("confidence"), F.when(F.col("p_retailprice") > 1500, "high").otherwise("low").alias("risk"))


@query("udf08_word_cipher", "WITH w AS (SELECT string_split(p_name, ' ')[1] AS a, string_split(p_type, ' ')[1] AS b FROM part) SELECT a AS word, count(DISTINCT b) AS targets, count(DISTINCT b) > 1 AS conflict, min(b) AS first_target FROM w GROUP BY a")
def _(t):
    w = t.part.select(F.element_at(F.split("p_name", " "), 1).alias("word"), F.element_at(F.split("p_type", " "), 1).alias("b"))
    n = F.count_distinct("b")
    return w.groupBy("word").agg(n.alias("targets"), (n > 1).alias("conflict"), F.min("b").alias("first_target"))


@query("udf24_mutations", "SELECT n_nationkey || '_' || m AS id, n_nationkey AS created_from, 'In ' || m || ': ' || n_name AS prompt, FALSE AS may_train FROM nation, (VALUES ('swap'), ('wrap')) v(m)")
def _(t):
    kinds = t.spark.createDataFrame([("swap",), ("wrap",)], "m string")
    j = t.nation.crossJoin(F.broadcast(kinds))
    return j.select(F.concat_ws("_", F.col("n_nationkey").cast("string"), "m").alias("id"), F.col("n_nationkey").alias("created_from"), F.concat(F.lit("In "), F.col("m"), F.lit(": "), F.col("n_name")).alias("prompt"), F.lit(False).alias("may_train"))


@query("udf25_generated", "SELECT i AS id, 'family_' || i % 4 AS family, (i * 37 + 11) % 1000 AS a, ((i * 37 + 11) % 1000) * (i % 4 + 2) AS answer FROM range(500) r(i)")
def _(t):
    r = t.spark.range(500)
    a = (F.col("id") * 37 + 11) % 1000
    return r.select("id", F.concat(F.lit("family_"), (F.col("id") % 4).cast("string")).alias("family"), a.alias("a"), (a * (F.col("id") % 4 + 2)).alias("answer"))
