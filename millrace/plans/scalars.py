"""Queries of scalar functions: text extraction, numbers, bits, Roman numerals, normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import answers
from millrace.functions import text as tx
from millrace.plans.registry import query


@query("str04_surface", r"SELECT doc_id, sha256(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '<tag>', 'g'), '\d+(?:\.\d+)?', '<num>', 'g'), '\b[01]+\b', '<bin>', 'g'), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')) AS surface FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2(tx.surface(F.col("text")), 256).alias("surface"))


@query("str06_digit_masked", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '\d+', '<NUM>', 'g'), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.digit_masked_hash(F.col("text")).alias("h"))


@query("str10_marker_position", "SELECT doc_id, CASE WHEN instr(lower(text), ' the ') = 0 AND instr(lower(text), ' of ') = 0 THEN 'none' WHEN least(coalesce(nullif(instr(lower(text), ' the '), 0), 1000000000), coalesce(nullif(instr(lower(text), ' of '), 0), 1000000000)) < n_chars / 3 THEN 'early' WHEN least(coalesce(nullif(instr(lower(text), ' the '), 0), 1000000000), coalesce(nullif(instr(lower(text), ' of '), 0), 1000000000)) < 2 * n_chars / 3 THEN 'middle' ELSE 'late' END AS place FROM documents")
def _(t):
    at = F.least(*[F.nullif(F.instr(F.lower("text"), m), F.lit(0)) for m in (" the ", " of ")])
    place = F.when(at.isNull(), "none").when(at < F.col("n_chars") / 3, "early").when(at < 2 * F.col("n_chars") / 3, "middle").otherwise("late")
    return t.documents.select("doc_id", place.alias("place"))


@query("str11_operator_signature", r"SELECT doc_id, (regexp_matches(text, '\d+\.\d+'))::INT::VARCHAR || (regexp_matches(text, '[01]{4,}'))::INT::VARCHAR || (contains(text, '->'))::INT::VARCHAR || (contains(text, '?'))::INT::VARCHAR || least(9, len(regexp_extract_all(text, '[@#$%&*]')))::VARCHAR AS signature FROM documents")
def _(t):
    flag = lambda c: c.cast("int").cast("string")
    c = F.col("text")
    return t.documents.select("doc_id", F.concat(flag(c.rlike(r"\d+\.\d+")), flag(c.rlike("[01]{4,}")), flag(c.contains("->")), flag(c.contains("?")), F.least(F.lit(9), F.regexp_count(c, F.lit("[@#$%&*]"))).cast("string")).alias("signature"))


@query("str15_loose_answer", r"SELECT doc_id, coalesce(nullif(regexp_extract(text, 'token = \"([0-9a-f]+)\"', 1), ''), nullif(regexp_extract(text, '(\d+\.\d+\.\d+\.\d+)', 1), ''), nullif(regexp_extract(text, '(-?\d+)', 1), ''), string_split(text, chr(10))[-1]) AS answer FROM documents")
def _(t):
    ladder = answers.loose(F.col("text"), r'token = "([0-9a-f]+)"', r"(\d+\.\d+\.\d+\.\d+)", r"(-?\d+)")
    return t.documents.select("doc_id", ladder.alias("answer"))


@query("str16_typed_answer", "SELECT p_partkey, p_size::VARCHAR AS int_form, printf('%.2f', p_retailprice) AS money_form, lpad(bin(p_partkey % 256), 8, '0') AS bit_form, upper(trim(p_brand)) AS text_form FROM part")
def _(t):
    n = (F.col("p_partkey") % 256).cast("long")
    return t.part.select("p_partkey", F.col("p_size").cast("string").alias("int_form"), F.format_string("%.2f", "p_retailprice").alias("money_form"), F.lpad(F.bin(n), 8, "0").alias("bit_form"), F.upper(F.trim("p_brand")).alias("text_form"))


@query("str18_answers_match", "SELECT o_orderkey, abs(o_totalprice - round(o_totalprice, 1)) <= 0.02 AS close, o_totalprice::VARCHAR = round(o_totalprice, 1)::VARCHAR AS equal FROM orders")
def _(t):
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", (F.abs(p - F.round(p, 1)) <= 0.02).alias("close"), (p == F.round(p, 1)).alias("equal"))


@query("str21_unicode_nfkc")
def _(t):
    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return t.documents.select("doc_id", F.sha2(nfkc("text"), 256).alias("nfkc"))


@query("str13_boxed")
def _(t):
    wrapped = F.concat(F.lit("so \\boxed{"), F.col("text"), F.lit("{"), F.col("lang"), F.lit("}} end"))
    return t.documents.select("doc_id", answers.boxed(wrapped).alias("boxed"))


@query("str24_domain", r"SELECT item_id, CASE WHEN regexp_matches(text, '\d+/\d+') THEN 'fraction' WHEN regexp_matches(text, '\d+\.\d+') THEN 'decimal' WHEN regexp_matches(text, '[01]{6,}') THEN 'bits' WHEN regexp_matches(text, '\d') THEN 'digits' WHEN regexp_matches(text, '[@#$%&*]') THEN 'symbols' ELSE 'tokens' END AS domain FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", tx.first_match(F.col("text"), (r"\d+/\d+", "fraction"), (r"\d+\.\d+", "decimal"), ("[01]{6,}", "bits"), (r"\d", "digits"), ("[@#$%&*]", "symbols"), default="tokens").alias("domain"))


@query("str23_line_parser", r"SELECT doc_id, len(l) AS lines, len(list_filter(l, lambda x: regexp_matches(x, '^[A-Z]'))) AS capital, len(list_filter(l, lambda x: length(x) > 100)) AS long_ FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def _(t):
    l = F.split("text", "\n", -1)
    return t.documents.select("doc_id", F.size(l).cast("long").alias("lines"), F.size(F.filter(l, lambda x: x.rlike("^[A-Z]"))).cast("long").alias("capital"), F.size(F.filter(l, lambda x: F.char_length(x) > 100)).cast("long").alias("long_"))


@query("str26_leak_markers", r"SELECT d.doc_id, contains(lower(d.text), l.quality::VARCHAR) AS holds_label, regexp_matches(d.text, 'Licensed|token|secret') AS marker FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    return t.documents.join(t.labels, "doc_id").select("doc_id", F.contains(F.lower("text"), F.col("quality").cast("string")).alias("holds_label"), F.col("text").rlike("Licensed|token|secret").alias("marker"))


@query("str27_numbers", r"SELECT doc_id, len(n) AS found, list_max(list_transform(n, lambda x: length(regexp_extract(x, '\.(\d+)', 1)))) AS precision_ FROM (SELECT doc_id, regexp_extract_all(text, '\d+(?:\.\d+)?') AS n FROM documents) WHERE len(n) > 0")
def _(t):
    n = F.regexp_extract_all("text", F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    d = t.documents.select("doc_id", n.alias("n")).where(F.size("n") > 0)
    return d.select("doc_id", F.size("n").cast("long").alias("found"), F.array_max(F.transform("n", lambda x: F.char_length(F.regexp_extract(x, r"\.(\d+)", 1)))).cast("long").alias("precision_"))


_R = lambda c, k: f"(['', '{k[0]}', '{k[0] * 2}', '{k[0] * 3}', '{k[0] + k[1]}', '{k[1]}', '{k[1] + k[0]}', '{k[1] + k[0] * 2}', '{k[1] + k[0] * 3}', '{k[0] + k[2]}'])[{c} + 1]"


@query("str28_roman", "SELECT p_partkey, CASE WHEN n BETWEEN 1 AND 3999 THEN repeat('M', (n // 1000)::INT) || " + _R("n // 100 % 10", "CDM") + " || " + _R("n // 10 % 10", "XLC") + " || " + _R("n % 10", "IVX") + " END AS roman FROM (SELECT p_partkey, p_partkey * 7 % 4100 AS n FROM part)")
def _(t):
    n = F.col("p_partkey") * 7 % 4100
    return t.part.select("p_partkey", tx.roman(n).alias("roman"))


@query("str30_coercion", "WITH a AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN ' ' || o_orderkey || '.0' WHEN 2 THEN 'true' WHEN 3 THEN '1.5' ELSE '-3' END AS s FROM orders) SELECT o_orderkey, CASE WHEN regexp_matches(trim(s), '^[+-]?\\d+(\\.0+)?$') AND trim(s)::DOUBLE BETWEEN 0 AND 99999 THEN trim(s)::DOUBLE::BIGINT END AS answer FROM a")
def _(t):
    k = F.col("o_orderkey").cast("string")
    s = F.when(F.col("o_orderkey") % 5 == 0, k).when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit(" "), k, F.lit(".0"))).when(F.col("o_orderkey") % 5 == 2, "true").when(F.col("o_orderkey") % 5 == 3, "1.5").otherwise("-3")
    return t.orders.select("o_orderkey", answers.whole_number(s, 0, 99999).alias("answer"))


@query("flt12_submission", "WITH a AS (SELECT o_orderkey % 4000 AS id, CASE WHEN o_orderkey % 97 = 0 THEN 'x' ELSE (o_orderkey % 120000)::VARCHAR END AS answer, o_orderkey AS pos FROM orders) SELECT code, count(*) AS n FROM (SELECT CASE WHEN try_cast(answer AS BIGINT) IS NULL THEN 'not_a_number' WHEN try_cast(answer AS BIGINT) NOT BETWEEN 0 AND 99999 THEN 'out_of_range' WHEN row_number() OVER (PARTITION BY id ORDER BY pos) > 1 THEN 'duplicate_id' ELSE 'ok' END AS code FROM a) GROUP BY code")
def _(t):
    a = t.orders.select((F.col("o_orderkey") % 4000).alias("id"), F.when(F.col("o_orderkey") % 97 == 0, "x").otherwise((F.col("o_orderkey") % 120000).cast("string")).alias("answer"), F.col("o_orderkey").alias("pos"))
    n = F.expr("try_cast(answer AS BIGINT)")
    code = F.when(n.isNull(), "not_a_number").when(~n.between(0, 99999), "out_of_range").when(F.row_number().over(Window.partitionBy("id").orderBy("pos")) > 1, "duplicate_id").otherwise("ok")
    return a.select(code.alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("mth09_bits", "SELECT p_partkey, xor(n, 90) AS x, n & 60 AS a, n | 3 AS o, 255 - n AS inv, ((n << 3) & 255) | (n >> 5) AS rotated, reverse(lpad(bin(n), 8, '0')) AS mirrored FROM (SELECT p_partkey, (p_partkey % 256) AS n FROM part)")
def _(t):
    n = F.col("p_partkey") % 256
    bits = lambda c: c.cast("long")
    return t.part.select(
        "p_partkey", n.bitwiseXOR(F.lit(90)).alias("x"), n.bitwiseAND(F.lit(60)).alias("a"), n.bitwiseOR(F.lit(3)).alias("o"), bits(255 - n).alias("inv"),
        F.shiftleft(n, 3).bitwiseAND(F.lit(255)).bitwiseOR(F.shiftright(n, 5)).alias("rotated"), F.reverse(F.lpad(F.bin(n), 8, "0")).alias("mirrored"),
    )


@query("mth10_decimal_format", "SELECT l_orderkey, l_linenumber, round(l_extendedprice::DECIMAL(18, 4) / 1, 1)::DECIMAL(18, 1)::VARCHAR AS one_place FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice").cast("decimal(18,4)"), 1).cast("decimal(18,1)").cast("string").alias("one_place"))


@query("jsn01_safe_json", "SELECT c_custkey, '{\"bal\":' || CASE WHEN c_acctbal < 0 THEN '\"NaN\"' ELSE floor(c_acctbal)::BIGINT::VARCHAR END || ',\"name\":\"' || c_name || '\"}' AS js FROM customer")
def _(t):
    bal = F.when(F.col("c_acctbal") < 0, '"NaN"').otherwise(F.floor("c_acctbal").cast("string"))
    return t.customer.select("c_custkey", F.concat(F.lit('{"bal":'), bal, F.lit(',"name":"'), F.col("c_name"), F.lit('"}')).alias("js"))


@query("set04_merge_unique", "SELECT conv_id, array_to_string(list_transform(list_sort(list({'k': k, 'role': role})), lambda x: x.role), ',') AS roles FROM (SELECT conv_id, role, min(turn) AS k FROM conversations WHERE trim(role) <> '' GROUP BY conv_id, role) GROUP BY conv_id")
def _(t):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.trim(x["role"]))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.slice(F.array_distinct(F.filter(turns, lambda x: x != "")), 1, 5), ",").alias("roles"))


@query("prj11_failure_taxonomy", r"SELECT CASE WHEN toxic = 1 THEN 'unsafe' WHEN quality = 0 AND n_chars < 300 THEN 'too_short' WHEN quality = 0 AND regexp_matches(text, '\d{5,}') THEN 'numeric_noise' WHEN quality = 0 AND lang <> 'en' THEN 'language' WHEN quality = 0 THEN 'other' ELSE 'none' END AS class, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def _(t):
    bad = F.col("quality") == 0
    c = F.when(F.col("toxic") == 1, "unsafe").when(bad & (F.col("n_chars") < 300), "too_short").when(bad & F.col("text").rlike(r"\d{5,}"), "numeric_noise").when(bad & (F.col("lang") != "en"), "language").when(bad, "other").otherwise("none")
    return t.documents.join(t.labels, "doc_id").groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query("html_links", r"SELECT page_id, len(regexp_extract_all(html, '<a\s+href=')) AS links, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def _(t):
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return t.pages.select("page_id", count(r"<a\s+href=").alias("links"), count("<p>").alias("paragraphs"))

