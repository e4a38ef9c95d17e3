"""Queries of the corpus build over documents, labels and benchmark."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import numbers as num
from millrace.functions import text as tx
from millrace.operators import measures, rows, sets
from millrace.operators.grouping import grouping_sets
from millrace.operators.ordering import positions
from millrace.plans.registry import Tables, query

#: The SQL twins of the column builders.
NORM = r"regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')"
SURF = NORM.format(r"regexp_replace(regexp_replace(regexp_replace({0}, '<[^>]+>', '<tag>', 'g'), '\d+(?:\.\d+)?', '<num>', 'g'), '\b[01]+\b', '<bin>', 'g')")
TPL = NORM.format(r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\b[01]{{4,}}\b', '<BIN>', 'g'), '\b[IVXLCDM]{{2,}}\b', '<ROMAN>', 'g'), '"[^"]*"', '<PHRASE>', 'g'), '[-+]?\d+(?:\.\d+)?', '<NUM>', 'g'), '[@#$%^&*]+', '<SYM>', 'g')""")


def unit(salt: str, c: str) -> str:
    return f"(('0x' || substr(sha1('{salt}::' || {c}::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967295.0)"


SPLIT = f"CASE WHEN {unit('split', 'doc_id')} < 0.8 THEN 'train' WHEN {unit('split', 'doc_id')} < 0.9 THEN 'dev' ELSE 'holdout' END"
SHARES = {"train": 0.8, "dev": 0.1, "holdout": 0.1}


def split_of(c):
    return rows.split_by_hash(num.salted_unit("split", c), SHARES)


CODE = "CASE WHEN doc_id IS NULL THEN 'missing_id' WHEN text IS NULL OR trim(text) = '' THEN 'missing_text' WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unknown_lang' WHEN n_chars <> length(text) THEN 'wrong_size' WHEN n_chars < 100 THEN 'too_short' END"


def code():
    c = F.col
    return rows.error_code(
        ("missing_id", c("doc_id").isNull()), ("missing_text", c("text").isNull() | (F.trim("text") == "")), ("unknown_lang", ~c("lang").isin("en", "de", "fr")),
        ("wrong_size", c("n_chars") != F.char_length("text")), ("too_short", c("n_chars") < 100),
    )


BUILD = f"""
WITH coded AS (SELECT *, {CODE} AS code FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, sha256({NORM.format('text')}) ORDER BY doc_id) AS r FROM coded WHERE code IS NULL),
kept AS (SELECT doc_id, lang, source, {SPLIT} AS split FROM ranked WHERE r = 1)"""


def build(t: Tables):
    """Valid rows, the first of each text in its language, with their split."""
    valid = t.documents.where(code().isNull()).withColumn("h", tx.text_hash(F.col("text")))
    return rows.first_wins(valid, ["lang", "h"], ["doc_id"]).withColumn("split", split_of(F.col("doc_id")))


@query("corpus_build", BUILD + " SELECT split, lang, count(*) AS n, count(DISTINCT source) AS sources, min(doc_id) AS first_id FROM kept GROUP BY split, lang")
def _(t):
    return build(t).groupBy("split", "lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.min("doc_id").alias("first_id"))


@query("str01_prompt_hash", f"SELECT doc_id, sha256({NORM.format('text')}) AS prompt_hash FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.text_hash(F.col("text")).alias("prompt_hash"))


@query("win01_first_wins", f"SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY lang, sha256({NORM.format('text')})")
def _(t):
    return rows.first_wins(t.documents.withColumn("h", tx.text_hash(F.col("text"))), ["lang", "h"], ["doc_id"]).select("doc_id", "lang")


@query("win02_two_key_dedupe", f"""
WITH a AS (SELECT doc_id, lang, source, sha256({NORM.format('text')}) AS h, sha256({SURF.format('text')}) AS s FROM documents),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id) AS r, first_value(lang) OVER (PARTITION BY s ORDER BY doc_id) AS first_lang FROM b)
SELECT count(*) AS after_hash, count(*) FILTER (WHERE r = 1) AS after_surface, count(*) FILTER (WHERE lang <> first_lang) AS conflicts FROM c""")
def _(t):
    a = t.documents.select("doc_id", "lang", tx.text_hash(F.col("text")).alias("h"), F.sha2(tx.surface(F.col("text")), 256).alias("s"))
    w = Window.partitionBy("s").orderBy("doc_id")
    c = rows.first_wins(a, ["h"], ["doc_id"]).withColumn("r", F.row_number().over(w)).withColumn("first_lang", F.first("lang").over(w))
    return c.agg(F.count("*").alias("after_hash"), F.count_if(F.col("r") == 1).alias("after_surface"), F.count_if(F.col("lang") != F.col("first_lang")).alias("conflicts"))


@query("smp02_salted_split", f"SELECT doc_id, {SPLIT} AS split FROM documents")
def _(t):
    return t.documents.select("doc_id", split_of(F.col("doc_id")).alias("split"))


@query("smp01_family_split", """
WITH f AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY sha256('seed' || source)) AS place, count(*) OVER () AS total FROM documents GROUP BY source)
SELECT source, n, CASE WHEN place <= total * 0.6 THEN 'train' WHEN place <= total * 0.8 THEN 'dev' ELSE 'holdout' END AS split, place <= total * 0.8 AS may_train FROM f""")
def _(t):
    f = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.sha2(F.concat(F.lit("seed"), "source"), 256))
    f = f.withColumn("place", F.row_number().over(w)).withColumn("total", F.count("*").over(Window.partitionBy()))
    part = F.when(F.col("place") <= F.col("total") * 0.6, "train").when(F.col("place") <= F.col("total") * 0.8, "dev").otherwise("holdout")
    return f.select("source", "n", part.alias("split"), (F.col("place") <= F.col("total") * 0.8).alias("may_train"))


@query("jn06_split_overlap", f"""
WITH s AS (SELECT {SPLIT} AS split, sha256({NORM.format('text')}) AS h FROM documents),
n AS (SELECT split, h, count(*) AS n FROM s GROUP BY split, h)
SELECT a.split AS part_a, b.split AS part_b, count(*) AS shared_keys, sum(a.n * b.n)::BIGINT AS pairs
FROM n a JOIN n b ON a.h = b.h AND a.split < b.split GROUP BY a.split, b.split""")
def _(t):
    s = t.documents.select(split_of(F.col("doc_id")).alias("split"), tx.text_hash(F.col("text")).alias("h"))
    return sets.same_key_conflicts(s, "h", "split")


KINDS = ["hash", "surface", "digits", "words"]


def _kinds(c):
    return {"hash": tx.text_hash(c), "surface": F.sha2(tx.surface(c), 256), "digits": tx.digit_masked_hash(c), "words": tx.word_template(c)}


_KINDS_SQL = f"""
SELECT 'hash' AS kind, sha256({NORM.format('text')}) AS key FROM {{0}} UNION ALL SELECT 'surface', sha256({SURF.format('text')}) FROM {{0}}
UNION ALL SELECT 'digits', sha256(regexp_replace(regexp_replace(regexp_replace(text, '\\d+', '<NUM>', 'g'), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) FROM {{0}}
UNION ALL SELECT 'words', substr(sha256(regexp_replace({SURF.format('text')}, '[a-z]{{{{4,}}}}', '<word>', 'g')), 1, 12) FROM {{0}}"""


def _kinds_sql(table_: str) -> str:
    return _KINDS_SQL.replace("{0}", table_).replace("{{4,}}", "{4,}").replace("{{", "{").replace("}}", "}")


@query("jn07_eval_overlap", f"""
WITH l AS ({_kinds_sql('documents')}), r AS ({_kinds_sql('benchmark')}), k AS (SELECT unnest(['hash', 'surface', 'digits', 'words']) AS kind),
b AS (SELECT DISTINCT l.kind, l.key FROM l JOIN r ON l.kind = r.kind AND l.key = r.key)
SELECT k.kind, count(b.key) AS overlap, min(b.key) AS first_key FROM k LEFT JOIN b ON k.kind = b.kind GROUP BY k.kind""")
def _(t):
    return sets.overlap_report(sets.keys_of(t.documents, _kinds(F.col("text"))), sets.keys_of(t.benchmark, _kinds(F.col("text"))), KINDS)


@query("jn09_split_key_audit", f"""
WITH s AS (SELECT *, {SPLIT} AS split FROM documents), tr AS (SELECT * FROM s WHERE split = 'train'), ho AS (SELECT * FROM s WHERE split <> 'train'),
l AS ({_kinds_sql('tr')}), r AS ({_kinds_sql('ho')}), k AS (SELECT unnest(['hash', 'surface', 'digits', 'words']) AS kind),
b AS (SELECT DISTINCT l.kind, l.key FROM l JOIN r ON l.kind = r.kind AND l.key = r.key)
SELECT k.kind, count(b.key) AS overlap, min(b.key) AS first_key FROM k LEFT JOIN b ON k.kind = b.kind GROUP BY k.kind""")
def _(t):
    s = t.documents.withColumn("split", split_of(F.col("doc_id")))
    return sets.overlap_report(sets.keys_of(s.where("split = 'train'"), _kinds(F.col("text"))), sets.keys_of(s.where("split <> 'train'"), _kinds(F.col("text"))), KINDS)


@query("jn05_exclude_validation", f"""
WITH s AS (SELECT doc_id, {SPLIT} AS split, sha256({NORM.format('text')}) AS h FROM documents)
SELECT doc_id FROM s WHERE split = 'train' AND h NOT IN (SELECT h FROM s WHERE split <> 'train')""")
def _(t):
    s = t.documents.select("doc_id", split_of(F.col("doc_id")).alias("split"), tx.text_hash(F.col("text")).alias("h"))
    return s.where("split = 'train'").join(s.where("split <> 'train'").select("h").distinct(), "h", "left_anti").select("doc_id")


@query("jn11_contamination", f"""
WITH s AS (SELECT doc_id, {SPLIT} AS split, sha256({NORM.format('text')}) AS h, sha256({SURF.format('text')}) AS u FROM documents),
f AS (SELECT DISTINCT a.doc_id, 'prompt_hash' AS flag FROM s a JOIN s b ON a.h = b.h AND a.split = 'train' AND b.split <> 'train'
      UNION SELECT DISTINCT a.doc_id, 'surface_hash' FROM s a JOIN s b ON a.u = b.u AND a.split = 'train' AND b.split <> 'train')
SELECT doc_id, string_agg(flag, ',' ORDER BY flag) AS flags FROM f GROUP BY doc_id""")
def _(t):
    s = t.documents.select("doc_id", split_of(F.col("doc_id")).alias("split"), tx.text_hash(F.col("text")).alias("prompt_hash"), F.sha2(tx.surface(F.col("text")), 256).alias("surface_hash"))
    keys = sets.keys_of(s, {"prompt_hash": F.col("prompt_hash"), "surface_hash": F.col("surface_hash")}, "doc_id", "split")
    flagged = sets.overlap(keys.where("split = 'train'"), keys.where("split <> 'train'"))
    return flagged.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("flags"))


@query("jn15_mark_contaminated", f"""
WITH s AS (SELECT doc_id, {SPLIT} AS split, sha256({NORM.format('text')}) AS h FROM documents),
g AS (SELECT *, bool_or(split <> 'train') OVER (PARTITION BY h) AS elsewhere FROM s)
SELECT split, split = 'train' AND NOT elsewhere AS may_train, count(*) AS n FROM g GROUP BY 1, 2""")
def _(t):
    s = t.documents.select("doc_id", split_of(F.col("doc_id")).alias("split"), tx.text_hash(F.col("text")).alias("h"))
    out = s.where("split <> 'train'").select("h", F.lit(True).alias("elsewhere")).distinct()
    marked = s.join(out, "h", "left").withColumn("may_train", (F.col("split") == "train") & F.col("elsewhere").isNull())
    return marked.groupBy("split", "may_train").agg(F.count("*").alias("n"))


@query("jn27_first_seen_overlap", f"""
WITH s AS (SELECT doc_id, {SPLIT} AS split, substr(sha256(regexp_replace({SURF.format('text')}, '[a-z]{{4,}}', '<word>', 'g')), 1, 12) AS k FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'dev' THEN 1 ELSE 2 END, doc_id) AS r FROM s)
SELECT split, count(*) AS rows_, count(*) FILTER (WHERE r > 1) AS overlaps FROM r GROUP BY split""")
def _(t):
    s = t.documents.select("doc_id", split_of(F.col("doc_id")).alias("split"), tx.word_template(F.col("text")).alias("k"))
    at = F.when(F.col("split") == "train", 0).when(F.col("split") == "dev", 1).otherwise(2)
    r = s.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(at, "doc_id")))
    return r.groupBy("split").agg(F.count("*").alias("rows_"), F.count_if(F.col("r") > 1).alias("overlaps"))


TARGET = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


@query("agg05_mixture", """
WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT * FROM (VALUES ('en', 0.5::DOUBLE), ('de', 0.2), ('fr', 0.2), ('es', 0.1)) v(lang, target))
SELECT t.lang, coalesce(n.n, 0) AS n, round(coalesce(n.n, 0)::DOUBLE / (SELECT sum(n) FROM n), 6) AS share, t.target, coalesce(n.n, 0)::DOUBLE / (SELECT sum(n) FROM n) < 0.35 * t.target AS under FROM t LEFT JOIN n ON t.lang = n.lang""")
def _(t):
    target = t.spark.createDataFrame(list(TARGET.items()), "lang string, target double")
    n = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    n = n.withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return target.join(n, "lang", "left").select("lang", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("s", F.lit(0.0)), 6).alias("share"), "target", (F.coalesce("s", F.lit(0.0)) < 0.35 * F.col("target")).alias("under"))


@query("agg42_sampling_policy", """
WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT * FROM (VALUES ('en', 0.5::DOUBLE), ('de', 0.2), ('fr', 0.2), ('es', 0.1)) v(lang, target)),
s AS (SELECT t.lang, target, coalesce(n, 0)::DOUBLE / (SELECT sum(n) FROM n) AS share FROM t LEFT JOIN n ON t.lang = n.lang)
SELECT lang, CASE WHEN share < 0.5 * target THEN 'upsample' WHEN share > 1.75 * target THEN 'cap' ELSE 'keep' END AS policy FROM s""")
def _(t):
    target = t.spark.createDataFrame(list(TARGET.items()), "lang string, target double")
    n = t.documents.groupBy("lang").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    s = target.join(n, "lang", "left").fillna(0.0, ["share"])
    return s.select("lang", F.when(F.col("share") < 0.5 * F.col("target"), "upsample").when(F.col("share") > 1.75 * F.col("target"), "cap").otherwise("keep").alias("policy"))


@query("str03_template_share", f"""
WITH a AS (SELECT lang, sha256({TPL.format('text')}) AS h, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT lang, sum(n)::BIGINT AS n, count(*) AS distinct_items, round(max(n)::DOUBLE / sum(n), 6) AS max_share FROM a GROUP BY lang""")
def _(t):
    return measures.largest_share(t.documents, ["lang"], tx.template_hash(F.col("text")))


@query("agg09_word_template_share", f"""
WITH a AS (SELECT lang, source, substr(sha256(regexp_replace({SURF.format('text')}, '[a-z]{{4,}}', '<word>', 'g')), 1, 12) AS h, count(*) AS n FROM documents GROUP BY 1, 2, 3)
SELECT lang, source, sum(n)::BIGINT AS n, count(*) AS distinct_items, round(max(n)::DOUBLE / sum(n), 6) AS max_share FROM a GROUP BY lang, source""")
def _(t):
    return measures.largest_share(t.documents, ["lang", "source"], tx.word_template(F.col("text")))


@query("agg13_distribution_gap", f"""
SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT substr(sha256(regexp_replace({SURF.format('text')}, '[a-z]{{4,}}', '<word>', 'g')), 1, 12)) AS templates, count(*) < 100 AS few FROM documents GROUP BY lang""")
def _(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.count_distinct(tx.word_template(F.col("text"))).alias("templates"), (F.count("*") < 100).alias("few"))


@query("str07_char_template", r"SELECT lang, source, count(DISTINCT substr(regexp_replace(regexp_replace(text, '\d', '0', 'g'), '\p{L}', 'a', 'g'), 1, 300)) AS templates FROM documents GROUP BY lang, source")
def _(t):
    return t.documents.groupBy("lang", "source").agg(F.count_distinct(tx.char_template(F.col("text"))).alias("templates"))


@query("str08_token_template", f"""
SELECT doc_id, array_to_string(list_transform(string_split({NORM.format('text')}, ' ')[1:30], lambda x: CASE WHEN regexp_matches(x, '\\d') THEN 'N' ELSE x END), ' ') AS template,
       array_to_string(list_transform(string_split({NORM.format('text')}, ' ')[1:24], lambda x: CASE WHEN regexp_matches(x, '^[-+]?\\d+(\\.\\d+)?$') THEN '0' ELSE x END), ' ') AS numeric_template FROM documents""")
def _(t):
    return t.documents.select("doc_id", tx.token_template(F.col("text")).alias("template"), tx.numeric_template(F.col("text")).alias("numeric_template"))


@query("str12_near_dup_surface", f"SELECT lang, count(*) - count(DISTINCT sha256({SURF.format('text')})) AS near_duplicates FROM documents GROUP BY lang")
def _(t):
    return t.documents.groupBy("lang").agg((F.count("*") - F.count_distinct(F.sha2(tx.surface(F.col("text")), 256))).alias("near_duplicates"))


@query("str22_token_stats", "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS distinct_tokens FROM documents")
def _(t):
    found = tx.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(found).cast("long").alias("tokens"), F.size(F.array_distinct(found)).cast("long").alias("distinct_tokens"))


@query("flt01_row_codes", f"SELECT doc_id, {CODE} AS code FROM documents")
def _(t):
    return t.documents.select("doc_id", code().alias("code"))


@query("flt02_batch_validation", f"SELECT coalesce({CODE}, 'valid') AS code, lang, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1, 2")
def _(t):
    return t.documents.groupBy(F.coalesce(code(), F.lit("valid")).alias("code"), "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("flt03_trainable", f"SELECT d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE {CODE.replace('doc_id', 'd.doc_id')} IS NULL AND l.quality = 1 AND {SPLIT.replace('doc_id', 'd.doc_id')} = 'train'")
def _(t):
    good = t.documents.where(code().isNull() & (split_of(F.col("doc_id")) == "train"))
    return good.join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id")


@query("flt04_registry_invariants", f"""
WITH s AS (SELECT doc_id, {SPLIT} AS split, quality FROM documents LEFT JOIN labels USING (doc_id)), n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id)
SELECT CASE WHEN c > 1 THEN 'duplicate_id' WHEN split = 'holdout' AND quality = 1 THEN 'holdout_trainable' ELSE 'ok' END AS state, count(*) AS n FROM s JOIN n USING (doc_id) GROUP BY 1""")
def _(t):
    s = t.documents.select("doc_id", split_of(F.col("doc_id")).alias("split")).join(t.labels, "doc_id", "left")
    n = s.groupBy("doc_id").agg(F.count("*").alias("c"))
    state = F.when(F.col("c") > 1, "duplicate_id").when((F.col("split") == "holdout") & (F.col("quality") == 1), "holdout_trainable").otherwise("ok")
    return s.join(n, "doc_id").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("flt06_quarantine", f"SELECT doc_id, {CODE} AS reason, sha256(coalesce(text, '')) AS record_hash FROM documents WHERE {CODE} IS NOT NULL")
def _(t):
    return t.documents.where(code().isNotNull()).select("doc_id", code().alias("reason"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("record_hash"))


@query("flt08_novelty", f"""
WITH a AS (SELECT doc_id, substr(sha256(regexp_replace({SURF.format('text')}, '[a-z]{{4,}}', '<word>', 'g')), 1, 12) AS k FROM documents WHERE n_chars >= 200)
SELECT min(doc_id) AS doc_id FROM a GROUP BY k""")
def _(t):
    far = t.documents.where("n_chars >= 200").withColumn("k", tx.word_template(F.col("text")))
    return rows.first_wins(far, ["k"], ["doc_id"]).select("doc_id")


@query("flt15_keep_filter", r"SELECT CASE WHEN n_chars < 200 THEN 'too_short' WHEN len(string_split(text, chr(10))) < 2 THEN 'too_few_lines' ELSE 'keep' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    reason = F.when(F.col("n_chars") < 200, "too_short").when(F.size(F.split("text", "\n", -1)) < 2, "too_few_lines").otherwise("keep")
    return t.documents.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("flt16_branch_budget", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE n_chars >= 500) WHERE r <= 5")
def _(t):
    return rows.top_per_group(t.documents.where("n_chars >= 500"), ["source"], [F.desc("n_chars"), "doc_id"], 5).select("doc_id", "source")


@query("win03_family_cap", "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= CASE lang WHEN 'en' THEN 20 WHEN 'de' THEN 10 WHEN 'fr' THEN 5 ELSE 0 END")
def _(t):
    return rows.capped(t.documents, "lang", [F.desc("n_chars"), "doc_id"], {"en": 20, "de": 10, "fr": 5}).select("doc_id", "lang")


@query("win04_top_per_family", "SELECT doc_id, source, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3")
def _(t):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return rows.top_per_group(t.documents, ["source"], [F.desc("n_chars"), "doc_id"], 3).withColumn("rank", F.row_number().over(w).cast("long")).select("doc_id", "source", "rank")


@query("win05_round_robin", "SELECT doc_id, lang, row_number() OVER (ORDER BY r, lang NULLS LAST) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) QUALIFY place <= 60")
def _(t):
    return rows.interleaved(t.documents, "lang", ["doc_id"], 60).select("doc_id", "lang", F.col("place").cast("long").alias("place"))


@query("smp04_ratio_cap", "WITH o AS (SELECT count(*) AS n FROM documents WHERE source <> 'src0') SELECT doc_id, source FROM documents WHERE source <> 'src0' UNION ALL (SELECT doc_id, source FROM documents WHERE source = 'src0' QUALIFY row_number() OVER (ORDER BY doc_id) <= floor((SELECT n FROM o) * 0.1 / (1 - 0.1)))")
def _(t):
    return rows.share_capped(t.documents.select("doc_id", "source"), F.col("source") == "src0", ["doc_id"], 0.1)


@query("smp05_holdout_tail", "WITH v AS (SELECT DISTINCT source FROM documents), h AS (SELECT source FROM v QUALIFY row_number() OVER (ORDER BY source DESC) <= round_even((SELECT count(*) FROM v) * 0.2, 0)) SELECT source IN (SELECT source FROM h) AS held_out, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    held = rows.held_out_values(t.documents, "source", 0.2).withColumn("h", F.lit(True))
    return t.documents.join(held, "source", "left").groupBy(F.col("h").isNotNull().alias("held_out")).agg(F.count("*").alias("n"))


@query("smp06_holdout_head", "WITH v AS (SELECT DISTINCT source FROM documents) SELECT source FROM v QUALIFY row_number() OVER (ORDER BY source) <= greatest(1, floor((SELECT count(*) FROM v) * 0.15))")
def _(t):
    return rows.held_out_values(t.documents, "source", 0.15, tail=False)


@query("smp15_family_validation", """
WITH s AS (SELECT source, row_number() OVER (ORDER BY sha256('7' || source)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT source, r <= least(3, greatest(1, n // 5)) AS validation FROM s""")
def _(t):
    v = t.documents.select("source").distinct()
    r = v.withColumn("r", F.row_number().over(Window.orderBy(F.sha2(F.concat(F.lit("7"), "source"), 256)))).withColumn("n", F.count("*").over(Window.partitionBy()))
    return r.select("source", (F.col("r") <= F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.col("n") / 5)))).alias("validation"))


@query("smp16_split_precedence", f"""
SELECT coalesce(CASE WHEN quality = 0 THEN 'quarantine' END, CASE WHEN source = 'src0' THEN 'train' END, {SPLIT.replace('doc_id', 'd.doc_id')}) AS split, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    s = F.coalesce(F.when(F.col("quality") == 0, "quarantine"), F.when(F.col("source") == "src0", "train"), split_of(F.col("doc_id")))
    return d.groupBy(s.alias("split")).agg(F.count("*").alias("n"))


@query("smp11_private_like", f"""
WITH a AS (SELECT doc_id, lang, n_chars, sha256({NORM.format('text')}) AS h, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents),
v AS (SELECT h FROM a WHERE r <= 20)
SELECT doc_id, CASE WHEN r <= 40 THEN 'position' ELSE 'hard' END AS slice FROM a WHERE r > 20 AND (r <= 40 OR n_chars > 5000) AND h NOT IN (SELECT h FROM v)""")
def _(t):
    a = t.documents.select("doc_id", "lang", "n_chars", tx.text_hash(F.col("text")).alias("h")).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")))
    late = a.where("r > 20 AND (r <= 40 OR n_chars > 5000)").join(a.where("r <= 20").select("h").distinct(), "h", "left_anti")
    return late.select("doc_id", F.when(F.col("r") <= 40, "position").otherwise("hard").alias("slice"))


@query("set02_weighted_union", f"""
WITH w AS (SELECT doc_id, 'base' AS part, 1.0::DOUBLE AS weight FROM documents WHERE source <> 'src0' UNION ALL SELECT doc_id, 'extra', 2.4::DOUBLE FROM documents WHERE source = 'src0'),
c AS (SELECT doc_id, part, floor(weight)::BIGINT + ({unit('draw', 'doc_id')} < weight - floor(weight))::BIGINT AS copies FROM w)
SELECT part, count(*) AS rows_, sum(copies)::BIGINT AS copies FROM c GROUP BY part""")
def _(t):
    u = num.salted_unit("draw", F.col("doc_id"))
    base = rows.weighted_repeat(t.documents.where("source <> 'src0'").select("doc_id", F.lit("base").alias("part")), 1.0, u)
    extra = rows.weighted_repeat(t.documents.where("source = 'src0'").select("doc_id", F.lit("extra").alias("part")), 2.4, u)
    return base.unionByName(extra).groupBy("part").agg(F.count_distinct("doc_id").alias("rows_"), F.count("*").alias("copies"))


@query("set05_missing_extra", "SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def _(t):
    return sets.difference(t.documents, t.labels, "doc_id")


_L = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
_RATES = """count(*) AS row_count, count(quality) AS attempted, count(*) FILTER (WHERE quality = 1) AS correct, count(*) FILTER (WHERE quality IS NULL) AS abstained,
round(count(*) FILTER (WHERE quality = 1)::DOUBLE / count(*), 6) AS exact_match, round(count(quality)::DOUBLE / count(*), 6) AS attempt_rate,
round(coalesce(count(*) FILTER (WHERE quality IS NULL AND n_chars <= 1000)::DOUBLE / nullif(count(*) FILTER (WHERE quality IS NULL), 0), 0), 6) AS abstain_precision,
round(coalesce(count(*) FILTER (WHERE quality IS NULL AND n_chars <= 1000)::DOUBLE / nullif(count(*) FILTER (WHERE n_chars <= 1000), 0), 0), 6) AS abstain_recall,
round(count(*) FILTER (WHERE quality = 1 OR (quality IS NULL AND n_chars <= 1000))::DOUBLE / count(*), 6) AS behaviour_accuracy"""


def _metrics(t, *keys):
    d = t.documents.join(t.labels, "doc_id", "left")
    return measures.answer_metrics(d, list(keys), answered=F.col("quality").isNotNull(), correct=F.col("quality") == 1, should_answer=F.col("n_chars") > 1000)


@query("agg01_solver_metrics", f"SELECT lang, {_RATES} FROM {_L} GROUP BY lang")
def _(t):
    return _metrics(t, "lang")


@query("agg02_quality_verdict", f"WITH m AS (SELECT lang, {_RATES} FROM {_L} GROUP BY lang) SELECT lang, CASE WHEN row_count = 0 THEN 'WARN' WHEN exact_match < 0.3 OR attempt_rate < 0.35 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM m")
def _(t):
    return _metrics(t, "lang").select("lang", measures.verdict(F.col("row_count"), (F.col("exact_match"), 0.3), (F.col("attempt_rate"), 0.35)).alias("verdict"))


@query("agg07_weak_groups", f"""
WITH m AS (SELECT lang, source, {_RATES} FROM {_L} GROUP BY lang, source)
SELECT lang, source, row_count, exact_match, attempt_rate, CASE WHEN attempt_rate < 0.2 THEN 'label_more' WHEN exact_match < 0.3 THEN 'review_quality' WHEN row_count < 5 THEN 'collect_more' ELSE 'keep' END AS action FROM m""")
def _(t):
    action = F.when(F.col("attempt_rate") < 0.2, "label_more").when(F.col("exact_match") < 0.3, "review_quality").when(F.col("row_count") < 5, "collect_more").otherwise("keep")
    return _metrics(t, "lang", "source").select("lang", "source", "row_count", "exact_match", "attempt_rate", action.alias("action"))


@query("agg08_coverage", "SELECT lang, source, split, count(*) AS n, grouping_id(lang, source, split)::BIGINT AS level FROM (SELECT *, " + SPLIT + " AS split FROM documents) GROUP BY GROUPING SETS ((lang), (source), (split), (lang, split), ())")
def _(t):
    d = t.documents.select("lang", "source", split_of(F.col("doc_id")).alias("split"))
    return grouping_sets(d, [["lang"], ["source"], ["split"], ["lang", "split"], []], n=F.count("*"), level=F.grouping_id())


@query("agg10_learnability", f"""
SELECT lang, count(*) AS n, count(*) - count(DISTINCT sha256({NORM.format('text')})) AS duplicate_texts, round(avg(n_chars), 6) AS mean_chars, arg_max(source, n_chars * 1000000 - doc_id) AS longest_source FROM documents GROUP BY lang""")
def _(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct(tx.text_hash(F.col("text")))).alias("duplicate_texts"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.max_by("source", F.col("n_chars") * 1000000 - F.col("doc_id")).alias("longest_source"))


@query("agg12_independence", f"""
WITH d AS (SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY sha256({NORM.format('text')})) AS f FROM documents)
SELECT lang, count(*) FILTER (WHERE doc_id = f) AS independent, count(*) FILTER (WHERE doc_id <> f) AS derived, sum(CASE WHEN doc_id = f THEN 1.0 ELSE 0.5 END)::DOUBLE AS effective FROM d GROUP BY lang""")
def _(t):
    h = t.documents.select("doc_id", "lang", tx.text_hash(F.col("text")).alias("h"))
    d = h.join(h.groupBy("h").agg(F.min("doc_id").alias("f")), "h")
    own = F.col("doc_id") == F.col("f")
    return d.groupBy("lang").agg(F.count_if(own).alias("independent"), F.count_if(~own).alias("derived"), F.sum(F.when(own, 1.0).otherwise(0.5)).alias("effective"))


@query("agg14_transfer_slices", f"""
WITH s AS (SELECT * FROM (VALUES ('train', 0.9::DOUBLE), ('dev', 0.9), ('holdout', 0.95), ('private', 0.9)) v(slice, baseline)), m AS (SELECT {SPLIT.replace('doc_id', 'd.doc_id')} AS slice, avg(quality) AS acc, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1)
SELECT s.slice, coalesce(m.n, 0) AS n, round(coalesce(m.acc, 0), 6) AS accuracy, round(greatest(0, baseline - coalesce(m.acc, 0)), 6) AS gap FROM s LEFT JOIN m ON s.slice = m.slice""")
def _(t):
    s = t.spark.createDataFrame([("train", 0.9), ("dev", 0.9), ("holdout", 0.95), ("private", 0.9)], "slice string, baseline double")
    m = t.documents.join(t.labels, "doc_id").groupBy(split_of(F.col("doc_id")).alias("slice")).agg(F.avg("quality").alias("acc"), F.count("*").alias("n"))
    acc = F.coalesce("acc", F.lit(0.0))
    return s.join(m, "slice", "left").select("slice", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(acc, 6).alias("accuracy"), F.round(F.greatest(F.lit(0.0), F.col("baseline") - acc), 6).alias("gap"))


@query("agg16_failure_counts", f"SELECT code, n, row_number() OVER (ORDER BY n DESC, code) AS rank FROM (SELECT {CODE} AS code, count(*) AS n FROM documents GROUP BY 1) WHERE code IS NOT NULL")
def _(t):
    n = t.documents.groupBy(code().alias("code")).agg(F.count("*").alias("n")).where("code IS NOT NULL")
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "code")).cast("long"))


_FLAGS = "array_to_string(list_filter([CASE WHEN n_chars < 300 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN contains(text, chr(10)) THEN 'lines' END, CASE WHEN source = 'src0' THEN 'hot' END], lambda x: x IS NOT NULL), ',')"


def flags():
    return rows.failures(("short", F.col("n_chars") < 300), ("foreign", F.col("lang") != "en"), ("lines", F.contains("text", F.lit("\n"))), ("hot", F.col("source") == "src0"))


@query("gte01_blockers", f"SELECT doc_id, {_FLAGS} AS blockers FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(flags(), ",").alias("blockers"))


@query("agg17_reason_counts", f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split({_FLAGS}, ',')) AS reason FROM documents) WHERE reason <> '' GROUP BY reason")
def _(t):
    return t.documents.select(F.explode(flags()).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("agg32_eval_summary", f"SELECT {SPLIT} AS split, count(*) AS n, count(DISTINCT source) AS rules, count(DISTINCT lang) AS groups_ FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(split_of(F.col("doc_id")).alias("split")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("rules"), F.count_distinct("lang").alias("groups_"))


@query("agg34_diversity", f"SELECT source, round(count(DISTINCT sha256({NORM.format('text')}))::DOUBLE / count(*), 6) AS diversity, round(count(DISTINCT lang)::DOUBLE / 4, 6) AS coverage FROM documents GROUP BY source")
def _(t):
    return t.documents.groupBy("source").agg(F.round(F.count_distinct(tx.text_hash(F.col("text"))) / F.count("*"), 6).alias("diversity"), F.round(F.count_distinct("lang") / 4, 6).alias("coverage"))


@query("agg30_coverage_pivot", f"SELECT lang, count(*) FILTER (WHERE quality = 1) AS correct, count(*) FILTER (WHERE quality = 0) AS wrong, count(*) FILTER (WHERE quality IS NULL) AS abstained FROM {_L} GROUP BY lang")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left").withColumn("status", F.when(F.col("quality") == 1, "correct").when(F.col("quality") == 0, "wrong").otherwise("abstained"))
    return d.groupBy("lang").pivot("status", ["correct", "wrong", "abstained"]).count().fillna(0)


@query("win09_dominant_source", "SELECT lang, max(n) AS n, arg_max(source, n * 1000 + k) AS dominant FROM (SELECT lang, source, count(*) AS n, dense_rank() OVER (ORDER BY source) AS k FROM documents GROUP BY lang, source) GROUP BY lang")
def _(t):
    return measures.counted_label(t.documents, ["lang"], "source")


@query("mth07_affine_calibration", "SELECT doc_id, round(greatest(0.0, least(1.0, 0.8 * (n_chars % 1000) / 1000.0 + 0.15)), 6)::DOUBLE AS p FROM documents")
def _(t):
    return t.documents.select("doc_id", F.round(num.clamp(0.8 * (F.col("n_chars") % 1000) / 1000.0 + 0.15), 6).alias("p"))


@query("jn20_labelled_accuracy", f"SELECT d.lang, count(*) AS labelled, count(*) FILTER (WHERE quality = 1 AND n_chars > 300) AS right_, round(count(*) FILTER (WHERE quality = 1 AND n_chars > 300)::DOUBLE / count(*), 6) AS accuracy FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.lang")
def _(t):
    ok = F.coalesce((F.col("quality") == 1) & (F.col("n_chars") > 300), F.lit(False))
    return t.labels.join(t.documents, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("labelled"), F.count_if(ok).alias("right_"), F.round(num.ratio(F.count_if(ok), F.count("*")), 6).alias("accuracy"))


@query("jn21_positional_zip", "WITH a AS (SELECT n_chars, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE lang = 'de'), b AS (SELECT n_chars AS m, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE lang = 'fr') SELECT count(*) AS pairs, count(*) FILTER (WHERE m > n_chars) AS helped, count(*) FILTER (WHERE m < n_chars) AS hurt, count(*) FILTER (WHERE m = n_chars) AS neutral FROM a JOIN b ON a.r = b.r")
def _(t):
    side = lambda lang, name: positions(t.documents.where(F.col("lang") == lang).select("doc_id", F.col("n_chars").alias(name)), "doc_id").select("position", name)
    j = side("de", "n_chars").join(side("fr", "m"), "position")
    return j.agg(F.count("*").alias("pairs"), F.count_if(F.col("m") > F.col("n_chars")).alias("helped"), F.count_if(F.col("m") < F.col("n_chars")).alias("hurt"), F.count_if(F.col("m") == F.col("n_chars")).alias("neutral"))


@query("prj03_minted_ids", r"SELECT doc_id, 'v2_' || trim(substr(regexp_replace(text, '[^A-Za-z0-9_]+', '_', 'g'), 1, 160), '_') AS minted FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.minted_id("v2_", F.col("text")).alias("minted"))


@query("prj04_style_rotation", "SELECT doc_id, sha256(CASE doc_id % 5 WHEN 0 THEN 'Solve: ' || text WHEN 1 THEN 'Task: ' || text WHEN 2 THEN text || ' Answer:' WHEN 3 THEN 'Given ' || text ELSE text END) AS prompt_hash FROM documents")
def _(t):
    h = F.col("text")
    styles = (F.concat(F.lit("Solve: "), h), F.concat(F.lit("Task: "), h), F.concat(h, F.lit(" Answer:")), F.concat(F.lit("Given "), h), h)
    out = None
    for k, s in enumerate(styles):
        out = F.when(F.col("doc_id") % 5 == k, s) if out is None else out.when(F.col("doc_id") % 5 == k, s)
    return t.documents.select("doc_id", F.sha2(out, 256).alias("prompt_hash"))


@query("prj05_surface_shift", "SELECT doc_id::VARCHAR || '_shift' AS id, sha256('In other words: ' || text) AS prompt_hash FROM documents ORDER BY doc_id LIMIT 50")
def _(t):
    return t.documents.orderBy("doc_id").limit(50).select(F.concat(F.col("doc_id").cast("string"), F.lit("_shift")).alias("id"), F.sha2(F.concat(F.lit("In other words: "), F.col("text")), 256).alias("prompt_hash"))


@query("prj10_eligibility", f"SELECT CASE WHEN lang IS NULL OR source IS NULL THEN 'missing_metadata' WHEN {CODE.replace('doc_id', 'd.doc_id')} IS NOT NULL THEN 'invalid_row' WHEN {SPLIT.replace('doc_id', 'd.doc_id')} = 'holdout' THEN 'leakage_risk' WHEN quality IS NULL THEN 'abstain' WHEN toxic = 1 THEN 'hard_negative' WHEN quality = 1 THEN 'verified_correct' ELSE 'solver_failure' END AS class, count(*) AS n FROM {_L} GROUP BY 1")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    c = rows.error_code(
        ("missing_metadata", F.col("lang").isNull() | F.col("source").isNull()), ("invalid_row", code().isNotNull()), ("leakage_risk", split_of(F.col("doc_id")) == "holdout"),
        ("abstain", F.col("quality").isNull()), ("hard_negative", F.col("toxic") == 1), ("verified_correct", F.col("quality") == 1), ("solver_failure", F.lit(True)),
    )
    return d.groupBy(c.alias("class")).agg(F.count("*").alias("n"))


_FAMILY = r"CASE WHEN regexp_matches(lower(text), 'token|secret|key') THEN 'secret' WHEN regexp_matches(lower(text), 'licen[sc]e') THEN 'license' WHEN regexp_matches(lower(text), '\d{3}') THEN 'numeric' WHEN regexp_matches(lower(text), '[äöüß]') THEN 'german' ELSE 'prose' END"


@query("prj14_router", f"SELECT {_FAMILY} AS family, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def _(t):
    family = tx.first_match(F.lower("text"), ("token|secret|key", "secret"), ("licen[sc]e", "license"), (r"\d{3}", "numeric"), ("[äöüß]", "german"), default="prose")
    return t.documents.groupBy(family.alias("family")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("jn16_pairs_capped", "WITH p AS (SELECT doc_id, source FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1), n AS (SELECT doc_id, source FROM documents d JOIN labels l USING (doc_id) WHERE quality = 0) SELECT p.doc_id AS chosen, n.doc_id AS rejected, p.source FROM p JOIN n ON p.source = n.source QUALIFY row_number() OVER (PARTITION BY p.source ORDER BY p.doc_id, n.doc_id) <= 3")
def _(t):
    d = t.documents.select("doc_id", "source").join(t.labels, "doc_id")
    # Of each side only the first 3 can be in the first 3 pairs, so the join makes 9 rows a source at most.
    p = rows.top_per_group(d.where("quality = 1"), ["source"], ["doc_id"], 3).select(F.col("doc_id").alias("chosen"), "source")
    n = rows.top_per_group(d.where("quality = 0"), ["source"], ["doc_id"], 3).select(F.col("doc_id").alias("rejected"), "source")
    return rows.top_per_group(p.join(n, "source"), ["source"], ["chosen", "rejected"], 3).select("chosen", "rejected", "source")


@query("jn17_negative_fan_out", "SELECT doc_id, kind FROM documents d, (VALUES ('swap', 1), ('drop', 2), ('copy', 3)) v(kind, k) WHERE k <= 2")
def _(t):
    kinds = t.spark.createDataFrame([("swap", 1), ("drop", 2), ("copy", 3)], "kind string, k int").where("k <= 2")
    return t.documents.select("doc_id").crossJoin(F.broadcast(kinds)).select("doc_id", "kind")


@query("jn18_keep_if_correct", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def _(t):
    return t.documents.select("doc_id").join(t.labels.where("quality = 1 AND toxic = 0"), "doc_id", "left_semi")


@query("agg43_family_delta", "WITH a AS (SELECT lang, avg(quality) AS q, avg(1 - toxic) AS p FROM documents JOIN labels USING (doc_id) GROUP BY lang) SELECT lang, round(q - p, 6) AS delta, CASE WHEN q > p THEN 'improved' WHEN q < p THEN 'regressed' ELSE 'same' END AS state FROM a")
def _(t):
    a = t.documents.join(t.labels, "doc_id").groupBy("lang").agg(F.avg("quality").alias("q"), F.avg(1 - F.col("toxic")).alias("p"))
    return a.select("lang", F.round(F.col("q") - F.col("p"), 6).alias("delta"), F.when(F.col("q") > F.col("p"), "improved").when(F.col("q") < F.col("p"), "regressed").otherwise("same").alias("state"))


@query("agg46_rollup", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def _(t):
    return t.documents.rollup("lang", "source").agg(F.count("*").alias("n"))


@query("agg06_quality_gate", f"""
WITH a AS (SELECT count(*)::DOUBLE AS rows_, count(DISTINCT source)::DOUBLE AS sources, 1 - count(DISTINCT sha256({NORM.format('text')}))::DOUBLE / count(*) AS duplicate_rate, avg(n_chars) AS mean_chars FROM documents),
g AS (SELECT unnest(['rows', 'sources', 'duplicate_rate', 'mean_chars']) AS gate, unnest([rows_, sources, duplicate_rate, mean_chars]) AS value, unnest([100.0::DOUBLE, 10, 0.2, 500]) AS threshold FROM a)
SELECT gate, round(value, 6) AS value, threshold, CASE WHEN (gate = 'duplicate_rate' AND value <= threshold) OR (gate <> 'duplicate_rate' AND value >= threshold) THEN 'PASS' ELSE 'FAIL' END AS status FROM g""")
def _(t):
    a = t.documents.agg(F.count("*").cast("double").alias("rows"), F.count_distinct("source").cast("double").alias("sources"), (1 - F.count_distinct(tx.text_hash(F.col("text"))) / F.count("*")).alias("duplicate_rate"), F.avg("n_chars").alias("mean_chars"))
    limits = {"rows": 100.0, "sources": 10.0, "duplicate_rate": 0.2, "mean_chars": 500.0}
    g = a.select(F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).alias("value"), F.lit(v).alias("threshold")) for k, v in limits.items()])).alias("g")).select("g.*")
    ok = F.when(F.col("gate") == "duplicate_rate", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return g.select("gate", F.round("value", 6).alias("value"), "threshold", F.when(ok, "PASS").otherwise("FAIL").alias("status"))


@query("gte02_audit_summary", f"WITH v AS (SELECT lang, CASE WHEN count(*) < 50 THEN 1 WHEN avg(n_chars) > 5000 THEN 2 ELSE 0 END AS s FROM documents GROUP BY lang) SELECT CASE max(s) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS status, count(*) AS reports FROM v")
def _(t):
    s = F.when(F.count("*") < 50, 1).when(F.avg("n_chars") > 5000, 2).otherwise(0)
    v = t.documents.groupBy("lang").agg(s.alias("s"))
    return v.agg(F.when(F.max("s") == 2, "FAIL").when(F.max("s") == 1, "WARN").otherwise("PASS").alias("status"), F.count("*").alias("reports"))


@query("gte03_readiness", f"WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), g AS (SELECT unnest(['en', 'de', 'fr', 'es', 'it']) AS lang), r AS (SELECT g.lang, CASE WHEN n IS NULL THEN 'MISSING' WHEN n >= 20 THEN 'PASS' ELSE 'FAIL' END AS state FROM g LEFT JOIN n ON g.lang = n.lang) SELECT bool_and(state = 'PASS') AS ready, string_agg(lang || ':' || state, ',' ORDER BY lang) AS states FROM r")
def _(t):
    g = t.spark.createDataFrame([(x,) for x in ("en", "de", "fr", "es", "it")], "lang string")
    n = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    r = g.join(n, "lang", "left").select("lang", F.when(F.col("n").isNull(), "MISSING").when(F.col("n") >= 20, "PASS").otherwise("FAIL").alias("state"))
    return r.agg(F.bool_and(F.col("state") == "PASS").alias("ready"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "lang", "state"))), ",").alias("states"))


@query("shingle_containment", r"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\s]+') AS w FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\s]+') AS w FROM documents),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 6, 1))) u(i)), ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 6, 1))) u(i)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT ds.doc_id, bs.item_id, round(count(*)::DOUBLE / max(n), 6) AS containment FROM bs JOIN ds ON bs.s = ds.s JOIN n ON n.item_id = bs.item_id GROUP BY ds.doc_id, bs.item_id HAVING count(*) * 2 >= max(n)""")
def _(t):
    def shingles(df, key):
        w = F.regexp_extract_all(F.lower("text"), F.lit(r"[^\s]+"), F.lit(0))
        at = df.select(key, w.alias("w")).where(F.size("w") >= 8).select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 8), " ")))).alias("s"))
        return at.distinct()

    b, d = shingles(t.benchmark, "item_id"), shingles(t.documents, "doc_id")
    n = b.groupBy("item_id").agg(F.count("*").alias("n"))
    hit = d.join(b, "s").groupBy("doc_id", "item_id").agg(F.count("*").alias("c")).join(n, "item_id")
    return hit.where("c * 2 >= n").select("doc_id", "item_id", F.round(F.col("c") / F.col("n"), 6).alias("containment"))
