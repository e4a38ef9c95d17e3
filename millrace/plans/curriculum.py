"""Queries of manifests, training-row builders, samplers, selection scores and decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import answers, canonical
from millrace.functions import numbers as num
from millrace.functions import text as tx
from millrace.operators import curriculum, measures, rows, sets, solvers
from millrace.plans.corpus import CODE, NORM, SPLIT, code, split_of, unit
from millrace.plans.files import folder
from millrace.plans.registry import query
from millrace.sources import readers, writers

_D = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
SPLIT_D = SPLIT.replace("doc_id", "d.doc_id")
#: Difficulty of a row, the same in both engines.
HARD = "least(1.0, 0.2 + 0.3 * (n_chars > 2000)::INT + 0.2 * (lang <> 'en')::INT + 0.1 * (doc_id % 3))::DOUBLE"


def hard():
    return F.least(F.lit(1.0), 0.2 + 0.3 * (F.col("n_chars") > 2000).cast("int") + 0.2 * (F.col("lang") != "en").cast("int") + 0.1 * (F.col("doc_id") % 3))


def labelled(t):
    return t.documents.join(t.labels, "doc_id", "left")


@query("src02_json_object", "SELECT count(*) AS n, max(r_name) AS last FROM region")
def _(t):
    path = folder(t, "object") + ".json"
    t.region.agg(F.to_json(F.struct(F.count("*").alias("n"), F.max("r_name").alias("last"))).alias("value")).write.text(path)
    return readers.read_json(t.spark, path, "n bigint, last string")


@query("src10_path_resolution", "SELECT TRUE AS found")
def _(t):
    path = readers.first_existing(t.spark, f"{t.folder}/none.parquet", [f"{t.folder}/region.parquet"])
    return t.spark.range(1).select(F.lit(path.endswith("region.parquet")).alias("found"))


@query("src13_eval_rows_by_mode", "SELECT item_id FROM benchmark ORDER BY item_id LIMIT 25")
def _(t):
    path = readers.first_existing(t.spark, f"{t.folder}/benchmark_fast.parquet", [f"{t.folder}/benchmark.parquet"])
    return t.spark.read.parquet(path).orderBy("item_id").limit(25).select("item_id")


@query("snk01_checked_jsonl", "SELECT count(*) AS lines, sum(length(js))::BIGINT AS chars FROM (SELECT '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}' AS js FROM nation)")
def _(t):
    path = folder(t, "nation") + ".jsonl"
    writers.write_jsonl(t.nation.select("n_nationkey", "n_name"), path)
    return t.spark.read.text(path).agg(F.count("*").alias("lines"), F.sum(F.char_length("value")).alias("chars"))


@query("snk05_submission_csv", "SELECT o_orderkey AS id, o_orderkey % 100000 AS answer FROM orders")
def _(t):
    path = folder(t, "submission")
    writers.write_csv(t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 100000).alias("answer")), path, ["id"])
    return readers.read_csv(t.spark, path, ["id", "answer"]).select(F.col("id").cast("long").alias("id"), F.col("answer").cast("long").alias("answer"))


@query("snk09_retrieval_artifact", r"SELECT item_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS tokens FROM benchmark")
def _(t):
    path = folder(t, "index")
    t.benchmark.select("item_id", F.array_distinct(tx.tokens(F.col("text"))).alias("tokens")).write.parquet(path)
    return t.spark.read.parquet(path).select("item_id", F.size("tokens").cast("long").alias("tokens"))


@query("snk10_training_artifact", f"SELECT lang, {SPLIT} AS split, count(*) AS n FROM documents GROUP BY 1, 2")
def _(t):
    path = folder(t, "training")
    writers.write_partitioned(t.documents.select("doc_id", "lang", split_of(F.col("doc_id")).alias("split")), path, "lang", "split")
    return t.spark.read.parquet(path).groupBy("lang", "split").agg(F.count("*").alias("n"))


@query("man04_corpus_manifest", f"SELECT {SPLIT} AS file, count(*) AS records, count(DISTINCT source) AS rules, count(DISTINCT lang) AS groups_, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang <> 'en') AS other FROM documents GROUP BY 1")
def _(t):
    en = F.col("lang") == "en"
    return t.documents.groupBy(split_of(F.col("doc_id")).alias("file")).agg(F.count("*").alias("records"), F.count_distinct("source").alias("rules"), F.count_distinct("lang").alias("groups_"), F.count_if(en).alias("en"), F.count_if(~en).alias("other"))


@query("man05_manifest_check", f"WITH m AS (SELECT {SPLIT} AS file, count(*) AS n FROM documents GROUP BY 1) SELECT file, array_to_string(list_filter([CASE WHEN n < 100 THEN 'few_rows' END, CASE WHEN file = 'holdout' THEN 'not_trainable' END], lambda x: x IS NOT NULL), ',') AS problems FROM m")
def _(t):
    m = t.documents.groupBy(split_of(F.col("doc_id")).alias("file")).agg(F.count("*").alias("n"))
    return m.select("file", F.array_join(rows.failures(("few_rows", F.col("n") < 100), ("not_trainable", F.col("file") == "holdout")), ",").alias("problems"))


@query("man06_eval_manifest", f"""
WITH a AS (SELECT {SPLIT} AS file, source, sha256({NORM.format('text')}) AS h FROM documents), f AS (SELECT file, count(*) - count(DISTINCT h) AS duplicate_prompts FROM a GROUP BY file),
x AS (SELECT file, count(DISTINCT h) AS shared FROM a WHERE h IN (SELECT h FROM a GROUP BY h HAVING count(DISTINCT file) > 1) GROUP BY file)
SELECT f.file, duplicate_prompts, coalesce(shared, 0) AS shared_prompts FROM f LEFT JOIN x ON f.file = x.file""")
def _(t):
    a = t.documents.select(split_of(F.col("doc_id")).alias("file"), tx.text_hash(F.col("text")).alias("h"))
    several = a.groupBy("h").agg(F.count_distinct("file").alias("c")).where("c > 1").select("h", F.lit(1).alias("x"))
    j = a.join(several, "h", "left")
    return j.groupBy("file").agg((F.count("*") - F.count_distinct("h")).alias("duplicate_prompts"), F.count_distinct(F.when(F.col("x") == 1, F.col("h"))).alias("shared_prompts"))


@query("man08_split_manifest", f"SELECT lang, string_agg(DISTINCT {SPLIT}, ',' ORDER BY {SPLIT}) AS splits, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY lang")
def _(t):
    return t.documents.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set(split_of(F.col("doc_id")))), ",").alias("splits"), F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("flt05_permissions", f"SELECT doc_id, {SPLIT} = 'train' AS sft, {SPLIT} <> 'train' AS evaluate FROM documents")
def _(t):
    s = split_of(F.col("doc_id"))
    return t.documents.select("doc_id", (s == "train").alias("sft"), (s != "train").alias("evaluate"))


@query("flt07_ambiguity", f"SELECT d.doc_id FROM {_D} WHERE coalesce(toxic::DOUBLE, 1.0) <= 0.5 AND quality = 1")
def _(t):
    return labelled(t).where((F.coalesce(F.col("toxic").cast("double"), F.lit(1.0)) <= 0.5) & (F.col("quality") == 1)).select("doc_id")


@query("flt10_difficulty", f"SELECT doc_id, round({HARD}, 6) AS difficulty, round(least(1.0, 0.5 * {HARD} + 0.4), 6)::DOUBLE AS private_like FROM documents")
def _(t):
    return t.documents.select("doc_id", F.round(hard(), 6).alias("difficulty"), F.round(F.least(F.lit(1.0), 0.5 * hard() + 0.4), 6).alias("private_like"))


@query("flt11_reject_reason", f"SELECT CASE WHEN {HARD} >= 0.85 THEN 'ambiguous' WHEN n_chars < 200 THEN 'not_novel' WHEN source IS NULL THEN 'unverifiable' WHEN {HARD} < 0.35 THEN 'too_easy' ELSE 'keep' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    r = rows.error_code(("ambiguous", hard() >= 0.85), ("not_novel", F.col("n_chars") < 200), ("unverifiable", F.col("source").isNull()), ("too_easy", hard() < 0.35), ("keep", F.lit(True)))
    return t.documents.groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


@query("flt09_synthetic_quality", f"""
WITH a AS (SELECT doc_id, source, sha256({NORM.format('text')}) AS h, CASE WHEN n_chars < 200 THEN 'short' END AS reason FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS k FROM a WHERE reason IS NULL), c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM b WHERE k = 1)
SELECT doc_id, 'short' AS verdict FROM a WHERE reason IS NOT NULL UNION ALL SELECT doc_id, 'near_duplicate' FROM b WHERE k > 1 UNION ALL SELECT doc_id, CASE WHEN r > 20 THEN 'over_cap' ELSE 'keep' END FROM c""")
def _(t):
    a = t.documents.select("doc_id", "source", tx.text_hash(F.col("text")).alias("h"), F.when(F.col("n_chars") < 200, "short").alias("reason"))
    return curriculum.quality_verdicts(a, "doc_id", "h", "source", 20)


@query("flt09_greedy_quality")
def _(t):
    a = t.documents.select("doc_id", "source", tx.text_hash(F.col("text")).alias("h"), F.when(F.col("n_chars") < 200, "short").alias("reason"))
    return curriculum.greedy_verdicts(a, "doc_id", "h", "source", 20)


@query("flt17_curriculum", f"SELECT doc_id, place FROM (SELECT doc_id, row_number() OVER (ORDER BY r, source NULLS LAST) AS place FROM (SELECT d.doc_id, source, row_number() OVER (PARTITION BY source ORDER BY d.doc_id) AS r FROM {_D} WHERE quality = 1 AND lang IN ('en', 'de'))) WHERE place <= 200")
def _(t):
    ok = labelled(t).where("quality = 1 AND lang IN ('en', 'de')")
    return rows.interleaved(ok, "source", ["doc_id"], 200).select("doc_id", F.col("place").cast("long").alias("place"))


@query("flt18_token_masks", r"WITH m AS (SELECT conv_id, sum(len(regexp_extract_all(coalesce(text, ''), '[^\s]+')) * (role = 'assistant')::INT) AS s, arg_min(role, turn) AS first FROM conversations GROUP BY conv_id) SELECT CASE WHEN s = 0 THEN 'zero_supervised' WHEN first = 'assistant' THEN 'before_prompt' ELSE 'ok' END AS state, count(*) AS n FROM m GROUP BY 1")
def _(t):
    s = F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\s]+")) * (F.col("role") == "assistant").cast("int"))
    m = t.conversations.groupBy("conv_id").agg(s.alias("s"), F.min_by("role", "turn").alias("first"))
    return m.groupBy(F.when(F.col("s") == 0, "zero_supervised").when(F.col("first") == "assistant", "before_prompt").otherwise("ok").alias("state")).agg(F.count("*").alias("n"))


@query("prj02_direct_rows", f"SELECT 'v2_' || d.doc_id AS id, d.doc_id AS source_row_id, lang AS family, {SPLIT_D} AS split, sha256(text) AS prompt_hash, coalesce(quality, -1)::INT AS verified FROM {_D} WHERE {CODE.replace('doc_id', 'd.doc_id')} IS NULL")
def _(t):
    return labelled(t).where(code().isNull()).select(F.concat(F.lit("v2_"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("source_row_id"), F.col("lang").alias("family"), split_of(F.col("doc_id")).alias("split"), F.sha2("text", 256).alias("prompt_hash"), F.coalesce("quality", F.lit(-1)).alias("verified"))


@query("prj06_composition_shift", f"SELECT doc_id FROM documents WHERE {HARD} >= 0.6 ORDER BY doc_id LIMIT 100")
def _(t):
    return t.documents.where(hard() >= 0.6).orderBy("doc_id").limit(100).select("doc_id")


@query("prj07_sft_format", "SELECT doc_id, sha256('Family: ' || lang || chr(10) || text) AS user_hash, '\\boxed{' || source || '}' AS assistant FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2(F.concat(F.lit("Family: "), F.col("lang"), F.lit("\n"), F.col("text")), 256).alias("user_hash"), F.concat(F.lit("\\boxed{"), F.col("source"), F.lit("}")).alias("assistant"))


@query("prj08_sft_rejects", f"SELECT CASE WHEN quality IS NULL THEN 'no_audit' WHEN quality = 0 THEN 'failed_audit' WHEN {SPLIT_D} <> 'train' THEN 'not_train' ELSE 'accepted' END AS reason, count(*) AS n, min(d.doc_id) AS first_id FROM {_D} GROUP BY 1")
def _(t):
    r = rows.error_code(("no_audit", F.col("quality").isNull()), ("failed_audit", F.col("quality") == 0), ("not_train", split_of(F.col("doc_id")) != "train"), ("accepted", F.lit(True)))
    return labelled(t).groupBy(r.alias("reason")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("prj09_corpus_text", "SELECT conv_id, turn, sha256(CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' ELSE 'System: ' END || coalesce(text, '')) AS h FROM conversations")
def _(t):
    head = F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "Assistant: ").otherwise("System: ")
    return t.conversations.select("conv_id", "turn", F.sha2(F.concat(head, F.coalesce("text", F.lit(""))), 256).alias("h"))


@query("prj12_failure_classes", f"SELECT CASE WHEN quality IS NULL THEN 'missing' WHEN n_chars = 0 THEN 'empty' WHEN n_chars > 10000 THEN 'verbose' WHEN regexp_matches(text, '^\\s*$') THEN 'blank' WHEN quality = 0 AND toxic = 1 THEN 'unsafe_wrong' WHEN quality = 0 THEN 'wrong' ELSE 'right' END AS class, count(*) AS n FROM {_D} GROUP BY 1")
def _(t):
    q = F.col("quality")
    c = rows.error_code(("missing", q.isNull()), ("empty", F.col("n_chars") == 0), ("verbose", F.col("n_chars") > 10000), ("blank", F.col("text").rlike(r"^\s*$")), ("unsafe_wrong", (q == 0) & (F.col("toxic") == 1)), ("wrong", q == 0), ("right", F.lit(True)))
    return labelled(t).groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query("prj13_dominant_action", f"WITH m AS (SELECT source, avg((quality = 0)::INT) AS wrong, avg((quality IS NULL)::INT) AS missing, avg((toxic = 1)::INT) AS unsafe FROM {_D} GROUP BY 1) SELECT source, CASE WHEN coalesce(unsafe, 0) > 0.2 THEN 'block' WHEN coalesce(wrong, 0) > 0.3 THEN 'rewrite' WHEN missing > 0.7 THEN 'label' ELSE 'keep' END AS action FROM m")
def _(t):
    share = lambda c: F.avg(c.cast("int"))
    m = labelled(t).groupBy("source").agg(share(F.col("quality") == 0).alias("wrong"), share(F.col("quality").isNull()).alias("missing"), share(F.col("toxic") == 1).alias("unsafe"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return m.select("source", F.when(z("unsafe") > 0.2, "block").when(z("wrong") > 0.3, "rewrite").when(F.col("missing") > 0.7, "label").otherwise("keep").alias("action"))


@query("prj15_family_detection", "SELECT item_id, CASE WHEN contains(lower(text), ' the ') THEN 'english' WHEN contains(lower(text), ' der ') THEN 'german' WHEN contains(lower(text), ' les ') THEN 'french' ELSE 'unknown' END AS family FROM benchmark")
def _(t):
    c = F.lower("text")
    return t.benchmark.select("item_id", F.when(c.contains(" the "), "english").when(c.contains(" der "), "german").when(c.contains(" les "), "french").otherwise("unknown").alias("family"))


@query("agg03_adapter_metrics", f"SELECT lang, round(avg((quality IS NOT NULL)::INT), 6) AS attempted, round(avg((quality IS NOT NULL AND quality = 1)::INT), 6) AS exact, round(avg((n_chars > 5000)::INT), 6) AS verbose, round(avg((n_chars < 100)::INT), 6) AS terse FROM {_D} GROUP BY lang")
def _(t):
    r = lambda c: F.round(num.share(F.coalesce(c, F.lit(False))), 6)
    return labelled(t).groupBy("lang").agg(r(F.col("quality").isNotNull()).alias("attempted"), r(F.col("quality") == 1).alias("exact"), r(F.col("n_chars") > 5000).alias("verbose"), r(F.col("n_chars") < 100).alias("terse"))


@query("agg04_output_drift", r"SELECT source, round(avg((n_chars > 3000)::INT), 6) AS verbose, round(avg((trim(text) = '')::INT), 6) AS empty, round(avg((regexp_matches(text, '^[A-Z][a-z]+ '))::INT), 6) AS prefixed FROM documents GROUP BY source")
def _(t):
    r = measures.prefix_rate
    return t.documents.groupBy("source").agg(r(F.col("n_chars") > 3000).alias("verbose"), r(F.trim("text") == "").alias("empty"), r(F.col("text").rlike("^[A-Z][a-z]+ ")).alias("prefixed"))


@query("agg11_teacher_audit", f"SELECT count(*) - count(DISTINCT doc_id) AS duplicate_ids, count(*) - count(DISTINCT sha256({NORM.format('text')})) AS duplicate_prompts, count(*) FILTER (WHERE NOT regexp_matches(source, '^src\\d+$')) AS odd_sources FROM documents")
def _(t):
    return t.documents.agg((F.count("*") - F.count_distinct("doc_id")).alias("duplicate_ids"), (F.count("*") - F.count_distinct(tx.text_hash(F.col("text")))).alias("duplicate_prompts"), F.count_if(~F.col("source").rlike(r"^src\d+$")).alias("odd_sources"))


@query("agg41_hard_negatives", f"SELECT lang, count(*) FILTER (WHERE quality = 0) AS negatives, count(*) FILTER (WHERE quality = 0 AND {SPLIT_D} = 'holdout') AS violations, count(DISTINCT CASE WHEN quality = 0 THEN source END) < 5 AS narrow FROM {_D} GROUP BY lang")
def _(t):
    bad = F.coalesce(F.col("quality") == 0, F.lit(False))
    return labelled(t).groupBy("lang").agg(F.count_if(bad).alias("negatives"), F.count_if(bad & (split_of(F.col("doc_id")) == "holdout")).alias("violations"), (F.count_distinct(F.when(bad, F.col("source"))) < 5).alias("narrow"))


@query("agg44_sft_report", f"SELECT {SPLIT_D} AS split, round(sum(CASE WHEN quality = 1 THEN 1.0 WHEN quality = 0 THEN 0.25 ELSE 0.5 END), 2)::DOUBLE AS effective, count(*) FILTER (WHERE quality IS NULL) AS missing FROM {_D} GROUP BY 1")
def _(t):
    w = F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, 0.25).otherwise(0.5)
    return labelled(t).groupBy(split_of(F.col("doc_id")).alias("split")).agg(F.round(F.sum(w), 2).alias("effective"), F.count_if(F.col("quality").isNull()).alias("missing"))


@query("agg47_leak_counters", f"WITH a AS (SELECT {SPLIT} AS split, sha256({NORM.format('text')}) AS h FROM documents) SELECT (SELECT count(DISTINCT h) FROM a WHERE split = 'train' AND h IN (SELECT h FROM a WHERE split <> 'train')) AS exact_overlap, (SELECT count(*) - count(DISTINCT h) FROM a) AS mirrors")
def _(t):
    a = t.documents.select(split_of(F.col("doc_id")).alias("split"), tx.text_hash(F.col("text")).alias("h"))
    by = a.groupBy("h").agg(F.bool_or(F.col("split") == "train").alias("tr"), F.bool_or(F.col("split") != "train").alias("ev"), F.count("*").alias("n"))
    return by.agg(F.count_if(F.col("tr") & F.col("ev")).alias("exact_overlap"), F.sum(F.col("n") - 1).alias("mirrors"))


@query("set01_capped_union", "WITH b AS (SELECT doc_id FROM documents WHERE lang = 'en'), s AS (SELECT doc_id FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT (SELECT floor(count(*) * 0.25 / 0.75)::BIGINT FROM b)), c AS (SELECT doc_id FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT (SELECT floor(((SELECT count(*) FROM b) + (SELECT count(*) FROM s)) * 0.1 / 0.9)::BIGINT)) SELECT 'base' AS part, count(*) AS n FROM b UNION ALL SELECT 'synthetic', count(*) FROM s UNION ALL SELECT 'contrastive', count(*) FROM c")
def _(t):
    part = lambda lang, name: t.documents.where(F.col("lang") == lang).select("doc_id", F.lit(name).alias("part"))
    two = rows.share_capped(part("en", "base").unionByName(part("de", "synthetic")), F.col("part") == "synthetic", ["doc_id"], 0.25)
    three = rows.share_capped(two.unionByName(part("fr", "contrastive")), F.col("part") == "contrastive", ["doc_id"], 0.1)
    return three.groupBy("part").agg(F.count("*").alias("n"))


@query("set03_key_sets", "SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)) AS shared, (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)) AS only_customers")
def _(t):
    c, s = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    both, only = c.intersect(s).agg(F.count("*").alias("shared")), c.subtract(s).agg(F.count("*").alias("only_customers"))
    return both.crossJoin(only)


@query("str02_canonical_json", "SELECT n_nationkey, sha256('{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}') AS h FROM nation")
def _(t):
    return t.nation.select("n_nationkey", canonical.json_hash({"region": F.col("n_regionkey"), "name": F.col("n_name"), "key": F.col("n_nationkey")}).alias("h"))


@query("str05_word_template", r"SELECT doc_id, substr(sha256(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '<tag>', 'g'), '\d+(?:\.\d+)?', '<num>', 'g'), '\b[01]+\b', '<bin>', 'g'), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'), '[a-z]{4,}', '<word>', 'g')), 1, 12) AS template FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.word_template(F.col("text")).alias("template"))


@query("str17_family_answer", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN lpad((p_size)::VARCHAR, 4, '0') ELSE trim(replace(p_brand, 'Brand#', '')) END AS answer FROM part")
def _(t):
    k = F.col("p_partkey") % 3
    return t.part.select("p_partkey", F.when(k == 0, F.upper("p_name")).when(k == 1, F.lpad(F.col("p_size").cast("string"), 4, "0")).otherwise(F.trim(F.replace("p_brand", F.lit("Brand#"), F.lit("")))).alias("answer"))


@query("str20_canonical_answer", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 1000)::VARCHAR WHEN o_orderkey % 4 = 1 THEN (o_orderkey % 1000)::VARCHAR || '.5' WHEN o_orderkey % 4 = 2 THEN 'x' || o_orderkey % 7 ELSE '1/2' END AS canonical FROM orders")
def _(t):
    n, k = (F.col("o_orderkey") % 1000).cast("string"), F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.concat(F.lit(" +"), n, F.lit(".00"))).when(k == 1, F.concat(F.lit("0"), n, F.lit(".50"))).when(k == 2, F.concat(F.lit("X"), (F.col("o_orderkey") % 7).cast("string"), F.lit(" "))).otherwise(F.lit("2/4"))
    return t.orders.select("o_orderkey", canonical.answer(raw).alias("canonical"))


@query("str14_truncation_risk", "SELECT p_partkey, p_partkey % 2 = 1 AS risky FROM part")
def _(t):
    text = F.concat(F.lit("so \\boxed{"), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 1, "").otherwise("}"))
    return t.part.select("p_partkey", answers.boxed(text).isNull().alias("risky"))


@query("arr03_proof_summary", "SELECT o_custkey, round(count(*) FILTER (WHERE o_orderstatus = 'O')::DOUBLE / count(*), 6) AS open, round(count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / count(*), 6) AS discharged FROM orders GROUP BY o_custkey")
def _(t):
    a = t.orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("s"))
    part = lambda v: F.round(F.size(F.filter("s", lambda x: x["o_orderstatus"] == v)) / F.size("s"), 6)
    return a.select("o_custkey", part("O").alias("open"), part("F").alias("discharged"))


@query("ret06_compatibility", r"WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) SELECT item_id, round(least(1.0, 0.6 * len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'to')))::DOUBLE / 4 + 0.4 * len(list_filter(w, lambda x: length(x) > 6))::DOUBLE / len(w)), 6)::DOUBLE AS score FROM b")
def _(t):
    w = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    b = t.benchmark.select("item_id", w.alias("w"))
    common = F.size(F.array_intersect("w", F.array(*[F.lit(x) for x in ("the", "of", "and", "to")]))) / 4
    return b.select("item_id", F.round(num.clamp(0.6 * common + 0.4 * F.size(F.filter("w", lambda x: F.char_length(x) > 6)) / F.size("w")), 6).alias("score"))


@query("smp03_balanced_round_robin", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY r, lang) AS place FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= CASE lang WHEN 'es' THEN 10 ELSE 40 END) WHERE place <= 120")
def _(t):
    few = rows.capped(t.documents, "lang", ["doc_id"], {"es": 10}, 40)
    return rows.interleaved(few, "lang", ["doc_id"], 120).select("doc_id")


@query("smp08_weighted_sft", f"WITH n AS (SELECT count(*) AS n FROM labels WHERE quality = 1) SELECT 'direct' AS part, (SELECT n FROM n) AS n UNION ALL SELECT 'corrected', least((SELECT n // 2 FROM n), (SELECT count(*) FROM labels WHERE quality = 0)) FROM n")
def _(t):
    direct = t.labels.where("quality = 1").select("doc_id", F.lit("direct").alias("part"))
    corrected = t.labels.where("quality = 0").orderBy(F.sha2(F.concat(F.lit("w"), F.col("doc_id").cast("string")), 256)).limit(direct.count() // 2).select("doc_id", F.lit("corrected").alias("part"))
    return direct.unionByName(corrected).groupBy("part").agg(F.count("*").alias("n"))


@query("smp09_oversample", "WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), m AS (SELECT max(n) AS m FROM s) SELECT source, m AS copies FROM s, m")
def _(t):
    return curriculum.oversample(t.documents.select("doc_id", "source"), "source", ["doc_id"]).groupBy("source").agg(F.count("*").alias("copies"))


@query("smp10_coverage")
def _(t):
    novelty = F.least(F.lit(1.0), F.col("n_chars") / 400)
    d = t.documents.select("doc_id", "source", "lang", novelty.alias("novelty"), hard().alias("hard"), F.least(F.lit(1.0), 0.5 * hard() + 0.4).alias("private_like"), tx.word_template(F.col("text")).alias("k"), tx.text_hash(F.col("text")).alias("h"))
    d = d.join(t.labels.select("doc_id", F.col("toxic").alias("ambiguity")), "doc_id", "left")  # texts are not shuffled
    private = d.where(split_of(F.col("doc_id")) == "holdout").select("h").distinct()
    c = d.where((F.coalesce("ambiguity", F.lit(1.0)) <= 0.35) & (F.col("novelty") >= 0.45) & (F.col("hard") >= 0.45)).join(private, "h", "left_anti")
    order = [~F.col("lang").isin("de", "fr"), -F.col("private_like"), -F.col("novelty"), F.col("lang"), F.col("source")]
    return curriculum.cover(c, "doc_id", "source", "k", order, 15, 2, 4000, 600)


@query("smp12_private_like_tail", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS r FROM documents) WHERE r <= 15")
def _(t):
    return rows.top_per_group(t.documents, ["lang"], [F.desc("doc_id")], 15).select("doc_id")


@query("smp13_stages", "WITH m AS (SELECT count(*) AS n FROM documents) SELECT 'micro' AS stage, least(64, n) AS n FROM m UNION ALL SELECT 'v1', least(6000, n) FROM m UNION ALL SELECT 'v2', least(6000, n) + least(n, floor(least(6000, n) * 0.25 / 0.75)::BIGINT) FROM m")
def _(t):
    return curriculum.stages(t.documents.select("doc_id"), "doc_id", 64, 6000, 0.25)


@query("smp14_contrastive", "SELECT doc_id FROM labels WHERE quality = 1 ORDER BY doc_id LIMIT (SELECT floor(count(*) * 0.15)::BIGINT FROM labels)")
def _(t):
    return t.labels.where("quality = 1").orderBy("doc_id").limit(int(t.labels.count() * 0.15)).select("doc_id")


@query("smp18_balanced_shuffle", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('q' || doc_id), doc_id) AS turn FROM documents")
def _(t):
    w = Window.partitionBy("lang").orderBy(F.sha2(F.concat(F.lit("q"), F.col("doc_id").cast("string")), 256), "doc_id")
    return t.documents.select("doc_id", F.row_number().over(w).cast("long").alias("turn"))


@query("smp19_scaled_counts", "WITH n AS (SELECT lang, count(*) AS n, sum(count(*)) OVER () AS t FROM documents GROUP BY lang) SELECT lang, round(n * 500.0 / t)::BIGINT AS target FROM n")
def _(t):
    n = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    return n.select("lang", F.round(F.col("n") * 500.0 / F.sum("n").over(Window.partitionBy())).cast("long").alias("target"))


@query("evl01_exact_match", "SELECT p_brand, round(avg((p_size % 5 <> 0)::INT), 6) AS exact FROM part GROUP BY p_brand")
def _(t):
    said = F.concat(F.lit("the answer is \\boxed{"), F.when(F.col("p_size") % 5 == 0, "none").otherwise(F.col("p_size").cast("string")), F.lit("}"))
    return t.part.withColumn("got", answers.boxed(said)).groupBy("p_brand").agg(F.round(num.share(F.col("got") == F.col("p_size").cast("string")), 6).alias("exact"))


@query("evl03_brier", "SELECT round(avg((least(1.0, o_totalprice / 500000) - (o_orderstatus = 'F')::INT) ** 2), 6) AS brier FROM orders")
def _(t):
    p = F.least(F.lit(1.0), F.col("o_totalprice") / 500000)
    return t.orders.agg(F.round(F.avg(F.pow(p - (F.col("o_orderstatus") == "F").cast("int"), 2)), 6).alias("brier"))


@query("evl16_difficulty", f"SELECT doc_id, CASE WHEN {HARD} >= 0.7 THEN 'hard' WHEN {HARD} >= 0.45 THEN 'medium' ELSE 'easy' END AS band FROM documents")
def _(t):
    return t.documents.select("doc_id", F.when(hard() >= 0.7, "hard").when(hard() >= 0.45, "medium").otherwise("easy").alias("band"))


@query("evl18_prior_shaping", "WITH a AS (SELECT event_type, count(*)::DOUBLE / sum(count(*)) OVER () AS p, avg((value > 50)::INT) AS q FROM events GROUP BY 1), b AS (SELECT event_type, 0.6 * p + 0.3 * q + 0.02 AS x FROM a) SELECT event_type, round(x / sum(x) OVER (), 6) AS prior FROM b")
def _(t):
    w = Window.partitionBy()
    a = t.events.groupBy("event_type").agg(F.count("*").alias("n"), num.share(F.col("value") > 50).alias("q"))
    x = a.select("event_type", (0.6 * F.col("n") / F.sum("n").over(w) + 0.3 * F.col("q") + 0.02).alias("x"))
    return x.select("event_type", F.round(F.col("x") / F.sum("x").over(w), 6).alias("prior"))


@query("top11_prior_top_k", "WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) <= 2")
def _(t):
    a = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return rows.top_per_group(a, ["user_id"], [F.desc("n"), "event_type"], 2).select("user_id", "event_type")


@query("evl20_attribution", "WITH c AS (SELECT event_id, 0.5 * (value > 100)::INT AS a, 0.3 * (event_type = 'error')::INT AS b, 0.2 * (event_id % 2) AS c FROM events) SELECT CASE WHEN a >= b AND a >= c AND a > 0 THEN 'value' WHEN b >= c AND b > 0 THEN 'error' WHEN c > 0 THEN 'parity' ELSE 'none' END AS cause, count(*) AS n FROM c GROUP BY 1")
def _(t):
    c = t.events.select((0.5 * (F.col("value") > 100).cast("int")).alias("a"), (0.3 * (F.col("event_type") == "error").cast("int")).alias("b"), (0.2 * (F.col("event_id") % 2)).alias("c"))
    cause = F.when((F.col("a") >= F.col("b")) & (F.col("a") >= F.col("c")) & (F.col("a") > 0), "value").when((F.col("b") >= F.col("c")) & (F.col("b") > 0), "error").when(F.col("c") > 0, "parity").otherwise("none")
    return c.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


@query("grf08_snapshot", "SELECT 'nodes' AS part, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n UNION ALL SELECT 'edges', count(*) FROM nation")
def _(t):
    n = t.nation.select(F.lit("nodes").alias("part")).unionAll(t.region.select(F.lit("nodes").alias("part"))).unionAll(t.nation.select(F.lit("edges").alias("part")))
    return n.groupBy("part").agg(F.count("*").alias("n"))


@query("grf01_merge_nodes", "WITH f AS (SELECT p_partkey, p_brand || '|' || p_type AS h, p_retailprice FROM part) SELECT h, min(p_partkey) AS canonical, count(*) - 1 AS aliases, min(p_retailprice) AS cost FROM f GROUP BY h")
def _(t):
    h = F.concat_ws("|", "p_brand", "p_type")
    return t.part.groupBy(h.alias("h")).agg(F.min("p_partkey").alias("canonical"), (F.count("*") - 1).alias("aliases"), F.min("p_retailprice").alias("cost"))


@query("udf13_program_check", "SELECT p_partkey, TRUE AS passed FROM part")
def _(t):
    r = solvers.run_programs(t.part, "p_partkey", "p_name", ["split|join: "])
    return r.join(t.part.select("p_partkey", "p_name"), "p_partkey").select("p_partkey", (F.col("result") == F.col("p_name")).alias("passed"))


@query("udf14_shadow_verifier", "SELECT o_orderkey, o_totalprice > 1000 AND o_orderstatus IN ('F', 'O', 'P') AND o_custkey >= 0 AS verified FROM orders")
def _(t):
    return t.orders.select("o_orderkey", ((F.col("o_totalprice") > 1000) & F.col("o_orderstatus").isin("F", "O", "P") & (F.col("o_custkey") >= 0)).alias("verified"))


@query("udf22_synthesis", "SELECT p_partkey, 'upper' AS program FROM part")
def _(t):
    return curriculum.synthesise(t.part.select("p_partkey", F.col("p_name").alias("given"), F.upper("p_name").alias("wanted")), "p_partkey", ["lower", "mirror", "upper", "upper|unique"])


@query("stm04_budget", "WITH c AS (SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) SELECT user_id, count(*) FILTER (WHERE spent <= 1000) AS within, count(*) FILTER (WHERE spent > 1000) AS over_ FROM c GROUP BY user_id")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    c = t.events.select("user_id", num.running_at_most(F.col("value"), 1000, w).alias("within"))
    return c.groupBy("user_id").agg(F.count_if("within").alias("within"), F.count_if(~F.col("within")).alias("over_"))


@query("gte06_private_gate", f"WITH m AS (SELECT count(*) AS n, avg(quality) AS acc, avg(toxic) AS bad FROM {_D} WHERE {SPLIT_D} = 'holdout') SELECT n, round(acc, 6) AS accuracy, CASE WHEN n < 30 THEN 'too_few' WHEN acc < 0.8 THEN 'low_accuracy' WHEN bad > 0.2 THEN 'unsafe' ELSE 'pass' END AS gate FROM m")
def _(t):
    m = labelled(t).where(split_of(F.col("doc_id")) == "holdout").agg(F.count("*").alias("n"), F.avg("quality").alias("acc"), F.avg("toxic").alias("bad"))
    return m.select("n", F.round("acc", 6).alias("accuracy"), F.when(F.col("n") < 30, "too_few").when(F.col("acc") < 0.8, "low_accuracy").when(F.col("bad") > 0.2, "unsafe").otherwise("pass").alias("gate"))


@query("nbk14_seeded_sample", "SELECT event_id FROM (SELECT event_id FROM events ORDER BY sha256('z' || event_id), event_id LIMIT 300) ORDER BY event_id")
def _(t):
    return readers.selected(t.events.select("event_id"), "event_id", seed="z", limit=300)


@query("nbk21_hard_negative_flag", f"SELECT d.doc_id, source = 'src3' OR (coalesce(quality, 1) < 0.5 AND {HARD.replace('doc_id', 'd.doc_id')} >= 0.4) AS hard_negative FROM {_D}")
def _(t):
    return labelled(t).select("doc_id", ((F.col("source") == "src3") | ((F.coalesce("quality", F.lit(1)) < 0.5) & (hard() >= 0.4))).alias("hard_negative"))


@query("jn08_source_audit", f"WITH a AS (SELECT {SPLIT} AS split, source, lang FROM documents) SELECT split, count(DISTINCT source) FILTER (WHERE split <> 'train' AND source IN (SELECT source FROM a WHERE split = 'train')) AS shared_sources, count(*) FILTER (WHERE lang IS NULL) AS missing FROM a GROUP BY split")
def _(t):
    a = t.documents.select(split_of(F.col("doc_id")).alias("split"), "source", "lang")
    seen = a.where("split = 'train'").select("source", F.lit(True).alias("seen")).distinct()
    j = a.join(seen, "source", "left")
    return j.groupBy("split").agg(F.count_distinct(F.when((F.col("split") != "train") & F.col("seen"), F.col("source"))).alias("shared_sources"), F.count_if(F.col("lang").isNull()).alias("missing"))


@query("jn10_semantic_holdout", f"WITH a AS (SELECT {SPLIT} AS split, source, lang FROM documents), k AS (SELECT DISTINCT split, 'source' AS kind, source AS key FROM a UNION SELECT DISTINCT split, 'lang', lang FROM a) SELECT h.kind, o.split AS other, count(*) AS shared FROM k h JOIN k o ON h.kind = o.kind AND h.key = o.key AND h.split = 'holdout' AND o.split <> 'holdout' GROUP BY 1, 2")
def _(t):
    k = sets.keys_of(t.documents.withColumn("split", split_of(F.col("doc_id"))), {"source": F.col("source"), "lang": F.col("lang")}, "split").distinct()
    h = k.where("split = 'holdout'").select("kind", "key")
    return k.where("split <> 'holdout'").join(h, ["kind", "key"]).groupBy("kind", F.col("split").alias("other")).agg(F.count("*").alias("shared"))


_PARENT = "SELECT event_id, user_id, event_type, CASE WHEN event_type = 'click' THEN 'train' WHEN event_type = 'error' THEN 'holdout' ELSE 'dev' END AS split, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM events"


def _parents(t):
    split = F.when(F.col("event_type") == "click", "train").when(F.col("event_type") == "error", "holdout").otherwise("dev")
    return t.events.select("event_id", split.alias("split"), F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("parent"))


@query("jn13_lineage", f"WITH e AS ({_PARENT}) SELECT a.event_id, b.split AS parent_split FROM e a JOIN e b ON a.parent = b.event_id WHERE a.split = 'train' AND b.split <> 'train'")
def _(t):
    e = _parents(t)
    b = e.select(F.col("event_id").alias("parent"), F.col("split").alias("parent_split"))
    return e.where("split = 'train'").join(b, "parent").where("parent_split <> 'train'").select("event_id", "parent_split")


@query("jn14_created_from", f"WITH e AS ({_PARENT}) SELECT b.split AS origin, count(*) AS n FROM e a JOIN e b ON a.parent = b.event_id WHERE a.split = 'train' GROUP BY 1")
def _(t):
    e = _parents(t)
    return e.where("split = 'train'").select("parent").join(e.select(F.col("event_id").alias("parent"), F.col("split").alias("origin")), "parent").groupBy("origin").agg(F.count("*").alias("n"))


@query("jn12_contamination_report", f"""
WITH a AS (SELECT doc_id, {SPLIT} AS split, sha256({NORM.format('text')}) AS h, sha256(text) AS x FROM documents),
f AS (SELECT doc_id, 'prompt' AS flag FROM a WHERE split = 'train' AND x IN (SELECT x FROM a WHERE split <> 'train') UNION ALL SELECT doc_id, 'normalised_prompt' FROM a WHERE split = 'train' AND h IN (SELECT h FROM a WHERE split <> 'train')
      UNION ALL SELECT doc_id, 'duplicate_id' FROM (SELECT doc_id, count(*) AS c FROM a GROUP BY 1) WHERE c > 1)
SELECT flag, count(*) AS n FROM f GROUP BY flag""")
def _(t):
    a = t.documents.select("doc_id", split_of(F.col("doc_id")).alias("split"), tx.text_hash(F.col("text")).alias("h"), F.sha2("text", 256).alias("x"))
    k = sets.keys_of(a, {"normalised_prompt": F.col("h"), "prompt": F.col("x")}, "doc_id", "split")
    crossed = sets.overlap(k.where("split = 'train'"), k.where("split <> 'train'")).select("doc_id", F.col("kind").alias("flag"))
    twice = a.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id", F.lit("duplicate_id").alias("flag"))
    return crossed.unionByName(twice).groupBy("flag").agg(F.count("*").alias("n"))


@query("jn19_hard_examples", f"SELECT d.doc_id FROM {_D} WHERE quality IS NULL AND n_chars > 5000 OR quality = 0 AND lang IN ('de', 'fr')")
def _(t):
    return labelled(t).where("(quality IS NULL AND n_chars > 5000) OR (quality = 0 AND lang IN ('de', 'fr'))").select("doc_id")


@query("smp07_bucket_split", f"SELECT CASE WHEN {CODE} IS NOT NULL THEN 'quarantine' WHEN {unit('bucket', 'doc_id')} < 0.85 THEN 'train' ELSE 'eval' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    b = F.when(code().isNotNull(), "quarantine").when(num.salted_unit("bucket", F.col("doc_id")) < 0.85, "train").otherwise("eval")
    return t.documents.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
