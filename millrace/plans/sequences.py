"""Queries over events, conversations and the hierarchy: runs, neighbours, chains, graphs, folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import numbers as num
from millrace.operators import graphs, measures, rows, sequences
from millrace.operators.lineage import cut
from millrace.plans.registry import query

SEQ = (["user_id"], ["ts", "event_id"], "event_type")


@query("win06_longest_run", """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, max(n) AS longest_run FROM (SELECT user_id, event_type, g, count(*) AS n FROM a GROUP BY ALL) GROUP BY user_id""")
def _(t):
    return sequences.longest_run(t.events, *SEQ)


_PAIRS = "WITH p AS (SELECT event_type AS item, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following, value FROM events), n AS (SELECT item, following, count(*) AS n FROM p WHERE following IS NOT NULL GROUP BY item, following)"


@query("agg23_neighbours", _PAIRS + " , r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, following) AS rank FROM n) SELECT item, following, n, rank, round(n::DOUBLE / sum(n) OVER (PARTITION BY item), 6) AS weight FROM r WHERE rank <= 5")
def _(t):
    top = sequences.top_neighbours(sequences.neighbours(t.events, *SEQ), 5)
    return top.select("item", "following", "n", F.col("rank").cast("long").alias("rank"), "weight")


@query("agg23_weighted_neighbours", "WITH p AS (SELECT event_type AS item, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following, CASE WHEN value > 100 THEN 3 ELSE 1 END AS w FROM events) SELECT item, following, sum(w)::BIGINT AS n FROM p WHERE following IS NOT NULL GROUP BY item, following")
def _(t):
    return sequences.neighbours(t.events, *SEQ, weight=F.when(F.col("value") > 100, 3).otherwise(1))


@query("nbk15_ngrams", """
WITH p AS (SELECT event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT a || '>' || b AS gram, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY 1 UNION ALL SELECT a || '>' || b || '>' || c, count(*) FROM p WHERE c IS NOT NULL GROUP BY 1""")
def _(t):
    return sequences.ngrams(t.events, *SEQ, 2).unionByName(sequences.ngrams(t.events, *SEQ, 3))


@query("nbk16_co_occurrence", "WITH s AS (SELECT DISTINCT user_id, ts::DATE AS day, event_type FROM events) SELECT a.event_type AS item_a, b.event_type AS item_b, count(*) AS n FROM s a JOIN s b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type < b.event_type GROUP BY 1, 2")
def _(t):
    return sequences.co_occurrence(t.events.withColumn("day", F.to_date("ts")), ["user_id", "day"], "event_type")


@query("nbk17_cluster_histogram", "WITH f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), s AS (SELECT user_id, string_agg(event_type, '|' ORDER BY r) AS key FROM f WHERE r <= 2 GROUP BY user_id) SELECT key, count(*) AS n FROM s GROUP BY key")
def _(t):
    first = rows.top_per_group(t.events.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))), ["user_id"], ["ts", "event_id"], 2)
    key = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "event_type"))), lambda x: x["event_type"]), "|")
    return first.groupBy("user_id").agg(key.alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("nbk18_attempt_stats", """
WITH p AS (SELECT event_type, value, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_type, count(*) AS attempts, count(*) FILTER (WHERE value > 50) AS successes, count(*) FILTER (WHERE before = event_type) AS repeats, count(DISTINCT after) AS followers FROM p GROUP BY event_type""")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = t.events.select("event_type", "value", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"))
    return p.groupBy("event_type").agg(F.count("*").alias("attempts"), F.count_if(F.col("value") > 50).alias("successes"), F.count_if(F.col("before") == F.col("event_type")).alias("repeats"), F.count_distinct("after").alias("followers"))


_SUPPORT = "SELECT event_type, count(*) AS support, round(avg((value > 50)::INT), 6) AS success, round(avg(value), 6) AS mean_gain, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"


@query("agg22_operator_mining", _SUPPORT)
def _(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("support"), F.round(num.share(F.col("value") > 50), 6).alias("success"), F.round(F.avg("value"), 6).alias("mean_gain"), F.count_distinct("user_id").alias("users"))


@query("agg24_reliability", f"WITH s AS ({_SUPPORT}) SELECT event_type, round(greatest(0.0, least(1.0, 0.3 * support / 3000 + 0.3 * success + 0.2 * mean_gain / 100 + 0.2 * users / 200)), 6)::DOUBLE AS reliability FROM s")
def _(t):
    s = t.events.groupBy("event_type").agg(F.count("*").alias("support"), F.round(num.share(F.col("value") > 50), 6).alias("success"), F.round(F.avg("value"), 6).alias("mean_gain"), F.count_distinct("user_id").alias("users"))
    score = 0.3 * F.col("support") / 3000 + 0.3 * F.col("success") + 0.2 * F.col("mean_gain") / 100 + 0.2 * F.col("users") / 200
    return s.select("event_type", F.round(num.clamp(score), 6).alias("reliability"))


_DIST = "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, event_type, n::DOUBLE / sum(n) OVER (PARTITION BY user_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r, count(*) OVER (PARTITION BY user_id) AS k FROM n)"


def _distribution(t):
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id")
    return n.select("user_id", "event_type", (F.col("n") / F.sum("n").over(w)).alias("p"), F.row_number().over(w.orderBy(F.desc("n"), "event_type")).alias("r"), F.count("*").over(w).alias("k"))


@query("mth04_entropy", _DIST + " SELECT user_id, round(-sum(p * ln(greatest(p, 1e-12))) / ln(5), 6) AS entropy FROM p GROUP BY user_id")
def _(t):
    return _distribution(t).groupBy("user_id").agg(F.round(-F.sum(F.col("p") * F.log(F.greatest("p", F.lit(1e-12)))) / F.log(F.lit(5.0)), 6).alias("entropy"))


@query("mth05_entropy_bits", _DIST + " SELECT user_id, CASE WHEN max(k) > 1 THEN round(-sum(p * log2(p)) / log2(max(k)), 6) ELSE 0 END AS entropy FROM p GROUP BY user_id")
def _(t):
    return _distribution(t).groupBy("user_id").agg(F.when(F.max("k") > 1, F.round(-F.sum(F.col("p") * F.log2("p")) / F.log2(F.max("k")), 6)).otherwise(F.lit(0.0)).alias("entropy"))


@query("mth06_distribution_summary", _DIST + " SELECT user_id, max(CASE WHEN r = 1 THEN event_type END) AS top, round(max(CASE WHEN r = 1 THEN p END) - coalesce(max(CASE WHEN r = 2 THEN p END), 0), 6) AS margin, round(0.6 * max(CASE WHEN r = 1 THEN p END) + 0.4 * (max(CASE WHEN r = 1 THEN p END) - coalesce(max(CASE WHEN r = 2 THEN p END), 0)), 6) AS consensus FROM p GROUP BY user_id")
def _(t):
    at = lambda k, c: F.max(F.when(F.col("r") == k, F.col(c)))
    margin = at(1, "p") - F.coalesce(at(2, "p"), F.lit(0.0))
    return _distribution(t).groupBy("user_id").agg(at(1, "event_type").alias("top"), F.round(margin, 6).alias("margin"), F.round(0.6 * at(1, "p") + 0.4 * margin, 6).alias("consensus"))


@query("top06_vote_top_k", _DIST + " SELECT user_id, string_agg(event_type, ',' ORDER BY r) AS top3 FROM p WHERE r <= 3 GROUP BY user_id")
def _(t):
    return _distribution(t).where("r <= 3").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "event_type"))), lambda x: x["event_type"]), ",").alias("top3"))


@query("win14_share_of_partition", "SELECT user_id, event_type, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM events GROUP BY user_id, event_type")
def _(t):
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.select("user_id", "event_type", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("user_id")), 6).alias("share"))


@query("win08_representative", "SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def _(t):
    best = F.max_by(F.struct("event_id", "user_id"), F.struct("value", -F.col("event_id")))
    return t.events.groupBy("event_type").agg(best.alias("b")).select("event_type", "b.event_id", "b.user_id")


@query("win13_unique_best", "SELECT user_id, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS only_type, count(DISTINCT event_type) AS outputs FROM events WHERE value > 150 GROUP BY user_id")
def _(t):
    n = F.count_distinct("event_type")
    return t.events.where("value > 150").groupBy("user_id").agg(F.when(n == 1, F.min("event_type")).alias("only_type"), n.alias("outputs"))


@query("agg36_timer", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, arg_max(value, event_id) AS last FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.max_by("value", "event_id").alias("last"))


@query("agg37_histogram", "SELECT event_type, CASE WHEN value <= 10 THEN 0 WHEN value <= 50 THEN 1 WHEN value <= 100 THEN 2 WHEN value <= 200 THEN 3 ELSE 4 END AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    edges = (10, 50, 100, 200)
    b = None
    for k, e in enumerate(edges):
        b = F.when(F.col("value") <= e, k) if b is None else b.when(F.col("value") <= e, k)
    return t.events.groupBy("event_type", b.otherwise(len(edges)).alias("bucket")).agg(F.count("*").alias("n"))


@query("agg38_latency", "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


@query("agg39_nearest_rank", "SELECT user_id, list_sort(list(value))[round_even((count(*) - 1) * 0.95::DOUBLE, 0)::INT + 1] AS p95 FROM events GROUP BY user_id")
def _(t):
    return measures.nearest_rank_rows(t.events, ["user_id"], "value", 0.95, "p95")


@query("agg31_loss_history", "SELECT user_id, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, min(value) AS least, max(value) AS most, count(*) FILTER (WHERE isnan(value) OR isinf(value)) AS odd FROM events GROUP BY user_id")
def _(t):
    odd = F.isnan("value") | (F.abs("value") == float("inf"))
    return t.events.groupBy("user_id").agg(F.min_by("value", "event_id").alias("first"), F.max_by("value", "event_id").alias("last"), F.min("value").alias("least"), F.max("value").alias("most"), F.count_if(odd).alias("odd"))


@query("agg40_weighted_loss", "SELECT user_id, round(sum(value * (event_id % 3)) / nullif(sum(event_id % 3), 0), 6) AS loss FROM events GROUP BY user_id")
def _(t):
    w = F.col("event_id") % 3
    return t.events.groupBy("user_id").agg(F.round(F.try_divide(F.sum(F.col("value") * w), F.sum(w)), 6).alias("loss"))


@query("man03_chain_check", "WITH c AS (SELECT event_id, user_id, event_id * 7 % 1000 AS out_hash, CASE WHEN event_id % 50 = 0 THEN -1 ELSE lag(event_id * 7 % 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS in_hash, lag(event_id * 7 % 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, count(*) AS broken FROM c WHERE before IS NOT NULL AND in_hash IS DISTINCT FROM before GROUP BY user_id")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    out = F.col("event_id") * 7 % 1000
    c = t.events.withColumn("in_hash", F.when(F.col("event_id") % 50 == 0, -1).otherwise(F.lag(out).over(w)))
    return sequences.broken_links(c, ["user_id"], ["ts", "event_id"], F.col("in_hash"), F.col("event_id") * 7 % 1000).groupBy("user_id").agg(F.count("*").alias("broken"))


@query("flt14_metric_series", "SELECT CASE WHEN value IS NULL OR isnan(value) THEN 'not_finite' WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'unknown_metric' WHEN value > 200 THEN 'out_of_bounds' ELSE 'ok' END AS code, count(*) AS n FROM events GROUP BY 1")
def _(t):
    code = rows.error_code(("not_finite", F.col("value").isNull() | F.isnan("value")), ("unknown_metric", ~F.col("event_type").isin("view", "click", "purchase")), ("out_of_bounds", F.col("value") > 200))
    return t.events.groupBy(F.coalesce(code, F.lit("ok")).alias("code")).agg(F.count("*").alias("n"))


@query("map02_props", "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
def _(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("event_id", k.alias("k"))


@query("dat01_utc_format", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((microsecond(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS utc FROM events")
def _(t):
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("utc"))


@query("stm03_running_counter", "SELECT event_id, count(*) OVER w AS seen, round(sum(value) OVER w, 4) AS total, max(value) OVER w AS most FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def _(t):
    w = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.count("*").over(w).alias("seen"), F.round(F.sum("value").over(w), 4).alias("total"), F.max("value").over(w).alias("most"))


@query("stm05_stop_on_consensus", """
WITH c AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sample, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS votes FROM events)
SELECT user_id, min(sample) AS stop_at FROM c WHERE votes >= greatest(2, ceil(sample * 0.5)) GROUP BY user_id""")
def _(t):
    order = ["ts", "event_id"]
    c = t.events.withColumn("sample", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)).cast("long")).withColumn("votes", F.count("*").over(Window.partitionBy("user_id", "event_type").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return c.where(F.col("votes") >= F.greatest(F.lit(2), F.ceil(F.col("sample") * 0.5))).groupBy("user_id").agg(F.min("sample").alias("stop_at"))


@query("stm06_training_safety", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value FROM events) SELECT user_id, min(step) FILTER (WHERE value > 250) AS stop_step, arg_min(value, step) AS first_loss, min(value) AS least FROM r GROUP BY user_id")
def _(t):
    r = t.events.withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    return r.groupBy("user_id").agg(F.min(F.when(F.col("value") > 250, F.col("step"))).alias("stop_step"), F.min_by("value", "step").alias("first_loss"), F.min("value").alias("least"))


@query("nbk09_diminishing_returns", """
WITH a AS (SELECT hour(ts)::BIGINT AS axis, round(avg(value), 4) AS value FROM events GROUP BY 1), d AS (SELECT axis, value, value - lag(value) OVER (ORDER BY axis) AS gain, axis - lag(axis) OVER (ORDER BY axis) AS step FROM a)
SELECT axis, value, round(gain, 6) AS gain, round(gain / step, 6) AS efficiency FROM d""")
def _(t):
    a = t.events.groupBy(F.hour("ts").cast("long").alias("axis")).agg(F.round(F.avg("value"), 4).alias("value"))
    return sequences.diminishing(a, "axis", "value")


_CHAT = """
WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(coalesce(text, '') ORDER BY turn) AS texts FROM conversations GROUP BY conv_id)"""


def _chats(t):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    return t.conversations.groupBy("conv_id").agg(turns.alias("turns"))


_CHAT_RULES = "CASE WHEN roles <> ['user', 'assistant'] THEN 'roles' END, CASE WHEN len(list_filter(texts, lambda x: trim(x) = '')) > 0 THEN 'empty' END, CASE WHEN len(texts[len(texts)]) > 800 THEN 'verbose' END, CASE WHEN len(texts) > 1 AND texts[1] = texts[2] THEN 'copy' END"


@query("flt13_chat_codes", _CHAT + f" SELECT conv_id, array_to_string(list_filter([{_CHAT_RULES}], lambda x: x IS NOT NULL), ',') AS codes FROM c")
def _(t):
    roles = F.transform("turns", lambda x: x["role"])
    texts = F.transform("turns", lambda x: x["text"])
    codes = rows.failures(
        ("roles", roles != F.array(F.lit("user"), F.lit("assistant"))), ("empty", F.exists(texts, lambda x: F.trim(x) == "")), ("verbose", F.char_length(F.element_at(texts, -1)) > 800),
        ("copy", (F.size(texts) > 1) & (F.get(texts, F.lit(0)) == F.get(texts, F.lit(1)))),
    )
    return _chats(t).select("conv_id", F.array_join(codes, ",").alias("codes"))


@query("prj01_messages", "SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS shape, sum(length(coalesce(text, '')))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def _(t):
    c = _chats(t)
    return c.select("conv_id", F.size("turns").cast("long").alias("turns"), F.array_join(F.transform("turns", lambda x: x["role"]), ">").alias("shape"), F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x["text"])).alias("chars"))


@query("arr01_token_masks", "WITH n AS (SELECT conv_id, turn, role, len(regexp_extract_all(coalesce(text, ''), '[^\\s]+')) AS n FROM conversations) SELECT conv_id, sum(n)::BIGINT AS tokens, (coalesce(sum(n) FILTER (WHERE role = 'assistant'), 0))::BIGINT AS supervised FROM n GROUP BY conv_id")
def _(t):
    c = _chats(t).withColumn("w", F.flatten(F.transform("turns", lambda x: F.array_repeat((x["role"] == "assistant").cast("int"), F.regexp_count(x["text"], F.lit(r"[^\s]+"))))))
    return c.select("conv_id", F.size("w").cast("long").alias("tokens"), F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x).alias("supervised"))


@query("arr02_label_spans", "WITH l AS (SELECT conv_id, turn, role, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e, length(coalesce(text, '')) AS n FROM conversations) SELECT conv_id, string_agg((e - n)::BIGINT || '-' || e::BIGINT, ';' ORDER BY turn) AS spans FROM l WHERE role = 'assistant' GROUP BY conv_id")
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    n = F.char_length(F.coalesce("text", F.lit("")))
    spans = t.conversations.select("conv_id", "turn", "role", F.sum(n).over(w).alias("e"), n.alias("n")).where("role = 'assistant'")
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws("-", (F.col("e") - F.col("n")).cast("string"), F.col("e").cast("string")).alias("s"))))
    return spans.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["s"]), ";").alias("spans"))


@query("agg45_truncation_audit", "WITH n AS (SELECT conv_id, sum(length(coalesce(text, '')))::BIGINT AS chars, count(*) FILTER (WHERE role = 'assistant') AS answers FROM conversations GROUP BY conv_id) SELECT count(*) FILTER (WHERE chars > 2000) AS truncated, count(*) FILTER (WHERE answers = 0) AS zero_supervised, list_sort(list(chars))[round_even((count(*) - 1) * 0.95::DOUBLE, 0)::INT + 1] AS p95 FROM n")
def _(t):
    n = cut(t.conversations.groupBy("conv_id").agg(F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("chars"), F.count_if(F.col("role") == "assistant").alias("answers")))
    by_chars = n.groupBy("chars").agg(F.count("*").alias("n"))
    # One row for each length: the value that the rank falls in.
    at = by_chars.select("chars", F.sum("n").over(Window.orderBy("chars")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
    p95 = at.where(F.col("upto") > F.bround((F.col("all") - 1) * F.lit(0.95))).agg(F.min("chars").alias("p95"))
    return n.agg(F.count_if(F.col("chars") > 2000).alias("truncated"), F.count_if(F.col("answers") == 0).alias("zero_supervised")).crossJoin(F.broadcast(p95))


@query("evl14_process_reward", """
WITH RECURSIVE s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, least(1.0, value / 200) AS step FROM events),
f AS (SELECT user_id, i, step, step AS prefix FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.i, s.step, greatest(0.5 * f.prefix + 0.5 * s.step, least(s.step, f.prefix)) FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
SELECT user_id, round(arg_max(prefix, i), 6) AS prefix, round(max(step), 6) AS best FROM f GROUP BY user_id""")
def _(t):
    steps = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.least(F.lit(1.0), F.col("value") / 200).alias("step")))).alias("s"))
    fold = F.aggregate("s", F.lit(-1.0), lambda a, x: F.when(a < 0, x["step"]).otherwise(F.greatest(0.5 * a + 0.5 * x["step"], F.least(x["step"], a))))
    return steps.select("user_id", F.round(fold, 6).alias("prefix"), F.round(F.array_max(F.transform("s", lambda x: x["step"])), 6).alias("best"))


_LINKS = "WITH RECURSIVE links AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL FROM region)"


def _links(t):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        t.customer.select(name("c", "c_custkey").alias("node"), name("n", "c_nationkey").alias("parent"))
        .unionByName(t.nation.select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent")))
        .unionByName(t.region.select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent")))
    )


@query("grf03_root_paths", _LINKS + ", p AS (SELECT node, parent, 0 AS depth, node AS path FROM links WHERE parent IS NULL UNION ALL SELECT l.node, l.parent, p.depth + 1, p.path || '/' || l.node FROM links l JOIN p ON l.parent = p.node) SELECT node, depth, path FROM p")
def _(t):
    return graphs.root_paths(graphs.closure(_links(t)))


@query("grf04_descendants", _LINKS + ", p AS (SELECT node, node AS ancestor FROM links UNION ALL SELECT p.node, l.parent FROM p JOIN links l ON p.ancestor = l.node WHERE l.parent IS NOT NULL) SELECT ancestor AS node, count(*) - 1 AS descendants FROM p GROUP BY ancestor")
def _(t):
    return graphs.closure(_links(t)).groupBy(F.col("ancestor").alias("node")).agg((F.count("*") - 1).alias("descendants"))


@query("grf05_ancestors", _LINKS + ", p AS (SELECT node, parent AS ancestor, 1 AS distance FROM links WHERE parent IS NOT NULL UNION ALL SELECT p.node, l.parent, distance + 1 FROM p JOIN links l ON p.ancestor = l.node WHERE l.parent IS NOT NULL) SELECT node, ancestor, distance FROM p")
def _(t):
    return graphs.closure(_links(t)).where("distance > 0").select("node", "ancestor", "distance")


@query("grf07_leaves", _LINKS + " SELECT node FROM links WHERE node NOT IN (SELECT parent FROM links WHERE parent IS NOT NULL)")
def _(t):
    return graphs.leaves(_links(t))


@query("grf02_alias_resolve", "WITH RECURSIVE l AS (SELECT user_id, event_id, ts, event_type, lag(event_id) OVER w AS before, lag(event_type) OVER w AS type_before, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), a AS (SELECT event_id AS alias, before AS target FROM l WHERE event_type = type_before), r AS (SELECT alias, target, 1 AS d FROM a UNION ALL SELECT r.alias, a.target, d + 1 FROM r JOIN a ON r.target = a.alias) SELECT alias, arg_max(target, d) AS target FROM r GROUP BY alias")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    again = t.events.select(F.col("event_id").alias("alias"), F.lag("event_id").over(w).alias("target"), (F.lag("event_type").over(w) == F.col("event_type")).alias("same"))
    return graphs.resolve(again.where("same").select("alias", "target"))


@query("grf06_equivalence", "SELECT a.n_nationkey AS node, b.n_nationkey AS twin FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(t):
    a, b = t.nation.select(F.col("n_nationkey").alias("node"), "n_regionkey"), t.nation.select(F.col("n_nationkey").alias("twin"), "n_regionkey")
    return a.join(b, "n_regionkey").where("node < twin").select("node", "twin")
