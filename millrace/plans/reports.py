"""Queries of reports and gates over the star schema: groups of groups, grids, baselines, skylines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import numbers as num
from millrace.operators import measures, rows, skyline
from millrace.operators.grouping import grouping_sets
from millrace.operators.ordering import numeric_first, positions, positions_by
from millrace.operators.thresholds import best_threshold
from millrace.plans.registry import query
from millrace.sources import writers

_G1 = "SELECT l_returnflag, l_linestatus, l_shipmode_, count(*) AS n, avg(l_quantity) AS q, sum(l_extendedprice) AS p, avg((l_discount > 0.05)::INT) AS late FROM (SELECT *, l_linenumber AS l_shipmode_ FROM lineitem) GROUP BY ALL"


def _level1(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"), F.avg((F.col("l_discount") > 0.05).cast("int")).alias("late"))


@query("nbk01_groups", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(avg(l_quantity), 6) AS q, round(sum(l_extendedprice), 2) AS p, round(avg((l_discount > 0.05)::INT), 6) AS late FROM lineitem GROUP BY ALL")
def _(t):
    return _level1(t).select("l_returnflag", "l_linestatus", "l_linenumber", "n", F.round("q", 6).alias("q"), F.round("p", 2).alias("p"), F.round("late", 6).alias("late"))


@query("nbk02_group_of_groups", f"WITH a AS ({_G1}) SELECT l_returnflag, l_linestatus, count(*) AS groups_, round(avg(q), 6) AS mean_q, round(avg(late), 6) AS mean_late FROM a GROUP BY ALL")
def _(t):
    return _level1(t).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("groups_"), F.round(F.avg("q"), 6).alias("mean_q"), F.round(F.avg("late"), 6).alias("mean_late"))


@query("nbk03_third_level", f"WITH a AS ({_G1}), b AS (SELECT l_returnflag, l_linestatus, avg(q) AS mean_q FROM a GROUP BY ALL) SELECT l_returnflag, count(DISTINCT l_linestatus) AS folds, round(avg(mean_q), 6) AS mean, round(max(mean_q) - min(mean_q), 6) AS gap, max(mean_q) - min(mean_q) < 0.5 AS stable FROM b GROUP BY l_returnflag")
def _(t):
    b = _level1(t).groupBy("l_returnflag", "l_linestatus").agg(F.avg("q").alias("m"))
    gap = F.max("m") - F.min("m")
    return b.groupBy("l_returnflag").agg(F.count_distinct("l_linestatus").alias("folds"), F.round(F.avg("m"), 6).alias("mean"), F.round(gap, 6).alias("gap"), (gap < 0.5).alias("stable"))


@query("nbk04_stability", "SELECT l_suppkey, round(stddev_pop(l_quantity) / avg(l_quantity), 6) AS cv, max(l_quantity) - min(l_quantity) AS spread, count(DISTINCT l_returnflag) = 1 AS one_flag FROM lineitem GROUP BY l_suppkey")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.stddev_pop("l_quantity") / F.avg("l_quantity"), 6).alias("cv"), (F.max("l_quantity") - F.min("l_quantity")).alias("spread"), (F.count_distinct("l_returnflag") == 1).alias("one_flag"))


@query("nbk05_signature", "SELECT o_custkey, sha256(string_agg(o_orderkey || ':' || o_orderstatus || ':' || left(o_orderpriority, 1), '|' ORDER BY o_orderkey)) AS signature, count(*) AS n FROM orders GROUP BY o_custkey")
def _(t):
    parts = F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus", F.left("o_orderpriority", F.lit(1))).alias("s"))))
    return t.orders.groupBy("o_custkey").agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["s"]), "|"), 256).alias("signature"), F.count("*").alias("n"))


@query("nbk06_variation", "SELECT p_brand, CASE WHEN avg(p_retailprice) <= 0 THEN 0 ELSE round(stddev_pop(p_retailprice) / avg(p_retailprice), 6) END AS cv FROM part GROUP BY p_brand")
def _(t):
    m = F.avg("p_retailprice")
    return t.part.groupBy("p_brand").agg(F.when(m <= 0, 0.0).otherwise(F.round(F.stddev_pop("p_retailprice") / m, 6)).alias("cv"))


@query("nbk07_skyline", "SELECT a.p_partkey, a.p_size, a.p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))")
def _(t):
    return skyline.skyline(t.part, "p_size", "p_retailprice").select("p_partkey", "p_size", "p_retailprice")


@query("nbk08_trade_off", "WITH m AS (SELECT p_brand, avg(p_size) AS a, avg(p_retailprice) AS b FROM part GROUP BY p_brand) SELECT p_brand, round(0.6 * CASE WHEN max(a) OVER () > min(a) OVER () THEN (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) ELSE 1 END + 0.4 * (1 - CASE WHEN max(b) OVER () > min(b) OVER () THEN (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) ELSE 1 END), 6) AS score FROM m")
def _(t):
    m = t.part.groupBy("p_brand").agg(F.avg("p_size").alias("a"), F.avg("p_retailprice").alias("b"))
    w = Window.partitionBy()
    return m.select("p_brand", F.round(0.6 * num.min_max(F.col("a"), w, 1.0) + 0.4 * (1 - num.min_max(F.col("b"), w, 1.0)), 6).alias("score"))


@query("nbk10_stable_semi_join", "SELECT count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING stddev_pop(l_quantity) / avg(l_quantity) < 0.55)")
def _(t):
    stable = t.lineitem.groupBy("l_suppkey").agg((F.stddev_pop("l_quantity") / F.avg("l_quantity")).alias("cv")).where("cv < 0.55").select("l_suppkey")
    return t.lineitem.join(stable, "l_suppkey", "left_semi").agg(F.count("*").alias("n"))


@query("nbk11_mixed_sort_first", "SELECT p_partkey, p_size, p_brand FROM part ORDER BY p_size DESC, p_retailprice DESC, p_brand DESC, p_partkey LIMIT 1")
def _(t):
    return t.part.orderBy(F.desc("p_size"), F.desc("p_retailprice"), F.desc("p_brand"), "p_partkey").limit(1).select("p_partkey", "p_size", "p_brand")


@query("nbk12_axis_rollups", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber))")
def _(t):
    return grouping_sets(t.lineitem, [["l_returnflag"], ["l_linestatus"], ["l_linenumber"]], n=F.count("*"), discount=F.round(F.avg("l_discount"), 6))


@query("nbk13_folds", "WITH f AS (SELECT (row_number() OVER (ORDER BY c_custkey) - 1) % 5 AS fold FROM customer) SELECT fold, count(*) AS n FROM f GROUP BY fold")
def _(t):
    return positions(t.customer.select("c_custkey"), "c_custkey").groupBy((F.col("position") % 5).alias("fold")).agg(F.count("*").alias("n"))


@query("nbk22_calibration_by_split", """
WITH r AS (SELECT o_orderstatus, least(9, floor(least(1.0, o_totalprice / 500000) * 10))::INT AS b, least(1.0, o_totalprice / 500000) AS p, (o_orderpriority <= '3')::INT::DOUBLE AS y FROM orders),
g AS (SELECT o_orderstatus, b, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum((p - y) ** 2) AS sb, sum(((p >= 0.5) = (y >= 0.5))::INT) AS hit FROM r GROUP BY ALL)
SELECT o_orderstatus, sum(n)::BIGINT AS n, round(sum(hit) / sum(n), 6) AS accuracy, round(sum(sb) / sum(n), 6) AS brier, round(sum(abs(sp - sy)) / sum(n), 6) AS ece, round(max(abs(sp - sy) / n), 6) AS mce FROM g GROUP BY o_orderstatus""")
def _(t):
    return measures.calibration_errors(t.orders, F.col("o_totalprice") / 500000, (F.col("o_orderpriority") <= "3").cast("int"), 10, "o_orderstatus")


@query("evl04_calibration_buckets", """
WITH r AS (SELECT least(19, floor(least(1.0, o_totalprice / 600000) * 20))::INT AS bucket, least(1.0, o_totalprice / 600000) AS p, (o_orderpriority <= '3')::INT::DOUBLE AS y FROM orders),
g AS (SELECT bucket, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM r GROUP BY bucket)
SELECT b.bucket::INT AS bucket, coalesce(n, 0) AS n, mean_p, mean_y FROM range(20) b(bucket) LEFT JOIN g ON b.bucket = g.bucket""")
def _(t):
    return measures.calibration_table(t.orders, F.col("o_totalprice") / 600000, (F.col("o_orderpriority") <= "3").cast("int"), 20)


@query("evl06_calibration_summary", """
WITH r AS (SELECT least(9, floor(least(1.0, o_totalprice / 500000) * 10))::INT AS b, least(1.0, o_totalprice / 500000) AS p, (o_orderpriority <= '3')::INT::DOUBLE AS y FROM orders),
g AS (SELECT b, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum((p - y) ** 2) AS sb, sum(((p >= 0.5) = (y >= 0.5))::INT) AS hit FROM r GROUP BY ALL)
SELECT sum(n)::BIGINT AS n, round(sum(hit) / sum(n), 6) AS accuracy, round(sum(sb) / sum(n), 6) AS brier, round(sum(abs(sp - sy)) / sum(n), 6) AS ece, round(max(abs(sp - sy) / n), 6) AS mce FROM g""")
def _(t):
    return measures.calibration_errors(t.orders, F.col("o_totalprice") / 500000, (F.col("o_orderpriority") <= "3").cast("int"), 10)


@query("evl02_accuracy", "SELECT o_orderstatus, round(coalesce(avg((o_totalprice > 250000)::INT), 0), 6) AS accuracy FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_orderstatus").agg(F.round(num.share(F.col("o_totalprice") > 250000), 6).alias("accuracy"))


@query("evl09_stop_predicates", "SELECT o_orderkey, o_totalprice > 450000 AND o_orderstatus = 'F' AS stop, o_totalprice < 20000 OR o_orderpriority = '1-URGENT' AS widen FROM orders")
def _(t):
    return t.orders.select("o_orderkey", ((F.col("o_totalprice") > 450000) & (F.col("o_orderstatus") == "F")).alias("stop"), ((F.col("o_totalprice") < 20000) | (F.col("o_orderpriority") == "1-URGENT")).alias("widen"))


@query("evl11_sigmoid", "SELECT o_orderkey, round(1 / (1 + exp(-(o_totalprice / 100000 - 2.5))), 6) AS p FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.round(1 / (1 + F.exp(-(F.col("o_totalprice") / 100000 - 2.5))), 6).alias("p"))


@query("evl12_errors_by_split", "WITH r AS (SELECT o_orderstatus, least(1.0, o_totalprice / 500000) - (o_orderpriority <= '3')::INT AS e FROM orders) SELECT o_orderstatus, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e * e), 6) AS brier FROM r GROUP BY 1")
def _(t):
    e = F.least(F.lit(1.0), F.col("o_totalprice") / 500000) - (F.col("o_orderpriority") <= "3").cast("int")
    return t.orders.groupBy("o_orderstatus").agg(F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(e * e), 6).alias("brier"))


@query("evl13_threshold_search", """
WITH g AS (SELECT i / 20.0 AS threshold FROM range(1, 20) r(i)), r AS (SELECT least(1.0, o_totalprice / 500000) AS p, o_orderpriority <= '3' AS y FROM orders),
s AS (SELECT threshold, avg(((p >= threshold) = y)::INT) AS acc FROM r, g GROUP BY threshold) SELECT o_t AS threshold, acc FROM (SELECT threshold::DOUBLE AS o_t, round(acc, 6) AS acc FROM s ORDER BY round(acc, 6) DESC, threshold LIMIT 1)""")
def _(t):
    return best_threshold(t.orders, F.least(F.lit(1.0), F.col("o_totalprice") / 500000), F.col("o_orderpriority") <= "3", 20)


@query("agg25_best_vs_baseline", """
WITH m AS (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS m, count(*) AS n, sum(o_totalprice) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY round(m, 6) DESC, o_orderpriority) AS r FROM m)
SELECT o_orderstatus, sum(n)::BIGINT AS n, round(sum(s) / sum(n), 6) AS mean, min(lo) AS least, max(hi) AS most, max(CASE WHEN r = 1 THEN o_orderpriority END) AS best, round(max(m) - max(CASE WHEN o_orderpriority = '5-LOW' THEN m END), 6) AS lead FROM b GROUP BY o_orderstatus""")
def _(t):
    return measures.versus_baseline(t.orders, "o_orderpriority", F.col("o_totalprice"), ["o_orderstatus"], F.col("o_orderpriority") == "5-LOW")


@query("agg26_ablation_by_split", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY ALL")
def _(t):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query("agg27_ablation_by_dimension", "SELECT dimension, level, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM (SELECT 'status' AS dimension, o_orderstatus AS level, o_totalprice FROM orders UNION ALL SELECT 'priority', o_orderpriority, o_totalprice FROM orders) GROUP BY ALL")
def _(t):
    d = t.orders.select("o_totalprice", F.explode(F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")).alias("dimension", "level"))
    return d.groupBy("dimension", "level").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("agg28_grid_summary", "SELECT l_linenumber, l_returnflag, round(avg(l_tax), 6) AS mean_tax, round(avg(l_discount) - 0.5 * stddev_pop(l_discount), 6) AS robust FROM lineitem GROUP BY ALL")
def _(t):
    return t.lineitem.groupBy("l_linenumber", "l_returnflag").agg(F.round(F.avg("l_tax"), 6).alias("mean_tax"), F.round(F.avg("l_discount") - 0.5 * F.stddev_pop("l_discount"), 6).alias("robust"))


@query("agg15_regressions", "WITH m AS (SELECT l_returnflag, avg(l_quantity) FILTER (WHERE l_linestatus = 'F') AS base, avg(l_quantity) FILTER (WHERE l_linestatus = 'O') AS now FROM lineitem GROUP BY 1) SELECT l_returnflag, round(now - base, 6) AS delta, coalesce(now - base < -0.05, FALSE) AS regressed FROM m")
def _(t):
    m = t.lineitem.groupBy("l_returnflag").agg(F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("base"), F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("now"))
    d = F.col("now") - F.col("base")
    return m.select("l_returnflag", F.round(d, 6).alias("delta"), F.coalesce(d < -0.05, F.lit(False)).alias("regressed"))


@query("agg19_weighted_means", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean, round(sqrt(greatest(0, sum(l_discount * l_discount * l_quantity) / sum(l_quantity) - (sum(l_discount * l_quantity) / sum(l_quantity)) ** 2)), 6) AS std, count(DISTINCT l_suppkey) AS support FROM lineitem GROUP BY 1")
def _(t):
    w = F.sum("l_quantity")
    m = F.sum(F.col("l_discount") * F.col("l_quantity")) / w
    v = F.sum(F.col("l_discount") * F.col("l_discount") * F.col("l_quantity")) / w - m * m
    return t.lineitem.groupBy("l_returnflag").agg(F.round(m, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), v)), 6).alias("std"), F.count_distinct("l_suppkey").alias("support"))


@query("agg20_candidate_groups", "WITH g AS (SELECT l_suppkey, l_returnflag, avg(l_discount) AS m, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_returnflag, round(m, 6) AS mean, round(n::DOUBLE / sum(n) OVER (PARTITION BY l_suppkey), 6) AS agreement FROM g")
def _(t):
    g = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_discount").alias("m"), F.count("*").alias("n"))
    return g.select("l_suppkey", "l_returnflag", F.round("m", 6).alias("mean"), F.round(F.col("n") / F.sum("n").over(Window.partitionBy("l_suppkey")), 6).alias("agreement"))


@query("agg18_failure_patterns", "SELECT l_returnflag, l_linenumber, round(avg(l_quantity), 6) AS weight, round(avg(l_discount) * 10, 6) AS confidence, round(avg(l_quantity) * avg(l_discount) * 10, 6) AS roi FROM lineitem GROUP BY ALL")
def _(t):
    q, d = F.avg("l_quantity"), F.avg("l_discount")
    return t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.round(q, 6).alias("weight"), F.round(d * 10, 6).alias("confidence"), F.round(q * d * 10, 6).alias("roi"))


@query("agg29_label_merge", "SELECT o_custkey, max(o_totalprice) AS best, arg_max(o_orderpriority, length(o_orderpriority) * 1000000000 - o_orderkey) AS longest, list_sort(list(DISTINCT o_orderstatus)) AS statuses FROM orders GROUP BY o_custkey")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"), F.max_by("o_orderpriority", F.char_length("o_orderpriority").cast("long") * 1000000000 - F.col("o_orderkey")).alias("longest"), F.array_sort(F.collect_set("o_orderstatus")).alias("statuses"))


@query("agg48_parent_classes", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS right_, count(*) FILTER (WHERE o_orderstatus <> 'F') AS wrong, bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus <> 'F') AS valid FROM orders GROUP BY o_custkey")
def _(t):
    f = F.col("o_orderstatus") == "F"
    return t.orders.groupBy("o_custkey").agg(F.count_if(f).alias("right_"), F.count_if(~f).alias("wrong"), (F.bool_or(f) & F.bool_or(~f)).alias("valid"))


@query("agg33_mode_summary", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS partial FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("partial"))


@query("agg35_mergeable_counter", "SELECT l_returnflag, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.sum("l_linenumber").alias("total"))


@query("jn04_parent_child", "WITH a AS (SELECT o_custkey, avg(o_totalprice) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, avg(o_totalprice) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT count(*) AS both_, count(*) FILTER (WHERE b < a) AS regressions, count(*) FILTER (WHERE b > a) AS improvements, round(avg(b - a), 4) AS delta FROM a JOIN b USING (o_custkey)")
def _(t):
    m = lambda s, c: t.orders.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.avg("o_totalprice").alias(c))
    j = m("F", "a").join(m("O", "b"), "o_custkey")
    return j.agg(F.count("*").alias("both_"), F.count_if(F.col("b") < F.col("a")).alias("regressions"), F.count_if(F.col("b") > F.col("a")).alias("improvements"), F.round(F.avg(F.col("b") - F.col("a")), 4).alias("delta"))


@query("jn01_left_join_defaults", "SELECT c.c_mktsegment, count(*) AS customers, count(*) FILTER (WHERE o.n IS NULL) AS abstained, coalesce(sum(o.n), 0)::BIGINT AS orders_ FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey GROUP BY 1")
def _(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.join(o, "c_custkey", "left").groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.count_if(F.col("n").isNull()).alias("abstained"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders_"))


@query("jn02_three_way_routing", "SELECT CASE WHEN o.o_orderkey IS NULL THEN 'orphan' WHEN p.p_partkey IS NULL THEN 'no_part' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'kept' END AS route, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem l LEFT JOIN orders o ON l_orderkey = o_orderkey LEFT JOIN part p ON l_partkey = p_partkey GROUP BY 1")
def _(t):
    j = t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag", "l_extendedprice").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("o")), "l_orderkey", "left").join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("p")), "l_partkey", "left")
    route = rows.error_code(("orphan", F.col("o").isNull()), ("no_part", F.col("p").isNull()), ("returned", F.col("l_returnflag") == "R"), ("kept", F.lit(True)))
    return j.groupBy(route.alias("route")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("jn03_inner_join_rates", "SELECT n_name, count(*) AS n, round(avg(s_acctbal), 4) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def _(t):
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 4).alias("balance"))


@query("jn23_grid", "SELECT a, b, c, sha256(a || '|' || b || '|' || c) AS id FROM (SELECT DISTINCT l_returnflag AS a FROM lineitem), (SELECT DISTINCT l_linestatus AS b FROM lineitem), (SELECT DISTINCT l_linenumber AS c FROM lineitem)")
def _(t):
    a, b, c = (t.lineitem.select(F.col(x).alias(y)).distinct() for x, y in (("l_returnflag", "a"), ("l_linestatus", "b"), ("l_linenumber", "c")))
    return a.crossJoin(b).crossJoin(c).select("a", "b", "c", F.sha2(F.concat_ws("|", "a", "b", F.col("c").cast("string")), 256).alias("id"))


@query("jn24_ablation_plan", "SELECT d.dim, d.level, b.p_type FROM (VALUES ('depth', '1'), ('depth', '2'), ('width', '4')) d(dim, level), (SELECT DISTINCT p_type FROM part) b UNION ALL SELECT 'base', '-', p_type FROM (SELECT DISTINCT p_type FROM part)")
def _(t):
    d = t.spark.createDataFrame([("depth", "1"), ("depth", "2"), ("width", "4")], "dim string, level string")
    b = t.part.select("p_type").distinct()
    return b.crossJoin(F.broadcast(d)).select("dim", "level", "p_type").unionByName(b.select(F.lit("base").alias("dim"), F.lit("-").alias("level"), "p_type"))


@query("jn25_split_conflicts", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'conflict' ELSE min(o_orderstatus) END AS split FROM orders GROUP BY o_custkey")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.when(F.count_distinct("o_orderstatus") > 1, "conflict").otherwise(F.min("o_orderstatus")).alias("split"))


@query("jn26_label_attach", "SELECT c_custkey, greatest(c_acctbal, coalesce(m, c_acctbal)) AS score, c_acctbal > 0 OR coalesce(m, 0) >= 250000 AS valid FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("m"))
    return t.customer.join(o, "c_custkey", "left").select("c_custkey", F.greatest("c_acctbal", F.coalesce("m", "c_acctbal")).alias("score"), ((F.col("c_acctbal") > 0) | (F.coalesce("m", F.lit(0)) >= 250000)).alias("valid"))


@query("man07_hash_audit", "WITH a AS (SELECT c_custkey AS k, md5(c_name) AS h FROM customer), b AS (SELECT s_suppkey AS k, md5(replace(s_name, 'Supplier', 'Customer')) AS h FROM supplier) SELECT CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS state, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1")
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("k"), F.md5("c_name").alias("h"))
    b = t.supplier.select(F.col("s_suppkey").alias("k"), F.md5(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("h2"), F.lit(1).alias("b"))
    j = a.withColumn("a", F.lit(1)).join(b, "k", "full")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("h") == F.col("h2"), "same").otherwise("changed")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("man02_stage_manifest", "SELECT o_orderstatus AS stage, count(*) AS row_count, count(*) FILTER (WHERE o_totalprice > 100000) AS accepted, count(*) FILTER (WHERE o_totalprice <= 100000) AS rejected, sum(('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 12))::BIGINT)::VARCHAR AS payload FROM orders GROUP BY 1")
def _(t):
    ok = F.col("o_totalprice") > 100000
    return t.orders.groupBy(F.col("o_orderstatus").alias("stage")).agg(F.count("*").alias("row_count"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), writers.head_sum(F.col("o_orderkey").cast("string")).alias("payload"))


@query("win07_cluster_ranking", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS place FROM lineitem")
def _(t):
    w = Window.partitionBy("l_orderkey").orderBy(*[F.desc(c) for c in ("l_extendedprice", "l_quantity", "l_discount", "l_linenumber", "l_partkey", "l_suppkey")])
    return t.lineitem.select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("place"))


@query("win10_merge_and_rank", "SELECT l_suppkey, l_returnflag, min(l_orderkey) AS first_order, count(*) AS votes, rank() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag) AS rank FROM lineitem GROUP BY l_suppkey, l_returnflag")
def _(t):
    g = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.min("l_orderkey").alias("first_order"), F.count("*").alias("votes"))
    return g.withColumn("rank", F.rank().over(Window.partitionBy("l_suppkey").orderBy(F.desc("votes"), "l_returnflag")).cast("long"))


@query("win11_candidate_rank", "SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size >= 10 DESC, p_size DESC) AS rank FROM part")
def _(t):
    return t.part.select("p_partkey", "p_brand", F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc(F.col("p_size") >= 10), F.desc("p_size"))).cast("long").alias("rank"))


@query("win12_cost_order", "SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_retailprice, p_brand, p_name, p_partkey) AS r FROM part) WHERE r = 1")
def _(t):
    cost = F.struct("p_size", "p_retailprice", "p_brand", "p_name", "p_partkey")
    return t.part.groupBy("p_type").agg(F.min_by("p_partkey", cost).alias("p_partkey"))


@query("top01_numeric_sort", "WITH i AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'x' || o_orderkey ELSE o_orderkey::VARCHAR END AS id FROM orders) SELECT id FROM i ORDER BY try_cast(id AS BIGINT) IS NULL, try_cast(id AS BIGINT), id LIMIT 50")
def _(t):
    i = t.orders.select(F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string")).alias("id"))
    n = F.expr("try_cast(id AS BIGINT)")
    return i.orderBy(n.isNull(), n, "id").limit(50)


@query("top01_numeric_positions", "WITH i AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'x' || o_orderkey ELSE o_orderkey::VARCHAR END AS id FROM orders) SELECT id, row_number() OVER (ORDER BY try_cast(id AS BIGINT) IS NULL, try_cast(id AS BIGINT), id) - 1 AS position FROM i")
def _(t):
    i = t.orders.select(F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string")).alias("id"))
    return positions_by(i, numeric_first(F.col("id")))


@query("top07_beam", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice, l_orderkey, l_partkey) AS r FROM lineitem) WHERE r <= 8")
def _(t):
    return rows.top_per_group(t.lineitem, ["l_linenumber"], ["l_extendedprice", "l_orderkey", "l_partkey"], 8).select("l_orderkey", "l_linenumber")


@query("top08_critique", "SELECT s_suppkey, s_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey DESC) AS r FROM supplier WHERE s_acctbal > 0) WHERE r <= 2")
def _(t):
    return rows.top_per_group(t.supplier.where("s_acctbal > 0"), ["s_nationkey"], [F.desc("s_acctbal"), F.desc("s_suppkey")], 2).select("s_suppkey", "s_nationkey")


@query("top09_frontier", "SELECT p_partkey, round(0.5 * p_size / 50 + 0.3 * (1 - p_retailprice / 2000) + 0.2 * (p_partkey % 10) / 10, 6) AS score FROM part ORDER BY score DESC, p_partkey LIMIT 25")
def _(t):
    score = 0.5 * F.col("p_size") / 50 + 0.3 * (1 - F.col("p_retailprice") / 2000) + 0.2 * (F.col("p_partkey") % 10) / 10
    return t.part.select("p_partkey", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(25)


@query("top10_tiered_head", "SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= CASE c_mktsegment WHEN 'BUILDING' THEN 16 WHEN 'MACHINERY' THEN 8 ELSE 4 END")
def _(t):
    return rows.capped(t.customer, "c_mktsegment", [F.desc("c_acctbal"), "c_custkey"], {"BUILDING": 16, "MACHINERY": 8}, 4).select("c_custkey", "c_mktsegment")


@query("mth01_safe_ratio", "SELECT l_suppkey, round(coalesce(sum(l_tax) / nullif(sum(CASE WHEN l_returnflag = 'Z' THEN 1.0 ELSE 0 END), 0), 0), 6)::DOUBLE AS safe, round(greatest(0.0, least(1.0, avg(l_discount) * 12)), 6)::DOUBLE AS clamped FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.round(num.ratio(F.sum("l_tax"), F.sum((F.col("l_returnflag") == "Z").cast("int"))), 6).alias("safe"), F.round(num.clamp(F.avg("l_discount") * 12), 6).alias("clamped"))


@query("mth02_softmax", "WITH m AS (SELECT p_type, p_brand, avg(p_size) AS x FROM part GROUP BY ALL), e AS (SELECT *, exp((x - max(x) OVER (PARTITION BY p_type)) / 2.0) AS e FROM m) SELECT p_type, p_brand, round(e / sum(e) OVER (PARTITION BY p_type), 6) AS p FROM e")
def _(t):
    m = t.part.groupBy("p_type", "p_brand").agg(F.avg("p_size").alias("x"))
    return m.select("p_type", "p_brand", F.round(num.softmax(F.col("x"), Window.partitionBy("p_type"), 2.0), 6).alias("p"))


@query("mth03_min_max", "SELECT s_suppkey, CASE WHEN max(s_acctbal) OVER w > min(s_acctbal) OVER w THEN round((s_acctbal - min(s_acctbal) OVER w) / (max(s_acctbal) OVER w - min(s_acctbal) OVER w), 6) ELSE 0 END AS x FROM supplier WINDOW w AS (PARTITION BY s_nationkey)")
def _(t):
    return t.supplier.select("s_suppkey", F.round(num.min_max(F.col("s_acctbal"), Window.partitionBy("s_nationkey")), 6).alias("x"))


@query("mth08_branch_score", "SELECT l_orderkey, l_linenumber, round(0.45 * l_discount * 10 + 0.25 * l_tax * 10 + 0.15 * l_quantity / 50 + 0.1 * (l_returnflag = 'R')::INT + 0.05 * (l_linestatus = 'O')::INT - CASE WHEN l_linenumber > 5 THEN 0.05 ELSE 0 END, 5)::DOUBLE AS score FROM lineitem")
def _(t):
    c = F.col
    s = 0.45 * c("l_discount") * 10 + 0.25 * c("l_tax") * 10 + 0.15 * c("l_quantity") / 50 + 0.1 * (c("l_returnflag") == "R").cast("int") + 0.05 * (c("l_linestatus") == "O").cast("int") - F.when(c("l_linenumber") > 5, 0.05).otherwise(0.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(s, 5).alias("score"))


@query("gte04_ladder", "SELECT l_returnflag, round(avg(l_discount) FILTER (WHERE l_linestatus = 'F'), 6) AS f, round(avg(l_discount) FILTER (WHERE l_linestatus = 'O'), 6) AS o, CASE WHEN avg(l_discount) FILTER (WHERE l_linestatus = 'O') IS NULL THEN 'incomplete' WHEN avg(l_discount) FILTER (WHERE l_linestatus = 'O') >= avg(l_discount) FILTER (WHERE l_linestatus = 'F') THEN 'advance' ELSE 'hold' END AS decision FROM lineitem GROUP BY 1")
def _(t):
    p = t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_discount"))
    d = F.when(F.col("O").isNull(), "incomplete").when(F.col("O") >= F.col("F"), "advance").otherwise("hold")
    return p.select("l_returnflag", F.round("F", 6).alias("f"), F.round("O", 6).alias("o"), d.alias("decision"))


@query("gte07_firewall", "WITH m AS (SELECT c_mktsegment, avg(c_acctbal) - 4500 AS d, count(*) AS n FROM customer GROUP BY 1) SELECT c_mktsegment, CASE WHEN abs(d) > 500 THEN 'reject' WHEN abs(d) > 100 OR n < 100 THEN 'investigate' ELSE 'allow' END AS policy FROM m")
def _(t):
    m = t.customer.groupBy("c_mktsegment").agg((F.avg("c_acctbal") - 4500).alias("d"), F.count("*").alias("n"))
    return m.select("c_mktsegment", F.when(F.abs("d") > 500, "reject").when((F.abs("d") > 100) | (F.col("n") < 100), "investigate").otherwise("allow").alias("policy"))


@query("gte10_final_candidate", "WITH m AS (SELECT p_brand, avg(p_size) AS s, avg(p_retailprice) AS r, count(*) AS n FROM part GROUP BY 1) SELECT coalesce((SELECT p_brand FROM m WHERE s > 25 AND n >= 10 ORDER BY round(s, 6) DESC, r, p_brand LIMIT 1), 'parent') AS chosen")
def _(t):
    m = t.part.groupBy("p_brand").agg(F.avg("p_size").alias("s"), F.avg("p_retailprice").alias("r"), F.count("*").alias("n"))
    best = F.min_by("p_brand", F.when((F.col("s") > 25) & (F.col("n") >= 10), F.struct((-F.round("s", 6)).alias("a"), "r", "p_brand")))
    return m.agg(F.coalesce(best, F.lit("parent")).alias("chosen"))


@query("gte12_mix_repair", "WITH n AS (SELECT c_mktsegment, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM customer GROUP BY 1) SELECT c_mktsegment, CASE WHEN share < 0.19 THEN 'add' WHEN share > 0.21 THEN 'trim' ELSE 'keep' END AS repair FROM n")
def _(t):
    s = F.col("share")
    return measures.shares(t.customer, "c_mktsegment").select("c_mktsegment", F.when(s < 0.19, "add").when(s > 0.21, "trim").otherwise("keep").alias("repair"))


@query("gte14_stack_gates", "WITH m AS (SELECT n_regionkey, avg((c_acctbal > 0)::INT) AS em, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT n_regionkey, round(em, 6) AS em, em >= 0.9 AS passed, n >= 16 AND em < 0.35 AS weak FROM m")
def _(t):
    m = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    g = m.groupBy("n_regionkey").agg(F.avg((F.col("c_acctbal") > 0).cast("int")).alias("em"), F.count("*").alias("n"))
    return g.select("n_regionkey", F.round("em", 6).alias("em"), (F.col("em") >= 0.9).alias("passed"), ((F.col("n") >= 16) & (F.col("em") < 0.35)).alias("weak"))


@query("map04_score_maps", "WITH n AS (SELECT o_custkey, o_orderstatus, greatest(0, sum(o_totalprice) - 200000) AS s FROM orders GROUP BY ALL) SELECT o_custkey, o_orderstatus, CASE WHEN sum(s) OVER (PARTITION BY o_custkey) > 0 THEN round(s / sum(s) OVER (PARTITION BY o_custkey), 6) END AS p FROM n")
def _(t):
    n = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.greatest(F.lit(0.0), F.sum("o_totalprice") - 200000).alias("s"))
    total = F.sum("s").over(Window.partitionBy("o_custkey"))
    return n.select("o_custkey", "o_orderstatus", F.when(total > 0, F.round(F.col("s") / total, 6)).alias("p"))


@query("map03_prior_blend", "WITH a AS (SELECT o_orderstatus AS k, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM orders GROUP BY 1), b AS (SELECT l_linestatus AS k, count(*)::DOUBLE / sum(count(*)) OVER () AS r FROM lineitem GROUP BY 1), j AS (SELECT coalesce(a.k, b.k) AS k, 0.7 * coalesce(p, 0) + 0.3 * coalesce(r, 0) AS x FROM a FULL JOIN b ON a.k = b.k) SELECT k, round(x / sum(x) OVER (), 6) AS x FROM j")
def _(t):
    part = lambda df, c, v: df.groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n")).select("k", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(v))
    j = part(t.orders, "o_orderstatus", "p").join(part(t.lineitem, "l_linestatus", "r"), "k", "full").fillna(0.0, ["p", "r"])
    x = 0.7 * F.col("p") + 0.3 * F.col("r")
    return j.select("k", F.round(x / F.sum(x).over(Window.partitionBy()), 6).alias("x"))
