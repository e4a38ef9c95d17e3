"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a shuffled order that is a pure function of
their ids. A document's virtual finish time is its source's words up to and
with it, divided by the source's target; a source whose target is above its
size queues its documents up to max_repeat times. All copies, ordered by finish
time, are truncated at the total budget.

No order is computed by one task: a source's running sum is the sum of the
shuffle-key buckets before plus a window inside the bucket, and the truncation
point is found by refining a histogram of finish times. The bucket count only
splits work; it does not change the result.

Defined cases: null text has size 0 and is never taken; a null source is a
source of its own, after all others; rows that share an id are ordered by
text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import WORD, cut, table

_BINS, _ENOUGH = 1024, 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(__src, __s) with __target: the total shared by weight, at most `most` times a source's size.

    Water filling in closed form: the capped sources are a prefix in the order
    of most * size / weight. One row a source.
    """
    in_order = W.orderBy(F.col("__src").asc_nulls_last())
    index = (F.row_number().over(in_order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), (index + 1).cast("int"))
    all_rows = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_ratio = W.orderBy((F.col("__s") / F.col("__w")).asc(), F.col("__src").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    capped = sizes.withColumn("__w", weight).withColumns({
        "__total": F.sum("__s").over(all_rows), "__wsum": F.sum("__w").over(all_rows),
        "__s_before": F.coalesce(F.sum("__s").over(by_ratio), F.lit(0)), "__w_before": F.coalesce(F.sum("__w").over(by_ratio), F.lit(0.0)),
    }).withColumn("__capped", (F.col("__total") - most * F.col("__s_before")) * F.col("__w") > most * F.col("__s") * (F.col("__wsum") - F.col("__w_before")))
    free = capped.withColumns({
        "__left": F.col("__total") - most * F.sum(F.when(F.col("__capped"), F.col("__s")).otherwise(0)).over(all_rows),
        "__w_free": F.sum(F.when(F.col("__capped"), 0.0).otherwise(F.col("__w"))).over(all_rows),
    })
    target = F.when(F.col("__capped"), (most * F.col("__s")).cast("double")).otherwise(F.col("__left") * F.col("__w") / F.col("__w_free"))
    return free.select("__src", "__s", target.alias("__target"), "__total")


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, seed: str = "mix") -> DataFrame:
    """df with size, source_size, target, copies (times taken) and taken (words)."""
    names = [f"__c{i}" for i in range(len(df.columns))]
    ids, text, src = (F.col(names[df.columns.index(c)]) for c in (id_col, text_col, source_col))
    base = df.toDF(*names).withColumns({
        "__id": ids, "__src": src, "__text": text,
        "__size": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"),
        "__key": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit("null"))).cast("binary")),
    })
    # Words and keys of all rows without their texts: small, read several times.
    slim = cut(base.select("__src", "__id", "__size", "__key", F.xxhash64("__text").alias("__th")))
    targets = cut(source_targets(slim.groupBy("__src").agg(F.sum("__size").alias("__s")), weights, max_repeat))
    largest = slim.groupBy("__src").count().agg(F.max("count")).head()[0] or 0
    digits = 2
    while largest / 16**digits > 100_000:
        digits += 1

    def timed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("__b", F.substring("__key", 1, digits))
        sums = slim.groupBy("__src", F.substring("__key", 1, digits).alias("__b")).agg(F.sum("__size").alias("__bs"))
        before = W.partitionBy("__src").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.withColumn("__before", F.coalesce(F.sum("__bs").over(before), F.lit(0))).drop("__bs")
        sums = sums.join(targets, sums["__src"].eqNullSafe(targets["__src"])).select(sums["__src"].alias("__src2"), F.col("__b").alias("__b2"), "__before", "__s", "__target", "__total")
        within = W.partitionBy("__src", "__b").orderBy("__key", "__id", "__th").rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumn("__in", F.sum("__size").over(within))
        rows = rows.join(sums, F.col("__src").eqNullSafe(F.col("__src2")) & (F.col("__b") == F.col("__b2")))
        return rows.withColumn("__cum", F.col("__in") + F.col("__before"))

    def finish(turn) -> F.Column:
        return ((turn * F.col("__s") + F.col("__cum")).cast("double")) / F.col("__target")

    total = (targets.agg(F.max("__total")).head() or [0])[0] or 0
    copies = cut(
        timed(slim).where("__size > 0 AND __target > 0")
        .select("__src", "__size", "__cum", "__s", "__target", F.explode(F.array(*[F.lit(i) for i in range(max_repeat)])).alias("__turn"))
        .select("__src", "__size", (F.col("__turn") * F.col("__s") + F.col("__cum")).alias("__at"), finish(F.col("__turn")).alias("__f"))
        .where(F.col("__f") < F.lit(float("inf")))
    )
    # The truncation point: all copies that finish before lo are in, the last bin is ordered exactly.
    lo, hi = 0.0, float((copies.agg(F.max("__f")).head() or [0])[0] or 0) * 1.001 + 1e-9
    taken, rows_left = 0, _ENOUGH + 1
    while rows_left > _ENOUGH and hi - lo > 1e-12:
        inside = copies.where((F.col("__f") > lo) & (F.col("__f") <= hi))
        width = (hi - lo) / _BINS
        binned = inside.groupBy(F.least(F.lit(_BINS - 1), F.floor((F.col("__f") - lo) / width)).alias("b")).agg(F.sum("__size").alias("s"), F.count("*").alias("n"))
        found = sorted((r["b"], r["s"], r["n"]) for r in binned.collect())  # at most _BINS rows
        for b, s, n in found:
            if taken + s > total:
                nlo, nhi = lo + b * width, lo + (b + 1) * width if b < _BINS - 1 else hi
                break
            taken += s
        else:
            lo = hi
            break
        # Bin edges are rounded: count again what lies at or below the new lower edge.
        lo2 = copies.where(F.col("__f") <= nlo).agg(F.sum("__size")).head()[0] or 0
        if lo2 > total:
            hi = nlo
            taken = copies.where(F.col("__f") <= lo).agg(F.sum("__size")).head()[0] or 0
            if nlo <= lo:
                break
            continue
        lo, hi, taken, rows_left = nlo, nhi, lo2, n
    edge = copies.where((F.col("__f") > lo) & (F.col("__f") <= hi + 1e-9))
    run = edge.withColumn("__run", F.sum("__size").over(W.orderBy("__f", F.col("__src").asc_nulls_last(), "__at").rowsBetween(W.unboundedPreceding, 0)))
    last = run.where(F.col("__run") <= total - taken).orderBy(F.desc("__run")).head()
    f_cut, src_cut, at_cut = (last["__f"], last["__src"], last["__at"]) if last else (lo, None, 2**62)

    def is_in(turn):
        f, at = finish(turn), turn * F.col("__s") + F.col("__cum")
        src_rank = F.col("__src").eqNullSafe(F.lit(src_cut)) & (at <= at_cut)
        before = F.lit(src_cut is None) & F.col("__src").isNotNull() if src_cut is None else F.coalesce(F.col("__src") < F.lit(src_cut), F.lit(False))
        return (F.col("__size") > 0) & (F.col("__target") > 0) & ((f < f_cut) | ((f == f_cut) & (src_rank | before)))

    full = timed(base.withColumn("__th", F.xxhash64("__text")))
    count = sum((F.coalesce(is_in(F.lit(i)), F.lit(False)).cast("int") for i in range(max_repeat)), F.lit(0))
    outputs = {"size": F.col("__size"), "source_size": F.col("__s"), "target": F.coalesce(F.col("__target"), F.lit(0.0)), "copies": count, "taken": (count * F.col("__size")).cast("long")}
    passed = [F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True) if c.lower() not in outputs]
    return full.select(*passed, *[v.alias(k) for k, v in outputs.items()])


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


MIX_CTE = r"""
sized AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS shuffle_key
  FROM {docs}),
sources AS (SELECT source, sum(size)::BIGINT AS s FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sources),
ranked AS (
  SELECT *, sum(s) OVER ()::BIGINT AS total, sum(w) OVER () AS wsum,
         coalesce(sum(s) OVER (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s_before,
         coalesce(sum(w) OVER (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS w_before
  FROM weighed),
capped AS (SELECT *, (total - 3 * s_before) * w > 3 * s * (wsum - w_before) AS is_capped FROM ranked),
targets AS (
  SELECT source, s, total, CASE WHEN is_capped THEN (3 * s)::DOUBLE
    ELSE (total - 3 * sum(CASE WHEN is_capped THEN s ELSE 0 END) OVER ())::DOUBLE * w / sum(CASE WHEN is_capped THEN 0.0::DOUBLE ELSE w END) OVER () END AS target
  FROM capped),
queued AS (
  SELECT d.*, t.s, t.total, t.target,
         sum(size) OVER (PARTITION BY d.source ORDER BY shuffle_key, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT doc_id, source, size, total, turn, turn * s + cum AS place, (turn * s + cum)::DOUBLE / target AS f
  FROM queued, (VALUES (0), (1), (2)) v(turn) WHERE size > 0 AND target > 0),
run AS (
  SELECT *, sum(size) OVER (ORDER BY f, source NULLS LAST, place ROWS UNBOUNDED PRECEDING) AS so_far FROM turns),
mixed AS (SELECT doc_id, source, count(*) AS copies FROM run WHERE so_far <= total GROUP BY doc_id, source)"""

OP9_SQL = f"""
WITH {MIX_CTE.format(docs="documents")}
SELECT q.doc_id, q.size, q.s AS source_size, coalesce(q.target, 0.0) AS target, coalesce(m.copies, 0) * q.size AS taken
FROM queued q LEFT JOIN mixed m ON q.doc_id IS NOT DISTINCT FROM m.doc_id AND q.source IS NOT DISTINCT FROM m.source
"""
