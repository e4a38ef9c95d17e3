"""Line dedup: explode normalised lines, hash, count the distinct documents
of each hash, drop lines over the threshold, reassemble by position.

Lines are split and hashed once; only their hashes and positions, of lines long
enough to be dropped, are written and shuffled for the counts. The text itself
is shuffled once, to meet the positions that its document loses. A line that a
third of all documents hold is counted by partial sums. The common lines are
broadcast if they were counted to be few, else joined from a table of their
own, so that adaptive execution can split a line's rows.

Defined cases: null or empty text is one empty line; a null id is no document
for the counts and never keeps a line that others lose; rows that share an id
count as one document, each row keeps its own text, and repeated rows lose the
same lines; of documents that tie for a line the largest id keeps it, at every
place it has there; a very long text is one row throughout, its lines are rows
of hashes; an empty table gives an empty result; columns of the input pass
through unless an output (the text, n_lines, n_dropped) has their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import SPACE, cut, hash128, lower_ascii, table

#: Common lines (of 24 bytes each) that are broadcast; beyond it they are joined by their hashes.
FEW = 200_000


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """df with its text deduplicated, n_lines (before) and n_dropped."""
    names = [f"__c{i}" for i in range(len(df.columns))]
    base = df.toDF(*names)
    ids, text = F.col(names[df.columns.index(id_col)]), F.coalesce(F.col(names[df.columns.index(text_col)]), F.lit(""))
    rows = base.select(ids.alias("__id"), text.alias("__text"), F.xxhash64(text).alias("__row"))
    lines = rows.select("__id", "__row", F.posexplode(F.split("__text", "\n", -1)).alias("__pos", "__line"))
    keyed = lines.select("__id", "__row", "__pos", line_key(F.col("__line")).alias("__key")).where(F.char_length("__key") >= min_chars)
    h1, h2 = hash128(F.col("__key"))
    seen = cut(keyed.select("__id", "__row", "__pos", h1.alias("__h1"), h2.alias("__h2")))
    common = cut(
        seen.where(F.col("__id").isNotNull()).select("__h1", "__h2", "__id").distinct()
        .groupBy("__h1", "__h2").agg(F.count("*").alias("__n"), F.max("__id").alias("__keeper"))
        .where(F.col("__n") >= min_docs).drop("__n")
    )
    if common.count() <= FEW:
        common = F.broadcast(common)
    lost = (
        seen.join(common, ["__h1", "__h2"]).where(~F.col("__id").eqNullSafe(F.col("__keeper")))
        .groupBy("__id", "__row").agg(F.collect_set("__pos").alias("__lost"))
        .select(F.col("__id").alias("__lost_id"), F.col("__row").alias("__lost_row"), "__lost")
    )
    whole = base.withColumns({"__id": ids, "__text": text, "__row": F.xxhash64(text)})
    whole = whole.join(lost, F.col("__id").eqNullSafe(F.col("__lost_id")) & (F.col("__row") == F.col("__lost_row")), "left")
    whole = whole.withColumn("__lines", F.when(F.col("__lost").isNotNull(), F.split("__text", "\n", -1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__lost"))
    picked = F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    outputs = {
        text_col: F.when(F.col("__lost").isNull(), F.col("__text")).otherwise(picked),
        "n_lines": (F.char_length("__text") - F.char_length(F.translate("__text", "\n", "")) + 1).cast("long"),
        "n_dropped": F.when(F.col("__lost").isNull(), F.lit(0)).otherwise(F.size("__lost")).cast("long"),
    }
    passed = [F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True) if c.lower() not in {k.lower() for k in outputs}]
    return whole.select(*passed, *[v.alias(k) for k, v in outputs.items()])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
DEDUP_CTE = f"""
lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM {{docs}}),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, {_SPACE_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM lines),
common AS (
  SELECT line_key, max(doc_id) AS keeper FROM keyed WHERE length(line_key) >= 40
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, (c.line_key IS NOT NULL AND k.doc_id <> c.keeper) AS gone
  FROM keyed k LEFT JOIN common c ON k.line_key = c.line_key)"""

OP2_SQL = f"""
WITH {DEDUP_CTE.format(docs="documents")}
SELECT doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
