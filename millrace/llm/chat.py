r"""Chat formatting: reply trees, their best root-to-leaf path, one string each.

Paths are found by self-joins on ancestor tables that double their reach each
round (1, 2, 4, ... replies), so a tree of depth d takes log2(d) rounds and no
join has a key with more than one row on its ancestor side. A branch's score
is the sum of its nodes' scores; the best branch of each tree is formatted, or
every branch if asked for. All of it is DataFrame operations.

Format: <s>, then for each turn <|turn|> role LF text <|end|>, then </s>.
Control strings inside texts are escaped by their first character, so that a
reader finds only the format's own: backslash is written \b, the < of a
control string \l, its [ is \s, and LF inside a role \n. unescape() undoes it.

Defined cases: null text and null role are empty; rows of one tree with the
same turn follow each other by role, then text; repeated rows are separate
turns; a null tree id is a tree of its own (not that of the name "null");
other columns are not carried, whatever their names; very long texts are one
turn each; branches that tie go to the smaller leaf id; nodes whose parent is missing
are roots; nodes on a cycle have no root and are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import cut, table

TURN, END, BOS, EOS = "<|turn|>", "<|end|>", "<s>", "</s>"
#: Control strings that texts may hold (ours and those of common chat formats).
_CONTROL_L = r"<(?=\|[A-Za-z_]+\|>|/?s>|</?SYS>>)"
_CONTROL_S = r"\[(?=/?INST\])"


def escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\b"))
    return F.regexp_replace(F.regexp_replace(c, _CONTROL_L, "\\\\l"), _CONTROL_S, "\\\\s")


def unescape(c: Column) -> Column:
    for code, char in (("\\l", "<"), ("\\s", "["), ("\\n", "\n"), ("\\b", "\\")):
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def reply_chain(df: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns as a reply tree: each row answers the row before it."""
    rows = df.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    spot = F.row_number().over(W.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    rows = rows.withColumn("spot", spot)
    name = lambda spot: F.concat_ws("/", F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("null")), spot.cast("string"))
    return rows.select("tree", name(F.col("spot")).alias("node"), F.when(F.col("spot") > 1, name(F.col("spot") - 1)).alias("parent"), "role", "text", F.char_length(F.coalesce("text", F.lit(""))).cast("double").alias("score"))


def best_paths(nodes: DataFrame, all_branches: bool = False) -> DataFrame:
    """(branch, node, depth, branch_score) of the best branch of each tree, or of all.

    nodes: tree, node (unique), parent, score. Ties of score go to the smaller leaf id.
    """
    nodes = nodes.select("tree", "node", "parent", "score")
    present = nodes.select(F.col("node").alias("p"))
    links = cut(nodes.join(present, nodes["parent"] == present["p"], "left").select("tree", "node", F.col("p").alias("parent"), "score"))
    # Rounds: anc is the 2^k-th ancestor; dist and sum count the nodes and scores from node up to, without, anc.
    # Nodes that have reached their root leave the rounds.
    state = links.select("node", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("dist"), F.col("score").alias("sum"))
    # As long as there is a node to come, one of those at depth 2^k to 2^(k+1) leaves; if none does, only cycles are left.
    steps, before = [], -1
    while (n := (going := state.where("anc IS NOT NULL")).count()) and n != before:
        before = n
        steps.append(going.select("node", "anc"))
        up = state.select(F.col("node").alias("n2"), F.col("anc").alias("a2"), F.col("dist").alias("d2"), F.col("sum").alias("s2"))
        moved = going.join(up, going["anc"] == up["n2"]).select("node", F.col("a2").alias("anc"), (F.col("dist") + F.col("d2")).alias("dist"), (F.col("sum") + F.col("s2")).alias("sum"))
        state = cut(moved.unionByName(state.where("anc IS NULL")))
    rooted = state.where("anc IS NULL").select(F.col("node").alias("leaf"), "dist", F.col("sum").alias("branch_score"))
    parents = links.where("parent IS NOT NULL").select(F.col("parent").alias("leaf")).distinct()
    leaves = rooted.join(parents, "leaf", "left_anti").join(links.select(F.col("node").alias("leaf"), "tree"), "leaf")
    if not all_branches:
        rank = F.struct((-F.col("branch_score")).alias("lower"), "leaf", "dist", "branch_score")
        leaves = leaves.groupBy("tree").agg(F.min(rank).alias("best")).select("tree", "best.leaf", "best.dist", "best.branch_score")
    path = leaves.select("tree", F.col("leaf").alias("branch"), F.col("leaf").alias("at"), F.col("dist").alias("depth"), "branch_score")
    for k, step in enumerate(steps):
        up = step.select(F.col("node").alias("at"), "anc")
        path = path.unionByName(path.join(up, "at").select("tree", "branch", F.col("anc").alias("at"), (F.col("depth") - 2**k).alias("depth"), "branch_score"))
        path = cut(path) if k % 2 else path
    return path.select("tree", "branch", F.col("at").alias("node"), "depth", "branch_score")


def format_paths(path: DataFrame, nodes: DataFrame, masked_role: str = "assistant") -> DataFrame:
    """(tree, branch, formatted, spans): spans are the offset and length, in code points, of the text under the loss mask."""
    turns = path.select("branch", "node", "depth").join(nodes.select("node", "tree", "role", "text"), "node")
    turns = turns.select("tree", "branch", "depth", F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")).alias("r"), escape(F.col("text")).alias("t"), F.coalesce(F.col("role") == masked_role, F.lit(False)).alias("m"))
    runs = turns.withColumn("head", F.concat(F.lit(TURN), F.col("r"), F.lit("\n")))
    by = W.partitionBy("branch").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    start = F.lit(len(BOS)) + F.coalesce(F.sum(F.char_length("head") + F.char_length("t") + len(END)).over(by), F.lit(0)) + F.char_length("head")
    runs = runs.withColumn("start", start)
    one = runs.groupBy("branch").agg(F.first("tree").alias("tree"), F.array_sort(F.collect_list(F.struct("depth", "head", "t", "m", "start"))).alias("turns"))
    body = F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["t"], F.lit(END))), "")
    spans = F.transform(F.filter("turns", lambda x: x["m"]), lambda x: F.struct(x["start"].cast("int").alias("start"), F.char_length(x["t"]).alias("length")))
    return one.select("tree", "branch", F.concat(F.lit(BOS), body, F.lit(EOS)).alias("formatted"), spans.alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """format_paths' rows with turns (array of role, text) and loss (text under the mask), from the string alone."""
    inner = F.expr(f"substring(formatted, {len(BOS) + 1}, char_length(formatted) - {len(BOS) + len(EOS)})")
    pieces = F.split(inner, TURN.replace("|", "\\|"), -1)
    marked = F.slice(pieces, F.lit(2), F.size(pieces))
    ended = F.transform(marked, lambda x: x.substr(F.lit(1), F.char_length(x) - len(END)))
    turns = F.transform(ended, lambda x: F.struct(unescape(F.substring_index(x, "\n", 1)).alias("role"), unescape(x.substr(F.locate("\n", x) + 1, F.char_length(x))).alias("text")))
    loss = F.array_join(F.transform("spans", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["length"]))), "")
    return formatted.withColumns({"turns": turns, "loss": loss})


def chat_format(nodes: DataFrame, all_branches: bool = False, masked_role: str = "assistant") -> DataFrame:
    """One formatted conversation for each chosen branch of the reply trees in nodes."""
    nodes = cut(nodes)
    return format_paths(best_paths(nodes, all_branches), nodes, masked_role)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    done = read_back(chat_format(reply_chain(rows.unionByName(extra))))
    digest = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return done.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
written AS (
  SELECT *, length(replace(role, '\', '\b'))
            + length(replace(text, '\', '\b')) + len(regexp_extract_all(text, '<\|[A-Za-z_]+\|>|</?s>|<<SYS>>|<</SYS>>|\[/?INST\]'))
            + 16 AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (sum(chars) + 7)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""
