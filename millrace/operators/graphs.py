"""Hierarchies as tables of (node, parent): paths, descendants, leaves.

Ancestors are found by joins that double their reach, so a depth of d takes
log2(d) rounds, each a join on unique nodes. Each round's table is written to
the shared folder, so no round computes the ones before it again; more rounds
than allowed are an error, never a part of the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.lineage import cut


def closure(links: DataFrame, most_rounds: int = 20) -> DataFrame:
    """(node, ancestor, distance) for all ancestors, nodes themselves at distance 0.

    Cycles end when a node would be met again at no new pair.
    """
    base = links.where("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    reach = cut(base)
    n = reach.count()
    for _ in range(most_rounds):
        up = reach.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("a2"), F.col("distance").alias("d2"))
        more = reach.join(up, "ancestor").select("node", F.col("a2").alias("ancestor"), (F.col("distance") + F.col("d2")).alias("distance"))
        reach = cut(reach.unionByName(more).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")))
        now = reach.count()
        if now == n:
            break
        n = now
    else:
        raise RuntimeError(f"closure did not settle in {most_rounds} rounds")
    own = links.select("node").unionByName(links.where("parent IS NOT NULL").select(F.col("parent").alias("node"))).distinct()
    return reach.unionByName(own.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))).groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))


def root_paths(reach: DataFrame) -> DataFrame:
    """(node, depth, path) with the path from the root to the node, joined by /."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("distance", "ancestor")), asc=False), lambda x: x["ancestor"])
    return reach.groupBy("node").agg(F.max("distance").alias("depth"), F.array_join(parts, "/").alias("path"))


def leaves(links: DataFrame) -> DataFrame:
    return links.select("node").distinct().join(links.select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct(), "node", "left_anti")


def resolve(aliases: DataFrame) -> DataFrame:
    """(alias, target): each alias's end, by pointer jumping; aliases that lead to a cycle stay where they are met.

    Each round doubles the steps made, so after as many rounds as the number of
    aliases has binary digits only those on a cycle still move.
    """
    at = cut(aliases.select("alias", "target"))
    for _ in range(max(1, at.count()).bit_length() + 1):
        nxt = at.select(F.col("alias").alias("target"), F.col("target").alias("t2"))
        moved = cut(at.join(nxt, "target", "left").select("alias", F.coalesce("t2", "target").alias("target"), F.col("t2").isNotNull().alias("moved")))
        at = moved.select("alias", "target")
        if moved.where("moved").isEmpty():
            break
    return at
