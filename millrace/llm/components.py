"""Connected components of a table of links: in one task if they are few, else by distributed rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut

#: Links that one task joins (some 100 MB there); beyond it the rounds are distributed.
ONE_TASK = 200_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """components() of at most ONE_TASK distinct links u, v, by union-find on an executor."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}
        schema = None

        def find(x):
            top = x
            while root[top] != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for batch in batches:
            schema = batch.schema
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root.setdefault(u, u)
                root.setdefault(v, v)
                a, b = find(u), find(v)
                if a != b:
                    root[max(a, b)] = min(a, b)
        if schema is not None:
            nodes = list(root)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, schema.field(0).type), pa.array([find(x) for x in nodes], schema.field(0).type)], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component): the least node reachable by links, itself included, for each node of a, b (of one type).

    Alternates two star steps (Kiveris et al. 2014) until nothing changes: each
    node's larger neighbours are linked to its least one, then its smaller ones.
    Every round is a fixed number of group-bys and joins on nodes. A hub's
    neighbours meet its least one by a join, not in a list; the least ones are
    written first, so that both sides of the join are read from exchanges of
    their own and adaptive execution splits a hub's.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.count() <= ONE_TASK:
        return _in_one_task(edges)
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = cut(small.where("u <> v").distinct())
        # A fixed point is a set of stars: as many edges, with the same digest, as the round before.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
