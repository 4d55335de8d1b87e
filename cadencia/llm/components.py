"""Connected components of a large graph by alternating star contractions, all in DataFrame operations.

Each round points every node's larger neighbours at the least node it knows (large star) and then its smaller
neighbours too (small star). Rounds go on until nothing changes; a graph of n nodes needs about log n of them. Every
round is written to the shared folder, so lineage stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadencia.llm import common


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def _contracted(edges: DataFrame, a: str, b: str) -> tuple[DataFrame, int]:
    """(u, v) of each node v other than its component's least node u, written to the shared folder; their number."""
    now = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") < F.col("v"))).distinct()
    now = common.materialize(now, "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter(F.col("y") > F.col("x")).join(least, "x").select(F.col("m").alias("u"), F.col("y").alias("v"))
        parent = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(parent, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("u").alias("v")), F.struct(F.col("m").alias("u"), F.col("v").alias("v")))).alias("e")).select("e.u", "e.v")
        after = common.materialize(small.filter(F.col("u") < F.col("v")).distinct(), "edges")
        common.drop_materialized(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now, mark[0]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every end of an edge other than its component's least node, that least node.

    Nulls and loops are no edges; repeated edges count once. Nodes that are missing from the result stand for themselves.
    """
    return _contracted(edges, a, b)[0].select(F.col("v").alias("id"), F.col("u").alias("component"))


def extended(known: DataFrame, links: DataFrame) -> DataFrame:
    """known (id, component) after links (a, b) between its nodes or new ones: what connected_components would make of all edges together.

    Only the least nodes of the components that links join go through the rounds; what links join nothing costs no round.
    """
    root = lambda c: known.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    ends = links.select("a", "b").join(root("a"), "a", "left").join(root("b"), "b", "left")
    now, n = _contracted(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "a", "b")
    if not n:
        common.drop_materialized(now)
        return known
    moved = known.join(now.select(F.col("v").alias("component"), F.col("u").alias("least")), "component", "left").select("id", F.coalesce("least", "component").alias("component"))
    out = common.materialize(moved.unionByName(now.select(F.col("v").alias("id"), F.col("u").alias("component"))), "components")
    common.drop_materialized(now)
    return out
