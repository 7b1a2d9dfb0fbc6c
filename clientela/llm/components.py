"""Connected components by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela.llm.shared import stored


def _hook(pairs: DataFrame, keep: str) -> DataFrame:
    """Every ``v`` of ``u`` for which ``keep`` holds moves to the least of ``u`` and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u").filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Edges may repeat, point either way, hold nulls (left out) and loops (a node of its own). A node
    with very many edges is reduced to its minimum before its rows meet; the join back is the
    adaptive skew join's. Every round is a table in the shared folder. An empty table gives none.
    """
    edges = edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL")
    state = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = state.filter("u <> v")
        both = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hook(both, "v > u").filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        state_next = stored(small.select("e.*").filter("u <> v").distinct())
        now = tuple(state_next.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before, state_previous = now, state_next
        state = state_previous
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = state_next.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    return nodes.join(links, "node", "left").select("node", F.coalesce("m", "node").alias("component"))
