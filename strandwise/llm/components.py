"""Connected components of a link table by alternating star contraction, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _join_least(rows: DataFrame, least: DataFrame, bound: int) -> DataFrame:
    """``rows`` (u, ...) with m of ``least`` (u, m, n), n the rows of u.

    Nodes with more than ``bound`` rows are few, as rows are bounded by the edges: they are broadcast, so a hub with a
    third of all edges is not one task.
    """
    hubs = F.broadcast(least.where(F.col("n") > bound).select("u", "m"))
    spread = rows.join(hubs, "u")
    rest = rows.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= bound).select("u", "m"), "u")
    return spread.unionByName(rest)


def _large_star(edges: DataFrame, bound: int) -> DataFrame:
    """Links each larger neighbour of a node with the least id among the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
    seen = _join_least(both.where("v > u"), least, bound)
    return seen.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, bound: int) -> DataFrame:
    """Edges run from the larger to the smaller id; links each smaller neighbour and the node to their least."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hung = _join_least(down, least, bound).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` that has a link to another; root is the least id it reaches.

    Self links and null ends are ignored; repeated links count once; no links give no rows.  Each round is written
    to the shared folder, and the loop ends when a round changes nothing, after O(log^2) rounds in theory and a
    handful in practice.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    # at most 8192 nodes of a round are above the bound
    bound = max(256, edges.count() >> 12)
    for _ in range(max_rounds):
        turned = materialize(_small_star(_large_star(edges, bound), bound), "edges")
        state = turned.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        discard(edges)
        edges = turned
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
