"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rareflow.llm.common import kept


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands the smallest node of its neighbourhood to its larger neighbours (large star), or to its
    smaller ones and itself (small star). Counts of a node's edges are only ever aggregated, never gathered."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b: long), ``component`` the smallest node reachable.

    Loops and repeated edges do no harm; an empty graph gives no rows. Each round is written to the shared
    folder, and the rounds end when one changes nothing.
    """
    edges = kept(edges.where("a <> b").select("a", "b").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        edges = kept(_star(_star(edges, large=True), large=False), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = tuple(state)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
