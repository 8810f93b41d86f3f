"""Connected components of an edge table by alternating star contraction; every round is cut with a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved


def _hook(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Each node's larger (else smaller) neighbours, and the node itself, are linked to the least of its neighbourhood."""
    if larger_only:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        # a > b throughout: the neighbours of a are all smaller
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) for every node of edges (a, b) but the least ones themselves."""
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    state = None
    for _ in range(rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = seen
        now = saved(_hook(_hook(now, True), False), "edges")
    raise RuntimeError(f"no fixed point in {rounds} rounds")
