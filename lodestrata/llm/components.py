"""Connected components of links between numbers, by alternating large-star and small-star rounds.

Every round is two aggregations with map-side minima and two joins; no node's links meet in one place, so hubs
need no care beyond what adaptive execution does for skewed joins. Each round's links are stored, and rounds end
when the links no longer change: each node is then linked to the smallest of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.storage import materialise


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    met = both.join(least, F.col("u") == F.col("w"))
    return met.where("v > u").select(F.col("v").alias("u"), F.least("m", "w").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node's smaller neighbours and itself to the smallest of them. Links run from larger to smaller."""
    least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    met = edges.join(least, F.col("u") == F.col("w"))
    return met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def smallest_reachable(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v): for each node u of ``links`` (columns u, v) that can reach a smaller one, the smallest v it can reach."""
    edges = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    was = _signature(edges)
    for _ in range(rounds):
        if not was[0]:
            return edges
        edges = materialise(_small_star(_large_star(edges)), "links")
        now = _signature(edges)
        if now == was:
            return edges
        was = now
    raise RuntimeError("components have not settled")
