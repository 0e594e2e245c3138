"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, staged


def _lowest(edges: DataFrame) -> DataFrame:
    """The least neighbour of each ``u``. It is staged so that a join against a hot ``u`` can be split."""
    return staged(edges.groupBy("u").agg(F.min("v").alias("m")), "star-min")


def _next(edges: DataFrame, least: DataFrame, made: DataFrame, name: str) -> DataFrame:
    out = staged(made.distinct(), name)
    drop(edges, least)
    return out


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _lowest(both)
    made = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return _next(edges, least, made.where(F.col("u") != F.col("v")), "large-star")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
    least = _lowest(down)
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _next(edges, least, moved.unionByName(least.select("u", F.col("m").alias("v"))), "small-star")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root``: the least node of its component, for each node but the roots themselves.

    ``edges`` has two integer columns ``u`` and ``v``. Each round is written to the shared folder.
    """
    edges = staged(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        edges = _small_star(_large_star(edges))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
