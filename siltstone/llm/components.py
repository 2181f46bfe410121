"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.scratch import cut, drop


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.where("v > u").join(least, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the least of these; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(least, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(least.select("u", F.col("low").alias("v"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("cast(u as decimal(38,0))"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(node, component): the least node id that each node with an edge can reach.

    Edges are undirected pairs of integers; loops and rows with a null end are ignored, repeated edges count once.
    Each round is written to the shared checkpoint folder, so the plan stays short and lost executors cost one
    round; the table of the round before is deleted then. Rounds grow with the logarithm of the longest path. Only counts reach the driver. A table without
    edges gives an empty result. Raises if the edges still change after ``rounds`` rounds.
    """
    now = cut(edges.where(f"`{a}` <> `{b}`").select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct())
    before = _fingerprint(now)
    for _ in range(rounds):
        if not before[0]:
            break
        last, now = now, cut(_small_star(_large_star(now)), "star")
        drop(last)
        after = _fingerprint(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    centres = now.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct()
    out = cut(stars.unionByName(centres).select(F.col("u").alias("node"), "component"), "components")
    drop(now)
    return out
