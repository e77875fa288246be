"""Connected components of a link table by alternating large-star and small-star steps, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _neighbours_with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each link with the least of u and its neighbours. The least is aggregated before it is joined, so a hot node is one row."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return edges.join(least, "u")


def _stars(edges: DataFrame) -> bool:
    """True if every u has one v and no v is a u: each component is a star around its smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).union(edges.select("v", F.lit(None).cast("long")))
    seen = ends.groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.bool_or(F.col("to").isNull()).alias("centre"))
    return seen.where("low <> high or (centre and low is not null)").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 50) -> DataFrame:
    """(node, component) of every node in a link; component is the smallest node reachable. Nodes are long.

    Rounds grow with the logarithm of the longest chain; an error says so if most_rounds of them did not do.
    """
    links = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    rounds = 0
    while not _stars(edges):
        rounds += 1
        if rounds > most_rounds:
            raise RuntimeError(f"components are not found after {most_rounds} rounds")
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _neighbours_with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        near = _neighbours_with_least(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, edges = edges, materialise(small, "links")
        discard(before)
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
