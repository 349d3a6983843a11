"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star step on (u, v) with u > v; the least neighbour takes over. Linear in the edges, skewed nodes spill."""
    if both_ways:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
        out = around.select("u", "v", low.alias("m")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = F.min("v").over(Window.partitionBy("u"))
        found = edges.select("u", "v", low.alias("m"))
        out = found.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(found.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, root) for every node of (u, v) that isn't the least of its component, root being that least one.

    Null ends, loops and repeated edges don't matter; no edges give no rows. Each round is written to the shared
    checkpoint folder. Rounds grow with the logarithm of the longest path; ValueError after most_rounds.
    """
    a, b = F.col("u"), F.col("v")
    edges = checkpoint(edges.dropna().filter("u <> v").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    stamp = None
    for _ in range(most_rounds):
        edges = checkpoint(_star(_star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == stamp or now[0] == 0:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        stamp = tuple(now)
    raise ValueError(f"components: not done after {most_rounds} rounds")
