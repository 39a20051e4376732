"""Connected components of a link table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _flat(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then all edges lead to roots."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("root")).unionAll(edges.select(F.col("v"), F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("root").alias("root")).where("out > 1 OR out = 1 AND root = 1").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): every node of edges (u, v), with the smallest node that it reaches.

    Either star points the neighbours of a node at the smallest node near it, so trees flatten in a number of rounds
    that grows with the logarithm of the graph. Minima combine before the shuffle, and are written before they are
    joined back, so that AQE can split the join at a node with very many links. Null ends and loops don't count; no
    edges: no rows."""
    now = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _flat(now):
        for star in (_large_star, _small_star):
            lows, rows = star(now)
            lows = scratch.write(lows, "lows")
            then = scratch.write(rows(lows).where("u <> v").distinct(), "edges")
            scratch.drop(now)
            scratch.drop(lows)
            now = then
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _large_star(edges: DataFrame):
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lows = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return lows, lambda lows: both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame):
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lows = down.groupBy("u").agg(F.min("v").alias("low"))
    return lows, lambda lows: down.join(lows, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).union(lows.select("u", F.col("low").alias("v")))
