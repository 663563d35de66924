"""Connected components by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest node of its neighbourhood. In edges, v < u."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = cut(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
    return cut(edges.join(least, edges["v"] == least["x"]).select("u", F.col("m").alias("v")).distinct())


def _small(edges: DataFrame) -> DataFrame:
    """Links each smaller neighbour of a node, and the node, to the smallest of them."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m"))
    moved = edges.join(least, edges["u"] == least["x"]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return cut(moved.union(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge (u, v): root is the smallest node of its component. Loops and nulls are left out.

    The joins pair a frame with a written one, so that adaptive execution can split the rows of a hub. Each round at least
    halves what is not yet a star; a round that changes nothing ends the loop.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).toDF("u", "v", "ok").where("ok").select("u", "v").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
        now = _small(_large(now))
