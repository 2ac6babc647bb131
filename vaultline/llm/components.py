"""Connected components over an edge table, by alternating star steps.

Each round rewires edges towards the smallest neighbour ("large star" for
larger neighbours, "small star" for smaller ones) until every node points at
the smallest node of its component. Rounds grow with the logarithm of the
component size. The minimum per node is a partial aggregate, stored before a
hub's edges meet it in an equi-join: both sides then have an exchange, which
Spark can split, so no task holds all neighbours of a node. Every round is a
stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.col("v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest
    node reachable. Self-edges and repeats are ignored; nodes without an edge
    do not appear (callers treat them as their own root)."""
    e = scratch.save(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc0")
    state, k = _state(e), 0
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = scratch.save(low, f"cc{k}a")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"cc{k}l")
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"cc{k}b")
        small = (large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        new = scratch.save(small, f"cc{k + 1}")
        scratch.drop(f"cc{k}", f"cc{k}a", f"cc{k}l", f"cc{k}b")
        e, k, before = new, k + 1, state
        state = _state(e)
        if state == before:
            break
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
