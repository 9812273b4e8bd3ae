"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import cut, drop


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every greater neighbour of u is linked to the least of u and its neighbours. Small star: every lesser one, and u."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = both.join(low, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, component: the least node of its component, for every node of an edge table (a, b). The result is a table of its own, for drop()."""
    edges = cut(edges.select("a", "b").where("a <> b"))
    seen = None
    while True:
        after = cut(_star(_star(edges, True), False))
        drop(edges)
        edges = after
        r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 31) - 1))).alias("s")).first()
        now = (r["n"], r["x"], r["s"])
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = cut(stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
    drop(edges)
    return out
