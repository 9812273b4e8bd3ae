"""Closures over edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.sources.scratch import cut


def closure(roots: DataFrame, edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(root, node, hops): nodes reached from roots (root, node) along edges (src, dst), with the least hops; roots are at 0. Cycles end it."""
    edges = cut(edges.select("src", "dst").distinct())
    frontier = cut(roots.select("root", "node").distinct().withColumn("hops", F.lit(0)))
    seen, hops = frontier, 0
    while max_hops is None or hops < max_hops:
        hops += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("hops", F.lit(hops)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


#: Targets of a node that travel together.
PIECE = 1024
#: Rounds in which circles are looked for, at most; pairs of nodes that are broadcast, at most; edges to a task that makes lists of them.
CIRCLES, HELD, EDGES = 8, 1 << 22, 200_000


def two_hops(edges: DataFrame) -> DataFrame:
    """(root, node, hops): what every source of edges (src, dst) reaches in two hops at most, with the least hops; roots are at 0. Lists of targets are dealt by root once, and rows are made and counted where they lie."""
    edges = cut(edges.select("src", "dst").distinct())
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    lists = edges.withColumn("piece", F.floor((place - 1) / PIECE)).groupBy("src", "piece").agg(F.collect_list("dst").alias("further")).select(F.col("src").alias("dst"), "further")
    ways = edges.join(lists, "dst", "left").repartition("src")
    at = lambda node, hops: F.struct(node.alias("node"), F.lit(hops).alias("hops"))
    met = F.concat(F.array(at(F.col("src"), 0), at(F.col("dst"), 1)), F.coalesce(F.transform("further", lambda n: at(n, 2)), F.array()))
    return ways.select(F.col("src").alias("root"), F.inline(met)).groupBy("root", "node").agg(F.min("hops").alias("hops"))


def circles(edges: DataFrame, most: int = CIRCLES) -> DataFrame | None:
    """(node, rep): nodes that reach each other along edges (src, dst), by the least of them. A round colours every node by the least one that leads to it and takes the circle of each colour's own node, so circles apart are found in one; after `most` rounds others may be left out. None if there are no circles."""
    found: list[DataFrame] = []
    back = lambda e: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    left, n = cut(edges.select("src", "dst").where("src <> dst").distinct()), -1
    for _ in range(most):
        # what nothing leads to, or what leads nowhere, is in no circle
        while n != (n := left.count()) and n:
            inner = left.select(F.col("src").alias("node")).intersect(left.select(F.col("dst").alias("node")))
            inner = cut(inner)
            left = cut(left.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
        if not n:
            break
        n = -1
        colour = cut(left.select(F.col("src").alias("node"), F.col("src").alias("colour")).distinct())
        while True:
            met = left.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("met"))
            after = cut(colour.join(met, "node", "left").select("node", F.least("colour", "met").alias("colour"), F.coalesce(F.col("met") < F.col("colour"), F.lit(False)).alias("turned")))
            colour, turned = after.select("node", "colour"), not after.where("turned").isEmpty()
            if not turned:
                break
        of = lambda c: colour.select(F.col("node").alias(c), F.col("colour").alias(f"_{c}"))  # noqa: E731, B023
        alike = cut(left.join(of("src"), "src").join(of("dst"), "dst").where("_src = _dst").select("src", "dst"))
        circle = cut(closure(colour.where("node = colour").select(F.col("colour").alias("root"), "node"), back(alike)).select("node", F.col("root").alias("rep")))
        found.append(circle.join(circle.where("node <> rep").select("rep").distinct(), "rep", "left_semi").select("node", "rep"))
        gone = circle.select("node")
        left = cut(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    members = cut(reduce(DataFrame.unionByName, found)) if found else None
    return members if members is not None and not members.isEmpty() else None


def reached(edges: DataFrame) -> DataFrame:
    """(root, node): what every source of edges (src, dst) reaches, itself included. Nodes of a circle reach the same, so one stands for all.

    Edges are followed from nodes alone that others lead to; every other root puts together what its own targets reach where its edges lie, so the rows of the result are never dealt.
    """
    edges = cut(edges.select("src", "dst").distinct())
    members = circles(edges)
    if members is None:
        joined = edges.withColumn("is_rep", F.lit(False))
    else:
        standing = lambda d, c: d.join(members.select(F.col("node").alias(c), F.col("rep").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c))
        joined = cut(standing(standing(edges, "src"), "dst").where("src <> dst or _src is null").select("src", "dst", F.col("_src").isNotNull().alias("is_rep")).distinct())
    between = joined.select(F.col("src").alias("node")).intersect(joined.select(F.col("dst").alias("node")))
    below = cut(closure(between.select(F.col("node").alias("root"), "node"), joined).select("root", "node"))
    few = below.count() <= HELD
    sets = below.groupBy(F.col("root").alias("dst")).agg(F.collect_list("node").alias("further"))
    n = max(-(-joined.count() // EDGES), edges.sparkSession.sparkContext.defaultParallelism)

    def lists(of: DataFrame) -> DataFrame:
        """root, nodes: what the sources of these edges reach, circles by their one; not themselves."""
        ways = of.repartition(n, "src").join(F.broadcast(sets), "dst", "left") if few else of.join(sets, "dst", "left").repartition(n, "src")
        return ways.groupBy(F.col("src").alias("root")).agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("further", F.array("dst"))))).alias("nodes"))

    itself = lambda c: F.coalesce(F.array_union(F.array(c), "nodes"), F.array(c))
    rows = lists(joined.where("not is_rep")).select("root", F.explode(itself("root")).alias("rep"))
    if members is None:
        return rows.select("root", F.col("rep").alias("node"))
    fit = F.broadcast if members.count() <= HELD else (lambda d: d)
    of_reps = lists(joined.where("is_rep")).withColumnRenamed("root", "rep")
    # every node of a circle is a source
    inside = members.select(F.col("node").alias("root"), "rep").repartition(n, "root").join(F.broadcast(of_reps) if few else of_reps, "rep", "left").select("root", F.explode(itself("rep")).alias("rep"))
    held = members.groupBy("rep").agg(F.collect_list("node").alias("held"))
    return rows.unionByName(inside).join(fit(held), "rep", "left").select("root", F.explode(F.coalesce("held", F.array("rep"))).alias("node"))


def incoming(edges: DataFrame) -> DataFrame:
    """(dst, n_src, first_src): distinct sources of each target."""
    return edges.select("src", "dst").distinct().groupBy("dst").agg(F.count(F.lit(1)).alias("n_src"), F.min("src").alias("first_src"))
