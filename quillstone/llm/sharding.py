"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards; each leaf has a weight, each inner node the sum of its
leaves. A key descends level by level. At a node it draws for every child
``-ln(u(key, child)) / weight(child)`` and takes the least draw, so a child is taken in proportion
to its weight. A child's draw depends on that child alone: when weights change, only keys whose
winner changed move, and only into subtrees that gained or out of subtrees that lost.

Edge cases: a null key is hashed as the word "null" and so has one shard; a null text has size 1
and the checksum of the empty text; repeated rows each get a slot of their own; an empty table
gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import partitions, range_bounds, range_bucket

UNITS = 2.0**52


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def uniform_tree(shards: int, racks_of: int = 2, regions_of: int = 2) -> list[Leaf]:
    """Equal leaves: racks_of shards in a rack, regions_of racks in a region."""
    return [Leaf(f"g{s // (racks_of * regions_of)}", f"g{s // (racks_of * regions_of)}k{s // racks_of % regions_of}", s) for s in range(shards)]


def grow(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard as a region of its own: no other node's weight changes, so keys move only into it."""
    shard = max((x.shard for x in tree), default=-1) + 1
    return [*tree, Leaf(f"new{shard}", f"new{shard}k0", shard, weight)]


def levels(tree: list[Leaf]) -> tuple[dict[str, float], dict[str, dict[str, float]], dict[str, dict[int, float]]]:
    """Weights of regions, of racks by region and of shards by rack; nodes without weight take no keys."""
    regions: dict[str, float] = {}
    racks: dict[str, dict[str, float]] = {}
    shards: dict[str, dict[int, float]] = {}
    for x in tree:
        if x.weight > 0:
            regions[x.region] = regions.get(x.region, 0) + x.weight
            inside = racks.setdefault(x.region, {})
            inside[x.rack] = inside.get(x.rack, 0) + x.weight
            shards.setdefault(x.rack, {})[x.shard] = x.weight
    return regions, racks, shards


def _least(key: Column, children: dict, kind: str) -> Column:
    """The child with the least draw; the name decides ties."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = []
    for name, weight in sorted(children.items()):
        u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{kind}/{name}"))), 1, 13), 16, 10).cast("double") + 1) / UNITS
        draws.append(F.struct((-F.ln(u) / F.lit(float(weight))).alias("draw"), F.lit(name).alias("name")))
    return F.least(*draws)["name"]


def place(df: DataFrame, key: Column, tree: list[Leaf], prefix: str) -> DataFrame:
    """Adds {prefix}region, {prefix}rack and {prefix}shard."""
    regions, racks, shards = levels(tree)

    def under(parent: Column, children: dict[str, dict], kind: str) -> Column:
        out = None
        for name, inside in sorted(children.items()):
            found = _least(key, inside, kind)
            out = F.when(parent == name, found) if out is None else out.when(parent == name, found)
        return out

    df = df.withColumn(f"{prefix}region", _least(key, regions, "region"))
    df = df.withColumn(f"{prefix}rack", under(F.col(f"{prefix}region"), racks, "rack"))
    return df.withColumn(f"{prefix}shard", under(F.col(f"{prefix}rack"), shards, "shard").cast("int"))


def slots(df: DataFrame, group: str, order: list[str], buckets: int | None = None) -> DataFrame:
    """Adds slot, gapless from 0 in each group in the given order.

    Groups may be few and huge, so no window spans one: rows are numbered inside (group, range
    bucket of the first order column) and shifted by the counts of the buckets before, a table of
    groups times buckets rows.
    """
    bounds = range_bounds(df, order[0], buckets or partitions(df.sparkSession))
    df = df.withColumn("_part", range_bucket(F.col(order[0]), bounds))
    counts = df.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(group, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(group, "_part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    ranked = df.withColumn("_rank", F.row_number().over(inside))
    return ranked.join(shift, [group, "_part"]).withColumn("slot", F.col("_shift") + F.col("_rank") - 1).drop("_part", "_rank", "_shift")


def assign(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, region, rack, shard, slot and, for a grown tree, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = place(rows, key, tree, "")
    rows = place(rows, key, grown, "grown_") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    return slots(rows, "shard", ["doc_id", "text_crc32", "size"])


def draw_sql(tree: list[Leaf]) -> str:
    """The shard of doc_id as an SQL expression, written from the tree apart from place()."""
    regions, racks, shards = levels(tree)

    def least(children: dict, kind: str, leaf) -> str:
        names = sorted(children)
        if len(names) == 1:
            return leaf(names[0])
        draw = {n: f"(-ln((CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '/{kind}/{n}'), 1, 13) AS BIGINT) + 1) / {UNITS!r}) / {float(children[n])!r})" for n in names}
        cases = " ".join(f"WHEN {' AND '.join(f'{draw[n]} <= {draw[m]}' for m in names if m != n)} THEN {leaf(n)}" for n in names)
        return f"CASE {cases} END"

    rack = lambda r: least(shards[r], "shard", str)
    region = lambda g: least(racks[g], "rack", rack)
    return least(regions, "region", region)
