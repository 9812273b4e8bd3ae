"""Comparing two sides of a keyed table: what came, what went, what changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gone(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of old that new lacks (nulls compare equal)."""
    return old.select(*keys).subtract(new.select(*keys))


def changed_pairs(old: DataFrame, new: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Full outer pairing by key; pairs of equal digests go. Columns: keys, old_digest, new_digest."""
    a, b = old.select(*keys, F.col(digest).alias("old_digest")), new.select(*keys, F.col(digest).alias("new_digest"))
    return a.join(b, keys, "full_outer").where(~F.col("old_digest").eqNullSafe(F.col("new_digest")))


def value_drift(rows: DataFrame, key: str, value: str, is_new: Column) -> DataFrame:
    """Per key, the values only the old and only the new side has, sorted and comma-joined; keys without drift go."""
    sides = rows.groupBy(key).agg(F.collect_set(F.when(~is_new, F.col(value))).alias("o"), F.collect_set(F.when(is_new, F.col(value))).alias("n"))
    lost, gained = F.array_sort(F.array_except("o", "n")), F.array_sort(F.array_except("n", "o"))
    return sides.select(key, F.array_join(lost, ",").alias("lost"), F.array_join(gained, ",").alias("gained")).where("lost <> '' or gained <> ''")


def stranded(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys with an old alternative (array column alt) that holds no new alternative as a subset: callers that no longer get in."""
    pairs = old.select(key, F.col("alt").alias("a")).join(new.select(key, F.col("alt").alias("b")), key)
    met = pairs.groupBy(key, "a").agg(F.bool_or(F.size(F.array_except("b", "a")) == 0).alias("met"))
    return met.where(~F.col("met")).select(key).distinct()


def all_of(rows: DataFrame, key: str, ok: Column) -> DataFrame:
    """Keys all of whose rows satisfy ok."""
    return rows.groupBy(key).agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok")).where("ok").select(key)


def dividing(rows: DataFrame, key: str, item: str, wanted: DataFrame) -> DataFrame:
    """Relational division: keys that have every wanted item."""
    have = rows.select(key, item).distinct().join(wanted.select(item).distinct(), item, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = wanted.select(item).distinct().agg(F.count(F.lit(1)).alias("total"))
    return have.join(F.broadcast(total), F.col("n") == F.col("total"), "left_semi").select(key)


def match_two_passes(left: DataFrame, right: DataFrame, id_col: str, passes: list[list[str]]) -> DataFrame:
    """Greedy one-to-one matching in passes of equal keys: the k-th left row of a key, by id, gets the k-th right one; matched rows leave. Columns: left_id, right_id, pass."""
    found = []
    for n, keys in enumerate(passes, 1):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(id_col))
        # rows without a key match nothing; ranked, they would all meet in one task
        a, b = (d.dropna(subset=keys).withColumn("_k", rank).select(*keys, "_k", F.col(id_col).alias(side)) for d, side in ((left, "left_id"), (right, "right_id")))
        hit = a.join(b, [*keys, "_k"]).select("left_id", "right_id", F.lit(n).alias("pass"))
        found.append(hit)
        left = left.join(hit.select(F.col("left_id").alias(id_col)), id_col, "left_anti")
        right = right.join(hit.select(F.col("right_id").alias(id_col)), id_col, "left_anti")
    return reduce(DataFrame.unionByName, found)
