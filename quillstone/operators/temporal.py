"""As-of lookups, change-only archives, ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous_in_key(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the value of the row before, in its key."""
    return rows.withColumn(name, F.lag(value).over(Window.partitionBy(key).orderBy(*order)))


def change_only(rows: DataFrame, key: str, order: list[str], digest: str) -> DataFrame:
    """Rows whose digest differs from the row before in their key: what a write-on-change archive stores."""
    before = F.lag(digest).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col(digest))).drop("_before")


def age(rows: DataFrame, key: str, at: str, today: Column) -> DataFrame:
    """Per key, days from its last row to today."""
    return rows.groupBy(key).agg(F.datediff(today, F.max(F.to_date(at))).cast("bigint").alias("age_days"))


def late(rows: DataFrame, order: str, at: str, lag: str) -> DataFrame:
    """Rows that come, in the order of a column, more than `lag` behind the greatest time before them. The greatest is found in ranges of the order and carried over them, so no task sees all rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.percentile_approx(order, [k / n for k in range(1, n)] or [0.5], 10_000).alias("b")).first()["b"]
    bounds = sorted(set(found or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    rows = rows.withColumn("_b", bucket)
    # a row for each range: few
    tops = rows.groupBy("_b").agg(F.max(at).alias("_top")).withColumn("_before", F.max("_top").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    here = F.max(at).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = rows.join(F.broadcast(tops), "_b").withColumn("_seen", F.greatest(here, "_before"))
    return seen.where(F.col(at) < F.col("_seen") - F.expr(f"interval {lag}")).drop("_b", "_before", "_seen")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], ties: str) -> DataFrame:
    """left with, of each of its rows, `values` of the last row of right with the same key and no later time; null where there is none, or where key or time is null.

    Both tables are put in one order of (key, time). It is cut into ranges of about the same number of
    rows, a window finds the last value within each key and range, and the last of the ranges before is
    carried over by a table of a row for each key and range it has right rows in: a key may hold any
    share of the rows. Of right rows of one time the one with the greatest `ties` counts. Columns of
    right other than `values` are not read; names of left that it shares are left's own.
    """
    spark = left.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = [f"_v{i}" for i in range(len(values))]
    value = F.struct(*[F.col(v).alias(c) for v, c in zip(values, named, strict=True)])
    whole = F.struct(*[F.col(c) for c in left.columns])
    rights = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(ties).cast("string").alias("_tie"), value.alias("_value"))
    lefts = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), whole.alias("_left"))
    both = rights.unionByName(lefts, allowMissingColumns=True)
    # ranges of time, the same for all keys: a hot key is cut as often as its rows need
    at = F.col("_t").cast("timestamp").cast("double")
    found = both.agg(F.percentile_approx(at, [k / n for k in range(1, n)] or [0.5], 10_000).alias("b")).first()["b"]
    bounds = sorted(set(found or []))
    both = both.withColumn("_b", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= at)) if bounds else F.lit(0))
    order = [F.col("_t"), F.col("_side"), F.col("_tie")]
    here = F.last("_value", ignorenulls=True).over(Window.partitionBy("_k", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tops = both.where("_side = 0").groupBy("_k", "_b").agg(F.max_by("_value", F.struct("_t", "_tie")).alias("_top"))
    # a key has at most a row for each range here
    grid = both.select("_k", "_b").distinct().join(tops, ["_k", "_b"], "left")
    carried = grid.withColumn("_before", F.last("_top", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_k", "_b", "_before")
    seen = both.withColumn("_here", here).where("_side = 1")
    out = seen.join(carried, seen["_k"].eqNullSafe(carried["_k"]) & (seen["_b"] == carried["_b"]), "left").select(seen["_left"], F.when(seen["_t"].isNotNull() & seen["_k"].isNotNull(), F.coalesce("_here", "_before")).alias("_found"))
    return out.select("_left.*", *[F.col(f"_found.{c}").alias(v) for v, c in zip(values, named, strict=True)])
