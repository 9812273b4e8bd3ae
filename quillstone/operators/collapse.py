"""Grouping many findings to one root cause, ranking, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def representatives(rows: DataFrame, keys: list[str], rank: list[Column], keep: list[str], measures: dict[str, Column]) -> DataFrame:
    """One row per keys: the kept columns of the row least in rank, and measures over all; added up on the map side."""
    out = rows.groupBy(*keys).agg(F.min_by(F.struct(*keep), F.struct(*rank)).alias("_first"), *[m.alias(c) for c, m in measures.items()])
    return out.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in keep], *measures)


def first_distinct(rows: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """Per keys, how many distinct values there are (n_distinct) and the first `most` of them, sorted (firsts). A key of many values is counted and ranked as rows, and never gathered."""
    each = rows.select(*keys, value).distinct()
    counts = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_distinct"))
    top = each.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).where(F.col("_k") <= most)
    return counts.join(top.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("firsts")), keys, "left")


def collapse(rows: DataFrame, keys: list[str], rank: list[Column], keep: list[str], fan_out: str, most: int = 200) -> DataFrame:
    """One row per keys: the kept columns of the row least in rank, how many rows, how many distinct fan_out values, and the first `most` of them."""
    out = representatives(rows, keys, rank, keep, {"occurrences": F.count(F.lit(1))})
    fan = first_distinct(rows.select(*keys, F.col(fan_out).cast("string").alias("_fan")).where("_fan is not null"), keys, "_fan", most)
    return out.join(fan, keys, "left").select(*keys, *keep, "occurrences", F.coalesce("n_distinct", F.lit(0)).alias("n_affected"), F.coalesce(F.array_join("firsts", ","), F.lit("")).alias("affected"))


def top_k(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their rank and how many were dropped; counted apart, so that Spark limits each key before the shuffle."""
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)
    return first.join(rows.groupBy(key).agg(F.greatest(F.count(F.lit(1)) - k, F.lit(0)).alias("dropped")), key)


def best_row(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def zero_filled(rows: DataFrame, bucket: str, names: list[str]) -> DataFrame:
    """Counts of all named buckets, empty ones too."""
    fixed = rows.sparkSession.createDataFrame([(n,) for n in names], f"{bucket} string")
    counts = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(fixed).join(counts, bucket, "left").select(bucket, F.coalesce("n", F.lit(0)).alias("n"))
