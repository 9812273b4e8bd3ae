"""Samples that are the same under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed(seed: int | str, *names: str) -> Column:
    """A draw for a row, from a seed and what names it: 128 bits as text."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]))


def bottom_k(rows: DataFrame, strata: list[str], names: list[str], k: int, seed: int | str) -> DataFrame:
    """k rows of each stratum, those with the least draws: every k of its rows are as likely as any others.

    Sketches merge: the k least of a stratum are among the k least of any of its shares, so shares are
    cut to k first, and no task sees a whole stratum. A stratum of fewer rows is taken whole. Rows of
    the same names have the same draw; of those the one that sorts first by all columns counts first.
    Null strata are strata; no rows, no sample; a k below 1 takes none.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = [F.to_json(F.struct(*rows.columns))]
    drawn = rows.withColumn("_draw", keyed(seed, *names)).withColumn("_share", F.pmod(F.xxhash64("_draw"), F.lit(max(n, 1))))
    least = lambda d, by: d.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_draw", *ties))).where(F.col("_rank") <= k)
    return least(least(drawn, [*strata, "_share"]), strata).drop("_draw", "_share", "_rank")
