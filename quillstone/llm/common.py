"""What the text operators share: Arrow batches, range buckets, and from the library tables and cutting lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.scratch import cut, drop, table

__all__ = ["ROW", "cut", "drop", "map_arrow", "partitions", "range_bounds", "range_bucket", "small_batches", "table", "texts_of"]

#: Names a row of documents by 128 bits of its id and text, whatever its id.
ROW = "unhex(concat(lpad(hex(xxhash64(doc_id, text)), 16, '0'), lpad(hex(xxhash64(text, doc_id, 7)), 16, '0')))"
#: Names of rows are broadcast up to so many, 16 bytes each; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1 << 18
#: Rows and bytes in an Arrow batch, whichever is reached first: long texts do not pile up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session's Python stages. The session keeps the bounds: they are read when a lazy result runs, after this returns."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with a worker made once per task by make()."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            yield from work(b)

    return df.mapInArrow(run, schema)


def range_bounds(df: DataFrame, column: str, n: int) -> list:
    """At most n - 1 values of the column, ascending, that split its rows about evenly; all are values of the column."""
    if n < 2:
        return []
    at = [k / n for k in range(1, n)]
    got = df.agg(F.percentile_approx(F.col(column), at, 10_000).alias("b")).first()["b"]
    return sorted(set(got or []))


def range_bucket(column: Column, bounds: list) -> Column:
    """How many bounds are <= column (null: 0), in about 2 sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = bounds[step - 1 :: step]
    rest = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    count = lambda array: F.size(F.filter(array, lambda b: b <= column))
    block = count(F.array(*map(F.lit, coarse)))
    inner = F.get(F.array(*[F.array(*map(F.lit, x)) for x in rest]), block)
    return F.when(column.isNull(), 0).otherwise(block * step + F.when(inner.isNull(), 0).otherwise(count(inner)))


def some_rows(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table of names of rows, marked for a broadcast if it is small. It is counted, so it should be cut."""
    return F.broadcast(rows) if rows.count() <= most else rows


def texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """row and text of the given distinct rows, each once."""
    return docs.select(F.expr(ROW).alias("row"), "text").join(some_rows(rows), "row", "left_semi").dropDuplicates(["row"])
