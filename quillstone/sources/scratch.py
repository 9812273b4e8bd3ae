"""Tables, and the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where the table that cut() returned lies, by its Python object's attribute.
_PATH = "_quillstone_path"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a temporary one serves a single machine; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillstone-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: How much larger than its file a table may be: names that repeat are packed to a hundredth and less. Spark's default of 1 takes the file for the table, and broadcasts through the driver what is a hundred times its threshold.
PACKED = "100"


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here and lost executors cost nothing before it. Joins of such tables are planned as shuffles unless the file is tiny; a side that turns out small is broadcast at run time."""
    spark = df.sparkSession
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) < float(PACKED):
        spark.conf.set("spark.sql.sources.fileCompressionFactor", PACKED)
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete the folders of tables that cut() returned. Nothing may read them any more, nor what was derived from them without a cut. For many small tables."""
    for t in tables:
        if path := getattr(t, _PATH, None) if t is not None else None:
            spark = t.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame | None) -> None:
    """forget(), and ask for the shuffle files of large tables to go at once."""
    forget(*tables)
    for t in tables:
        if t is not None:
            # shuffle files that only made these tables go once the driver has collected what refers to them
            t.sparkSession._jvm.System.gc()
            break
