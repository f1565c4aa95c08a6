"""Written tables in the folder that the cluster shares, used to cut lineage."""

from __future__ import annotations

import contextlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.sources.readers import spread
from sketchloom.sources.staging import new_folder, shared_root, shuffles_dropped, written

__all__ = ["bucketed", "own_name", "released", "shared_root", "small_batches", "small_table", "table", "unless_large", "written"]


def released(*staged: DataFrame | None) -> None:
    """Deletes tables that written() made, after their last reader."""
    for df in staged:
        if df is not None and (path := df.__dict__.pop("staged_path", None)):
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def small_table(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A table of the driver's own, by Arrow: rows given as Python objects would start a second set of Python workers in every executor."""
    return spark.createDataFrame(pa.table(columns))


def own_name(name: str) -> str:
    """A column name that no table of a user has."""
    return f"{name}_{uuid.uuid4().hex}"


def unless_large(df: DataFrame, rows: int) -> DataFrame:
    """A staged table, to be broadcast in a join if it has at most so many rows; else Spark chooses a shuffle join."""
    return F.broadcast(df) if df.count() <= rows else df


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """df, written to the shared folder in buckets by a column and read back: grouping by that column then leaves it where it lies."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    table = f"staged_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(table)
    out = spark.table(table)
    out.staged_path = path
    return out


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of at most so many rows for the jobs run inside: a batch of whole texts is held several times over by both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
