"""Folders that driver and executors share, for tables that are written to cut lineage and for files made of tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary folder in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-stage-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_made: list[str] = []  # folders that this driver has given out and scope() has not deleted


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    _made.append(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def _at(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file system that Spark knows has the path."""
    system, place = _at(spark, path)
    return system.exists(place)


def make_folder(spark: SparkSession, path: str) -> None:
    system, place = _at(spark, path)
    system.mkdirs(place)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder; one that is gone already is no error."""
    system, place = _at(spark, path)
    system.delete(place, True)


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Owns the tables and files that operators write to the shared folder inside the block: they are deleted at its end. Results are read or written elsewhere before that."""
    begun = len(_made)
    try:
        yield
    finally:
        for path in _made[begun:]:
            delete(spark, path)
        del _made[begun:]


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of the jobs run inside are deleted when each job ends; otherwise they stay until the driver's garbage collector finds them, which in a long job may be never."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """df, written as Parquet to the shared folder, or to a path of the caller's, and read back: later steps survive lost executors and never recompute it. What its making shuffled is deleted. options are the writer's."""
    mode, path = ("error", new_folder(df.sparkSession, name)) if path is None else ("overwrite", path)
    with shuffles_dropped(df.sparkSession):
        df.write.options(compression="zstd", **options).mode(mode).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


FEW = 1 << 20  # rows of ids or names that are broadcast


def unless_many(df: DataFrame, rows: int = FEW) -> DataFrame:
    """A narrow table that is cheap to count, to be broadcast in a join if it has at most so many rows; else the join is by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
