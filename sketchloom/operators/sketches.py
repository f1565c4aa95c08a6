"""Sketches in long form, their sizes, the inverted index, and the presence matrix.

sketches(id, mins) is the nested form; members(id, hash) the long form with distinct rows; sizes(id, size) has a row for
every sketch, empty ones included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.functions import u64
from sketchloom.sources.staging import shared_root, written


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def members(sketches: DataFrame, bag: bool = False) -> DataFrame:
    return sketches.select("id", F.explode(F.col("mins") if bag else F.array_distinct("mins")).alias("hash"))


def sized_members(sketches: DataFrame) -> DataFrame:
    """(id, size, hash): the long form with every sketch's size, so that later measures need no join with sizes."""
    distinct = F.array_distinct("mins")
    # two steps: beside an explode the size would be computed anew for every member
    return sketches.select("id", F.size(distinct).alias("size"), distinct.alias("d")).select("id", "size", F.explode("d").alias("hash"))


def sizes(sketches: DataFrame, bag: bool = False) -> DataFrame:
    return sketches.select("id", F.size(F.col("mins") if bag else F.array_distinct("mins")).alias("size"))


def empty_sketches(sizes: DataFrame) -> DataFrame:
    return sizes.where("size = 0").select("id")


def hash_index(members: DataFrame, min_df: int = 2) -> DataFrame:
    """(hash, ids) of the hashes in at least min_df sketches, ids ascending."""
    return members.groupBy("hash").agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") >= min_df)


def posting_segments(members: DataFrame, span: int = 1 << 20) -> DataFrame:
    """(hash, segment, ids): postings in segments of ids from segment * span on, so that the list of a hash in a third of all sketches is no task's work alone."""
    return members.groupBy("hash", F.floor(F.col("id") / span).alias("segment")).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def index_members(index: DataFrame) -> DataFrame:
    """The long form of an index that was written earlier."""
    return index.select(F.explode("ids").alias("id"), "hash")


def index_stats(members: DataFrame, min_df: int = 2) -> DataFrame:
    """One row: hashes and postings of the index, without building it."""
    df = members.groupBy("hash").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    return df.agg(F.count("*").alias("n_hashes"), F.coalesce(F.sum("df"), F.lit(0)).alias("n_postings"), F.coalesce(F.max("df"), F.lit(0)).alias("max_df"))


def index_sample(index: DataFrame, n: int = 10) -> DataFrame:
    """The n entries of smallest unsigned hash, a report."""
    return index.orderBy(u64.order_key(F.col("hash"))).limit(n)


def _ranks(batches):
    """Rows in order of key -> the place of each row's key among the distinct keys of the partition, from 0."""
    before, rank = None, -1
    for batch in batches:
        keys = batch.column("key").to_numpy()
        if not len(keys):
            continue
        new = np.concatenate([[before is None or keys[0] != before], keys[1:] != keys[:-1]])
        ranks = rank + np.cumsum(new, dtype=np.int64)
        before, rank = keys[-1], int(ranks[-1])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(ranks)], names=["id", "part", "rank"])


def presence_matrix(members: DataFrame) -> DataFrame:
    """(id, col): col is the place of the hash among all distinct hashes in unsigned order, from 0.

    Members themselves are sorted in ranges of hashes, and that is the only time they are shuffled: a member's place is that of
    its hash among the partition's, plus the distinct hashes of the partitions before it. Members are written once, as the
    bounds of the ranges are found by reading them.
    """
    members = written(members.where("hash is not null"), "presence-members")
    ordered = members.select("id", u64.order_key(F.col("hash")).alias("key")).repartitionByRange("key").sortWithinPartitions("key")
    kind = members.schema["id"].dataType.simpleString()
    ranked = written(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(_ranks, f"id {kind}, part int, rank long"), "presence-ranks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranked.groupBy("part").agg((F.max("rank") + 1).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return ranked.join(F.broadcast(starts), "part").select("id", (F.col("rank") + F.col("before")).alias("col"))  # a row for each partition of the sort


def presence_rows(presence: DataFrame) -> DataFrame:
    """(id, cols) with ascending columns."""
    return presence.groupBy("id").agg(F.array_sort(F.collect_list("col")).alias("cols"))


def space_usage(sketches: DataFrame, members: DataFrame, names: DataFrame | None = None, passes: int = 1, min_df: int = 2) -> DataFrame:
    """One row of whole MB (2**20 bytes): what matrix, index, sketches and names would take as plain arrays. Of sketches only the rows count: any table with one for each will do."""
    mb = F.lit(1 << 20)
    n = sketches.agg(F.count("*").alias("n"))
    df = members.groupBy("hash").agg(F.count("*").alias("df"))  # of all postings, so that members are made once
    listed = F.sum(F.when(F.col("df") >= min_df, 8 + 4 * F.col("df")))
    size = df.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("postings"), F.coalesce(listed, F.lit(0)).alias("index_bytes"))
    text = (names if names is not None else sketches.select(F.lit("").alias("name"))).agg(F.coalesce(F.sum(F.octet_length("name")), F.lit(0)).alias("name_bytes"))
    whole = lambda x: F.floor(x / mb).cast("long")
    rows = n.crossJoin(size).crossJoin(text)  # one row each
    return rows.select(F.floor(4 * F.col("n") * F.col("n") / (mb * passes)).cast("long").alias("matrix_mb"), whole(F.col("index_bytes")).alias("index_mb"), whole(8 * F.col("postings")).alias("sketches_mb"), whole(F.col("name_bytes")).alias("names_mb"))
