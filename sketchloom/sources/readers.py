"""Readers of the file formats: every scan has an explicit schema and is split by file."""

from __future__ import annotations

import gzip
import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.functions import u64
from sketchloom.sources import splits

SKETCH_JSON = f"array<struct<name:string,signatures:array<struct<mins:array<{u64.TEXT_TYPE}>>>>>"
PAIRS = "i int, j int, jaccard double, c_ij double, c_ji double"
SEARCH_RESULTS = "query_name string, query_md5 string, match_name string, match_md5 string, containment double, max_containment double, jaccard double, intersect_hashes bigint"


def spread(table: DataFrame) -> DataFrame:
    """A table of fewer files and of fewer input splits than the cluster has cores, dealt anew so that all of them work. Tables of many files, and large files that are split anyway, are left where they lie."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    few = 0 < len(table.inputFiles()) < cores and table.rdd.getNumPartitions() < cores
    return table.repartition(2 * cores) if few else table


def read_lines(spark: SparkSession, path: str, column: str, long: bool = False) -> DataFrame:
    """(id, column) of the lines of a list, trimmed, empty ones left out; the line's number is the id, counted on over the files of a folder."""
    lines = splits.numbered_lines(spark, path, long)
    return lines.select(F.col("number").cast("int").alias("id"), F.trim("value").alias(column)).where(F.col(column) != "")


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, "path")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, "name")


def plain_path(path: Column) -> Column:
    """A path without scheme and escapes, as file lists write it."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), "^file:/+", "/")


def sketch_paths(spark: SparkSession, pattern: str) -> DataFrame:
    """(path) of the files of a pattern, by the names that Spark lists them by."""
    return spark.read.format("binaryFile").load(pattern).select(plain_path(F.col("path")).alias("path"))


def default_root(spark: SparkSession) -> str:
    return spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").rstrip("/")


def file_system(path: str, root: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path, and the path there; without a scheme it is one of root, the default file system."""
    bare = re.sub("^file:/+", "/", path)
    local = "://" not in bare and (root.startswith("file:") or bare != path)
    return (fs.LocalFileSystem(), bare) if local else fs.FileSystem.from_uri(bare if "://" in bare else root + bare)


def _contents(root: str):
    """Paths to the text of their files, read where the task runs; .gz files are decompressed, a missing file has none."""
    schema = pa.schema([("path", pa.string()), ("value", pa.large_string())])

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, place = file_system(path, root)
                text = None
                if system.get_file_info(place).is_file:
                    with system.open_input_stream(place, compression=None) as f:
                        data = f.read()
                    text = (gzip.decompress(data) if path.endswith(".gz") else data).decode()
                yield pa.RecordBatch.from_pydict({"path": [path], "value": [text]}, schema)

    return run


def read_sketches(spark: SparkSession, files: DataFrame, bag: bool = False) -> DataFrame:
    """files(id, path) -> id, path, name, mins (bit patterns), missing.

    Files are looked up and read by the tasks that have their part of the list, so the driver sees no path. Paths without a
    scheme are those of the default file system; Arrow must know the scheme (local files, HDFS, S3, GCS).

    Reads the first element and first signature of each JSON file; .gz files are decompressed by suffix. A missing file
    keeps its row with an empty sketch and missing = true, one without signatures likewise with missing = false. Hashes
    become distinct unless bag.
    """
    root = default_root(spark)
    dealt = files.select("id", "path").repartition("path")  # a list is a small file: reading its files is the work
    parsed = dealt.select("path").distinct().mapInArrow(_contents(root), "path string, value string").select("path", F.col("value").isNull().alias("missing"), F.from_json("value", SKETCH_JSON)[0].alias("x"))
    mins = F.transform(F.try_element_at("x.signatures", F.lit(1))["mins"], u64.to_bits)
    read = parsed.select("path", F.col("x.name").alias("name"), F.coalesce(mins if bag else F.array_distinct(mins), F.array().cast("array<bigint>")).alias("mins"), "missing")
    return dealt.join(read, "path").select("id", "path", "name", "mins", "missing")


def read_hash_index(spark: SparkSession, path: str) -> DataFrame:
    """(hash, ids) from lines of `hash id id ...`."""
    parts = F.split(F.trim("value"), " +")
    return spark.read.text(path).where(F.trim("value") != "").select(u64.to_bits(parts[0]).alias("hash"), F.transform(F.slice(parts, 2, 1 << 30), lambda x: x.cast("int")).alias("ids"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pair rows of one file or a directory of shards."""
    return spark.read.schema(PAIRS).csv(path)


def read_plain_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of `i j jaccard`."""
    return spark.read.schema("i int, j int, jaccard double").option("sep", " ").csv(path)


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEARCH_RESULTS).option("header", True).csv(path)


def read_selected(spark: SparkSession, path: str) -> DataFrame:
    """Ids of selected sketches: the file names of a list of paths without `.sig`."""
    return spark.read.text(path).where("value <> ''").select(sketch_key(F.col("value")).alias("key"))


def sketch_key(path: Column) -> Column:
    return F.replace(F.regexp_extract(path, "([^/]*)$", 1), F.lit(".sig"), F.lit(""))


def read_md5_table(spark: SparkSession, path: str) -> DataFrame:
    """Column key from the md5sum column of a tab-separated file with header."""
    return spark.read.option("sep", "\t").option("header", True).csv(path).select(F.col("md5sum").alias("key"))


def read_fasta(spark: SparkSession, path: str, per_record: bool = False) -> DataFrame:
    """(path, header, sequence) of small sequence files: a file's records joined under its last header, or with per_record each record by itself. A file is one row; splits.sequence_chunks() reads files of any size."""
    files = spark.read.text(path, wholetext=True).select(plain_path(F.col("_metadata.file_path")).alias("path"), "value")
    if per_record:
        record = F.split(F.col("record"), r"\r?\n", 2)
        rows = files.select("path", F.explode(F.slice(F.split("value", r"(?m)^>"), 2, 1 << 30)).alias("record"))
        return rows.select("path", record[0].alias("header"), F.regexp_replace(F.coalesce(F.get(record, F.lit(1)), F.lit("")), r"[\r\n]", "").alias("sequence"))
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x != "")
    headers = F.filter(lines, lambda x: x.startswith(">"))
    header = F.substring(F.coalesce(F.try_element_at(headers, F.lit(-1)), F.lit(">")), 2, 1 << 30)
    return files.select("path", header.alias("header"), F.array_join(F.filter(lines, lambda x: ~x.startswith(">")), "").alias("sequence"))


def read_dense_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, row) of a space-separated matrix in one file."""
    lines = read_lines(spark, path, "line", long=True)
    return lines.select(F.col("id").alias("i"), F.transform(F.split("line", " +"), lambda x: x.cast("double")).alias("row"))
