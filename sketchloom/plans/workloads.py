"""Sketches made of the driver tables: documents by word n-grams, suppliers by the parts they sell, pages' addresses as sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sketchloom.functions.ngrams import ngram_sets
from sketchloom.operators import grid_join
from sketchloom.sources import readers


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_sketches(rows: DataFrame, id_column: str, n: int = 3) -> DataFrame:
    """(id, mins) of the distinct word n-grams of text; shorter texts are empty sketches."""
    return ngram_sets(readers.spread(rows).select(F.col(id_column).alias("id"), F.split(F.lower("text"), r"\s+").alias("words")), n)


def document_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_sketches(read(spark, sf_dir, "documents"), "doc_id")


def supplier_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, hash): the parts that a supplier has sold."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("hash")).distinct()


def supplier_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = supplier_members(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n"))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).join(sold, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("size"))


def supplier_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed blocks of the listed suppliers with the parts that they have sold; a supplier without any is an empty sketch."""
    sold = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("hash")).where("hash is not null")
    listed = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(None).cast("long").alias("hash"))
    return grid_join.row_blocks(sold.unionByName(listed), listed=True)


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("sequence"))


def supplier_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, mins): suppliers with the parts they have sold as unsigned hashes, odd parts from 2**63 on, as text."""
    hashes = F.when(F.col("hash") % 2 == 1, F.col("hash").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).otherwise(F.col("hash").cast("decimal(20,0)"))
    sold = supplier_members(spark, sf_dir).groupBy("id").agg(F.array_sort(F.collect_list(hashes.cast("string"))).alias("mins"))
    names = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return names.join(sold, "id", "left").select("id", "name", F.coalesce("mins", F.array().cast("array<string>")).alias("mins"))
