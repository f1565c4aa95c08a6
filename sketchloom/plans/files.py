"""Registered queries over the file formats: tables are written as files of each format and read back, with the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.functions import kmers, u64
from sketchloom.operators import compare, dereplication, grid_join, pairs, sketches
from sketchloom.plans import workloads
from sketchloom.plans.queries import ORACLES as PLAIN
from sketchloom.plans.queries import PAIRS_SQL, SUPPLIERS_SQL
from sketchloom.sources import readers, sinks
from sketchloom.sources.staging import new_folder, unless_many, written


def _suppliers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return workloads.supplier_members(spark, sf_dir), workloads.supplier_sizes(spark, sf_dir)


def _similar(spark: SparkSession, sf_dir: str, threshold: float | None = None, with_sizes: bool = False) -> DataFrame:
    return pairs.measured(grid_join.half_of(workloads.supplier_blocks(spark, sf_dir), threshold), threshold, with_sizes)


def _lists(spark: SparkSession, rows: DataFrame, column: str) -> str:
    """A list file of a column in order of id."""
    path = new_folder(spark, "list")
    rows.orderBy("id").select(column).coalesce(1).write.text(path)  # a list file is one file; it has a line a sketch
    return path


def sketch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sketch files, every fourth compressed and one missing, read by a file list; a row for each hash, and one for a sketch without any."""
    made = written(workloads.supplier_sketches(spark, sf_dir), "supplier-sketches")
    root = new_folder(spark, "sketch-files")
    sinks.write_sketches(made.where("id % 4 <> 0"), f"{root}/plain")
    sinks.write_sketches(made.where("id % 4 = 0"), f"{root}/packed", compressed=True)
    found = readers.sketch_paths(spark, f"{root}/*").select(F.regexp_extract("path", "id=([0-9]+)", 1).cast("int").alias("id"), "path")
    listed = found.union(made.agg((F.max("id") + 1).cast("int").alias("id")).select("id", F.lit(f"{root}/plain/none.sig").alias("path")))
    files = readers.read_file_list(spark, _lists(spark, listed, "path"))
    read = readers.read_sketches(spark, files)
    return read.select(F.col("id").cast("long").alias("id"), "name", "missing", F.explode_outer("mins").alias("hash")).select("id", "name", "missing", u64.to_text(F.col("hash")).alias("hash"))


def index_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index as text, read back."""
    path = new_folder(spark, "index-file")
    sinks.write_hash_index(sketches.hash_index(_suppliers(spark, sf_dir)[0]), path, text=True)
    return readers.read_hash_index(spark, path).select("hash", F.explode("ids").alias("id"))


def index_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings in segments of 16 suppliers."""
    segments = sketches.posting_segments(_suppliers(spark, sf_dir)[0], 16)
    return segments.select("hash", "segment", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


def index_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten index entries of smallest hash."""
    sample = sketches.index_sample(sketches.hash_index(_suppliers(spark, sf_dir)[0]))
    return sample.select("hash", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


def pair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as shards without header, read back as one table."""
    path = new_folder(spark, "pair-files")
    sinks.write_pairs(_similar(spark, sf_dir, 0.01), path, compression="gzip")
    return readers.read_pairs(spark, path)


def plain_pair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "plain-pairs")
    sinks.write_plain_pairs(_similar(spark, sf_dir), path, compression="gzip")
    return readers.read_plain_pairs(spark, path)


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs against a result table by names, with self matches, every third query's values disturbed and every fifth match gone."""
    names = workloads.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    listed = new_folder(spark, "names")
    sinks.write_names(names, listed)
    ids = unless_many(names)
    similar = _similar(spark, sf_dir)
    at = lambda x, key: ids.select(F.col("id").alias(key), F.col("name").alias(f"{x}_name"), F.md5("name").alias(f"{x}_md5"))
    own = workloads.supplier_sizes(spark, sf_dir).where("size > 0").select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("size").cast("long").alias("intersection"), *[F.lit(1.0).alias(x) for x in ("jaccard", "c_ij", "c_ji")])
    shown = similar.where("j % 5 <> 0").unionByName(own).join(at("query", "i"), "i").join(at("match", "j"), "j")
    off = F.when(F.col("i") % 3 == 0, 0.01).otherwise(0.0)
    path = new_folder(spark, "search-results")
    sinks.write_search_results(shown.select("query_name", "query_md5", "match_name", "match_md5", (F.col("c_ij") + off).alias("containment"), F.greatest("c_ij", "c_ji").alias("max_containment"), "jaccard", F.col("intersection").alias("intersect_hashes")), path, compression="gzip")
    read = readers.read_names(spark, listed)  # suppliers are numbered from 0, as lines are
    return compare.compare_search_results(similar, read, readers.read_search_results(spark, path))


def selected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """De-replicated suppliers as a list of paths by ascending size, read back by line."""
    blocks = workloads.supplier_blocks(spark, sf_dir)  # sizes are read from them as well, members are not shuffled again for them
    sizes = grid_join.sizes(blocks)
    edges = pairs.measured(grid_join.half_of(blocks, 0.3), 0.3, with_sizes=True).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("n_i").alias("src_size"), F.col("n_j").alias("dst_size"))
    path = new_folder(spark, "selected")
    sinks.write_selected(dereplication.dereplicate(sizes, edges).withColumn("path", F.concat(F.lit("/sketches/supplier"), "id", F.lit(".sig"))).repartition(1), path)
    return readers.read_lines(spark, path, "path")


def selected_against_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of selected files against the md5sum column of a table: what only one has."""
    sizes = workloads.supplier_sizes(spark, sf_dir)
    chosen, table = new_folder(spark, "selected"), new_folder(spark, "md5-table")
    sinks.write_selected(sizes.where("id % 2 = 0").withColumn("path", F.concat(F.lit("/x/"), F.md5(F.col("id").cast("string")), F.lit(".sig"))), chosen)
    sizes.where("id % 3 = 0").select(F.lit("x").alias("name"), F.md5(F.col("id").cast("string")).alias("md5sum")).write.option("sep", "\t").option("header", True).csv(table)
    return compare.set_difference(readers.read_md5_table(spark, table), readers.read_selected(spark, chosen))


def dense_matrix_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense Jaccard matrix as text, read back to cells by line and place."""
    members, sizes = _suppliers(spark, sf_dir)
    path = new_folder(spark, "dense-matrix")
    sinks.write_dense_rows(pairs.jaccard_rows(pairs.intersections(members), sizes), path, compression="gzip")
    return readers.read_dense_matrix(spark, path).select("i", F.posexplode("row").alias("j", "value"))


def matrix_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, sizes = _suppliers(spark, sf_dir)
    first = F.broadcast(pairs.first_ids(sizes))  # no other sketch has a cell in the preview
    members, sizes = members.join(first, "id", "left_semi"), sizes.join(first, "id", "left_semi")
    return pairs.matrix_preview(pairs.intersection_matrix(pairs.intersections(members), sizes), sizes)


def presence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sketches.presence_rows(sketches.presence_matrix(workloads.supplier_members(spark, sf_dir)))
    return rows.select("id", F.array_join(F.col("cols").cast("array<string>"), " ").alias("cols"))


def fasta_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' addresses as a sequence file of many records, their k-mers hashed, written as text and read back."""
    path, out = new_folder(spark, "fasta"), new_folder(spark, "kmer-hashes")
    pages = workloads.page_sequences(spark, sf_dir)
    pages.select(F.concat(F.lit(">"), F.col("id").cast("string"), F.lit("\n"), F.substring("sequence", 1, 30), F.lit("\n"), F.substring("sequence", 31, 1 << 30))).write.text(path)
    records = readers.read_fasta(spark, path, per_record=True).select(F.col("header").cast("long").alias("id"), "sequence")
    sinks.write_kmer_hashes(kmers.kmer_hashes(records), out)
    return spark.read.text(out).select(*[F.split("value", " ")[k].alias(c) for k, c in enumerate(("kmer", "h1", "h2"))])


def greedy_one_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy selection with edges that go one way and many equal sizes."""
    sizes = workloads.supplier_sizes(spark, sf_dir).select("id", F.floor(F.col("size") / 40).cast("int").alias("size"))
    found = _similar(spark, sf_dir, with_sizes=True).where("(7 * i + 3 * j) % 11 = 0")
    edges = found.select(F.col("i").alias("src"), F.col("j").alias("dst"), *[F.floor(F.col(n) / 40).cast("int").alias(x) for x, n in (("src_size", "n_i"), ("dst_size", "n_j"))])
    return dereplication.dereplicate(sizes, edges, symmetric_ties=False)


def _sold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts that two suppliers have sold."""
    sold = workloads.supplier_members(spark, sf_dir)
    return sold.where("id = 1").select(F.col("hash").alias("key")), sold.where("id = 2").select(F.col("hash").alias("key"))


def set_compare_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.set_summary(*_sold(spark, sf_dir))


def set_difference_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.set_difference(*_sold(spark, sf_dir))


def bag_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as bags of parts: intersections by the smaller count."""
    return pairs.minimum_multiplicity(workloads.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("hash")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        sketch_files, index_file, index_segments, index_sample, pair_files, plain_pair_files, search_results, selected_files, selected_against_md5, dense_matrix_file,
        matrix_preview, presence_rows, fasta_kmers, greedy_one_way, set_compare_parts, set_difference_parts, bag_intersection,
    )
}

_S = SUPPLIERS_SQL + PAIRS_SQL
_DEREPLICATED = """SELECT id, size FROM m_n WHERE id NOT IN (SELECT i FROM s JOIN m_n p ON i = p.id JOIN m_n q ON j = q.id
  WHERE c_ij >= 0.3::FLOAT::DOUBLE AND (q.size > p.size OR q.size = p.size AND j > i))"""
_SOLD = "WITH a AS (SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_suppkey = 1), b AS (SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_suppkey = 2)"

ORACLES: dict[str, str] = {
    "sketch_files": f"""{SUPPLIERS_SQL} SELECT s_suppkey AS id, s_name AS name, false AS missing, CASE WHEN hash % 2 = 1 THEN (hash::HUGEINT + 9223372036854775808)::VARCHAR ELSE hash::VARCHAR END AS hash
  FROM supplier LEFT JOIN m ON s_suppkey = m.id UNION ALL SELECT max(s_suppkey) + 1, NULL, true, NULL FROM supplier""",
    "index_file": f"{SUPPLIERS_SQL} SELECT hash, id::INTEGER AS id FROM m WHERE hash IN (SELECT hash FROM m GROUP BY hash HAVING count(*) > 1)",
    "index_segments": f"{SUPPLIERS_SQL} SELECT hash, id // 16 AS segment, string_agg(id::VARCHAR, ' ' ORDER BY id) AS ids FROM m GROUP BY hash, id // 16",
    "index_sample": f"{SUPPLIERS_SQL} SELECT hash, string_agg(id::VARCHAR, ' ' ORDER BY id) AS ids FROM m GROUP BY hash HAVING count(*) > 1 ORDER BY hash LIMIT 10",
    "pair_files": f"{_S} SELECT i::INTEGER AS i, j::INTEGER AS j, jaccard, c_ij, c_ji FROM s WHERE c_ij >= 0.01::FLOAT::DOUBLE",
    "plain_pair_files": f"{_S} SELECT i::INTEGER AS i, j::INTEGER AS j, jaccard FROM s",
    "search_results": f"""{_S} SELECT i, j, CASE WHEN j % 5 = 0 THEN 'extra' WHEN i % 3 = 0 THEN 'different' ELSE 'equal' END AS status FROM s""",
    "selected_files": f"{_S}, d AS ({_DEREPLICATED}) SELECT (row_number() OVER (ORDER BY size, id) - 1)::INTEGER AS id, '/sketches/supplier' || id || '.sig' AS path FROM d",
    "selected_against_md5": "SELECT md5(s_suppkey::VARCHAR) AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'left' ELSE 'right' END AS side FROM supplier WHERE (s_suppkey % 2 = 0) <> (s_suppkey % 3 = 0)",
    "dense_matrix_file": f"""{_S}, n AS (SELECT id, (row_number() OVER (ORDER BY id) - 1)::INTEGER AS k FROM m_n)
SELECT a.k AS i, b.k AS j, CASE WHEN a.id = b.id THEN 1.0::DOUBLE ELSE coalesce(jaccard, 0.0::DOUBLE) END AS value FROM n a CROSS JOIN n b LEFT JOIN s ON s.i = a.id AND s.j = b.id""",
    "matrix_preview": f"""{_S}, f AS (SELECT id, size FROM m_n ORDER BY id LIMIT 10)
SELECT a.id AS i, b.id AS j, CASE WHEN a.id = b.id THEN a.size ELSE coalesce(intersection, 0) END::DOUBLE AS value FROM f a CROSS JOIN f b LEFT JOIN x ON x.i = a.id AND x.j = b.id""",
    "presence_rows": f"""{SUPPLIERS_SQL}, c AS (SELECT hash, row_number() OVER (ORDER BY hash) - 1 AS col FROM (SELECT DISTINCT hash FROM m))
SELECT id, string_agg(col::VARCHAR, ' ' ORDER BY col) AS cols FROM m JOIN c USING (hash) GROUP BY id""",
    "fasta_kmers": f"SELECT kmer, h1, h2 FROM ({PLAIN['kmer_mmh3']})",
    "greedy_one_way": f"""{SUPPLIERS_SQL.replace("WITH", "WITH RECURSIVE", 1)}{PAIRS_SQL}, z AS (SELECT id, (size // 40)::INTEGER AS size FROM m_n),
o AS (SELECT id, size, row_number() OVER (ORDER BY size, id) AS k FROM z),
nb AS (SELECT o.k, o.id, coalesce(list(q.id) FILTER (q.size >= o.size), []) AS near FROM o LEFT JOIN s ON s.i = o.id AND (7 * s.i + 3 * s.j) % 11 = 0 LEFT JOIN z q ON q.id = s.j GROUP BY o.k, o.id),
r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL
  SELECT nb.k, CASE WHEN len(list_filter(near, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, nb.id) ELSE gone END FROM r JOIN nb ON nb.k = r.k + 1)
SELECT id, size FROM z WHERE NOT list_contains((SELECT gone FROM r ORDER BY k DESC LIMIT 1), id)""",
    "set_compare_parts": f"""{_SOLD} SELECT count(*) FILTER (b.key IS NULL) AS left_only, count(*) FILTER (a.key IS NULL) AS right_only, count(*) FILTER (a.key = b.key) AS common,
  count(*) FILTER (a.key = b.key)::DOUBLE / count(*) AS jaccard FROM a FULL JOIN b ON a.key = b.key""",
    "set_difference_parts": f"{_SOLD} SELECT key, 'left' AS side FROM (SELECT key FROM a EXCEPT SELECT key FROM b) UNION ALL SELECT key, 'right' FROM (SELECT key FROM b EXCEPT SELECT key FROM a)",
    "bag_intersection": """WITH c AS (SELECT l_suppkey AS id, l_partkey AS hash, count(*) AS m FROM lineitem GROUP BY l_suppkey, l_partkey)
SELECT a.id AS i, b.id AS j, sum(least(a.m, b.m))::BIGINT AS intersection FROM c a JOIN c b ON a.hash = b.hash AND a.id < b.id GROUP BY a.id, b.id""",
}
