"""Registered queries of the operators for large collections: threshold join, hot hashes, bitmaps, stored index, passes, sequence files by splits; and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.functions import kmers, u64
from sketchloom.operators import bitmaps, blocked_join, pairs, passes, sketches, threshold_join
from sketchloom.plans import workloads
from sketchloom.plans.queries import _D, _DOCS, ORACLES as PLAIN, PAIRS_SQL, SUPPLIERS_SQL, murmur_sql
from sketchloom.sources import index_store, readers, sinks, splits
from sketchloom.sources.staging import new_folder, written

HIGH, LOW = 0.7, 0.05
PASSES = 8


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.sized_members(workloads.document_sketches(spark, sf_dir))


def _presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.presence_matrix(sketches.members(workloads.document_sketches(spark, sf_dir)))


def pair_containment_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents contained in others to seven tenths, by prefixes of rare hashes."""
    return threshold_join.contained(workloads.document_sketches(spark, sf_dir), HIGH)


def prefix_join_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the prefix join reads of what the join of all common hashes would make."""
    return threshold_join.join_rows(workloads.document_sketches(spark, sf_dir), HIGH)


def hot_hash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersections with hashes of many documents, counted by blocks of documents."""
    return blocked_join.blocked_intersections(workloads.document_sketches(spark, sf_dir))


def hot_hash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashes that go by blocks, with the parts that each is dealt to."""
    many = blocked_join.hot_hashes(_sized(spark, sf_dir).select("id", "hash"), hot=16, span=32)
    return many.select("hash", F.call_function("shiftleft", F.lit(1), F.col("bits")).alias("parts"))


def bitmap_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bitmaps.containers(_presence(spark, sf_dir))
    return made.select("id", "chunk", "kind", "n", F.octet_length("data").alias("bytes"))


def bitmap_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the bitmaps by kind of container against lists of ordinals, for the parts that suppliers sell: wide rows of small numbers."""
    return bitmaps.space(bitmaps.containers(sketches.presence_matrix(workloads.supplier_members(spark, sf_dir))))


def bitmap_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard of documents from bitmaps alone."""
    made = written(bitmaps.containers(_presence(spark, sf_dir)), "bitmaps")
    return bitmaps.similar(made).select("i", "j", "intersection", "jaccard")


def block_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The presence matrix of suppliers times itself, by blocks of 32 rows."""
    made = written(bitmaps.containers(sketches.presence_matrix(workloads.supplier_members(spark, sf_dir))), "bitmaps")
    return pairs.intersection_matrix(bitmaps.mirrored(bitmaps.block_product(made, 32)), bitmaps.sizes(made))


def _stored(spark: SparkSession, sf_dir: str) -> str:
    path = new_folder(spark, "stored-index")
    index_store.write_index(_sized(spark, sf_dir), path, buckets=16)
    return path


def stored_index_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs over an index that was stored in buckets and read again."""
    return index_store.block_pairs(index_store.read_index(spark, _stored(spark, sf_dir)), LOW)


def stored_index_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = index_store.read_manifest(spark, _stored(spark, sf_dir))
    return spark.createDataFrame([tuple(m[c] for c in ("hashes", "postings", "max_df", "pairs"))], "n_hashes long, n_postings long, max_df long, n_pairs long")


def pair_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in passes over a stored index, stopped after the first and taken up again."""
    index, path = index_store.read_index(spark, _stored(spark, sf_dir)), new_folder(spark, "passes")
    work = passes.work(index.select("id", "hash"))
    rows = passes.rows_a_pass(work, PASSES)
    passes.run(index, path, LOW, rows, most=1, known=work)
    passes.run(index, path, LOW, rows)
    return passes.read(spark, path)


def pass_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = passes.work(_sized(spark, sf_dir).select("id", "hash"))
    return passes.plan(work, passes.rows_a_pass(work, PASSES))


def _page_file(spark: SparkSession, sf_dir: str) -> str:
    """Pages' addresses as one sequence file, records in order of their ids, lines of at most 30 letters."""
    path = new_folder(spark, "fasta")
    pages = workloads.page_sequences(spark, sf_dir).orderBy("id")
    lines = F.concat(F.lit(">"), F.col("id").cast("string"), F.lit("\n"), F.substring("sequence", 1, 30), F.lit("\n"), F.substring("sequence", 31, 1 << 30))
    pages.select(lines).coalesce(1).write.text(path)
    return path


def fasta_joined_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's records as one sequence, read by splits, its k-mers hashed."""
    chunks, _ = splits.sequence_chunks(spark, _page_file(spark, sf_dir), size=1 << 12)
    hashed = kmers.chunk_hashes(chunks)
    return hashed.select("pos", "kmer", u64.to_text(F.col("h1")).alias("h1"), u64.to_text(F.col("h2")).alias("h2"))


def fasta_record_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record of a file by itself, with its header."""
    chunks, headers = splits.sequence_chunks(spark, _page_file(spark, sf_dir), per_record=True, size=64)
    hashed = kmers.chunk_hashes(chunks).join(headers, ["path", "record"])
    return hashed.select(F.col("header").cast("long").alias("id"), "pos", "kmer", u64.to_text(F.col("h1")).alias("h1"), u64.to_text(F.col("h2")).alias("h2"))


def names_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names written as several files, read back with the ids of their lines."""
    path = new_folder(spark, "names")
    names = workloads.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    sinks.write_names(names.repartitionByRange(4, "id"), path)
    return readers.read_names(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        pair_containment_prefix, prefix_join_rows, hot_hash_pairs, hot_hash_blocks, bitmap_containers, bitmap_space, bitmap_jaccard, block_product,
        stored_index_pairs, stored_index_manifest, pair_passes, pass_plan, fasta_joined_kmers, fasta_record_kmers, names_in_parts,
    )
}

_DF = "df AS (SELECT hash, count(*) AS df FROM m GROUP BY hash)"
_RANKED = f"""{_DF},
f AS (SELECT min(id) AS id FROM (SELECT id, list(hash ORDER BY hash) AS mins FROM m GROUP BY id) GROUP BY mins),
u AS (SELECT m.id, m.hash, count(*) OVER (PARTITION BY m.hash) AS df FROM m JOIN f ON f.id = m.id),
k AS (SELECT u.id, u.hash, size, row_number() OVER (PARTITION BY u.id ORDER BY u.df, u.hash) - 1 AS at FROM u JOIN m_n ON m_n.id = u.id),
q AS (SELECT *, (SELECT min(x) FROM (SELECT unnest(range(greatest(1, ceil(t * size)::BIGINT - 1), ceil(t * size)::BIGINT + 2)) AS x) WHERE x::DOUBLE / size >= t) AS need FROM k, (SELECT {HIGH}::FLOAT::DOUBLE AS t)),
p AS (SELECT a.id AS i, b.id AS j, a.size AS n_i, b.size AS n_j, need, a.at AS at_i, b.at AS at_j FROM q a JOIN k b ON a.hash = b.hash AND a.id <> b.id AND a.at <= a.size - need AND b.size >= need),
c AS (SELECT i, j FROM p GROUP BY i, j, n_i, n_j, need HAVING count(*) + least(n_i - 1 - max(at_i), n_j - 1 - max(at_j)) >= need)"""


def _containers_sql(members: str) -> str:
    """Containers of members m(id, hash): places among all hashes, runs by where a place doesn't follow the one before it."""
    return f"""{members},
o AS (SELECT id, col // 65536 AS chunk, col % 65536 AS place FROM m JOIN (SELECT hash, row_number() OVER (ORDER BY hash::UBIGINT) - 1 AS col FROM (SELECT DISTINCT hash FROM m)) USING (hash)),
r AS (SELECT *, place - lag(place, 1, -2) OVER (PARTITION BY id, chunk ORDER BY place) AS gap FROM o),
s AS (SELECT id, chunk, count(*) AS n, count(*) FILTER (gap <> 1) AS runs FROM r GROUP BY id, chunk),
b AS (SELECT id, chunk, CASE WHEN 4 * runs <= least(2 * n, 8192) THEN 'runs' WHEN 2 * n <= 8192 THEN 'array' ELSE 'bits' END AS kind, n::INTEGER AS n, least(4 * runs, 2 * n, 8192)::INTEGER AS bytes FROM s)"""


_JOINED = "SELECT (p - 1)::BIGINT AS pos, substr(s, p, 21) AS kmer FROM (SELECT s, unnest(range(1, length(s) - 19)) AS p FROM (SELECT string_agg(url, '' ORDER BY page_id) AS s FROM pages))"

ORACLES: dict[str, str] = {
    "pair_containment_prefix": f"{_D} SELECT * FROM s WHERE c_ij >= {HIGH}::FLOAT::DOUBLE",
    "prefix_join_rows": f"{_DOCS}, {_RANKED} SELECT (SELECT sum(df * (df - 1))::BIGINT FROM df) AS all_rows, (SELECT count(*) FROM p) AS prefix_rows, (SELECT count(*) FROM c) AS candidates",
    "hot_hash_pairs": f"{_D} SELECT i, j, intersection FROM x WHERE i < j",
    "hot_hash_blocks": f"{_DOCS}, {_DF} SELECT hash, (1 << greatest(0, ceil(log2(df / 32)))::INTEGER)::INTEGER AS parts FROM df WHERE df > 16",
    "bitmap_containers": f"{_containers_sql(_DOCS)} SELECT * FROM b",
    "bitmap_space": f"{_containers_sql(SUPPLIERS_SQL)} SELECT kind, count(*) AS containers, sum(n)::BIGINT AS places, sum(bytes)::BIGINT AS bytes, 8 * sum(n)::BIGINT AS list_bytes FROM b GROUP BY kind",
    "bitmap_jaccard": f"{_D} SELECT i, j, intersection, jaccard FROM s",
    "block_product": f"{SUPPLIERS_SQL}{PAIRS_SQL} SELECT i, j, intersection AS value FROM x UNION ALL SELECT id, id, size FROM m_n WHERE size > 0",
    "stored_index_pairs": f"{_D} SELECT * FROM s WHERE c_ij >= {LOW}::FLOAT::DOUBLE",
    "stored_index_manifest": f"{_DOCS}, {_DF} SELECT count(*) AS n_hashes, sum(df)::BIGINT AS n_postings, max(df) AS max_df, (sum(df * (df - 1)) // 2)::BIGINT AS n_pairs FROM df WHERE df > 1",
    "pair_passes": f"{_D} SELECT * FROM s WHERE c_ij >= {LOW}::FLOAT::DOUBLE",
    "pass_plan": f"""{_DOCS}, {_DF}, w AS (SELECT id, sum(df)::BIGINT AS rows FROM m JOIN df ON df.hash = m.hash GROUP BY id),
b AS (SELECT id, rows, (sum(rows) OVER (ORDER BY id) - rows) // (SELECT sum(df * df)::BIGINT // {PASSES} + 1 FROM df) AS k FROM w)
SELECT (row_number() OVER (ORDER BY min(id)) - 1)::INTEGER AS part, min(id) AS first, max(id) AS last, sum(rows)::BIGINT AS rows FROM b GROUP BY k""",
    "fasta_joined_kmers": murmur_sql(_JOINED, ["pos", "kmer"]),
    "fasta_record_kmers": PLAIN["kmer_mmh3"],
    "names_in_parts": "SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::INTEGER AS id, c_name AS name FROM customer",
}
