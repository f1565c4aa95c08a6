"""Canonical length-limited Huffman files of token ids.

Layout of a written file (a folder): `segments`, one row per segment (part, segment, blob), and `codebook`, one row with
the code length of every id. A blob is little-endian and decodes with the codebook alone:

    magic "HTID" | crc32 of the code lengths u32 | first id's place among all ids u64 | documents u32 | ids u32 |
    ids per block u32 | blocks u32 | doc_id i64 each | ids u32 each | bit offset u64 of each block | code bits

Documents are in ascending doc_id order (nulls first) along (part, segment); a segment holds whole documents. Every
block starts at its checkpoint and decodes by a table of 2**MAX_LENGTH entries without any other block.

Code lengths come from the counts of all ids of the corpus by package-merge, at most MAX_LENGTH bits. Only those counts
(one per id of the vocabulary) and one total per partition reach the driver. A null doc_id is written as the smallest
i64 and read back as null. Empty input gives no segments and an empty codebook.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import textscan
from sketchloom.llm.staging import released, shared_root, small_batches, small_table, written
from sketchloom.llm.tokenids import SLICE_BYTES, encoder, vocabulary_path

MAX_LENGTH = 18
BLOCK_IDS = 256
SEGMENT_IDS = 1 << 18
_HEAD = struct.Struct("<4sIQIIII")
_NULL_ID = -(2**63)


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal prefix code lengths of at most `limit` bits for ids with a count above 0 (package-merge); 0 for the others."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts > 0)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("too many ids for this length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        weights = np.concatenate([leaf, packages])
        rank = np.argsort(weights, kind="stable")
        levels.append(rank < len(leaf))
        weights = weights[rank]
        packages = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, depth = 2 * len(leaf) - 2, np.zeros(len(leaf), dtype=np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each one more than the one before it at its length."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    width = lengths[order].astype(np.uint64)
    step = np.uint64(1) << (np.uint64(MAX_LENGTH) - width)
    codes[order] = (np.cumsum(step, dtype=np.uint64) - step) >> (np.uint64(MAX_LENGTH) - width)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every MAX_LENGTH bits, the id whose code they begin with, and its length."""
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    spread = (1 << (MAX_LENGTH - lengths[order].astype(np.int64))).astype(np.int64)
    ids = np.zeros(1 << MAX_LENGTH, dtype=np.uint16)
    ids[: spread.sum()] = np.repeat(order, spread).astype(np.uint16)
    return ids, lengths[ids]


def encode_segment(first: int, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, mark: int) -> bytes:
    width = lengths[ids].astype(np.int64)
    ends = np.cumsum(width)
    at = ends - width
    left = codes[ids] << (np.uint64(64) - width.astype(np.uint64))
    shift = (at & 63).astype(np.uint64)
    word = at >> 6
    bits = np.zeros(int(ends[-1] // 64 + 2) if len(ids) else 1, dtype=np.uint64)
    if len(ids):
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        bits[word[heads]] = np.bitwise_or.reduceat(left >> shift, heads)
        over = np.flatnonzero((at & 63) + width > 64)
        bits[word[over] + 1] |= left[over] << (np.uint64(64) - shift[over])
    marks = at[::BLOCK_IDS].astype("<u8")
    head = _HEAD.pack(b"HTID", mark, first, len(doc_ids), len(ids), BLOCK_IDS, len(marks))
    payload = bits.astype(">u8").tobytes()[: int(ends[-1] + 7) // 8 if len(ids) else 0]
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), marks.tobytes(), payload])


def decode_segment(blob: bytes, table: tuple[np.ndarray, np.ndarray], mark: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first id, doc ids, ids of each document, all ids)."""
    magic, crc, first, docs, n, block, blocks = _HEAD.unpack_from(blob)
    if magic != b"HTID" or crc != mark:
        raise ValueError("not a segment of this codebook")
    p = _HEAD.size
    doc_ids = np.frombuffer(blob, "<i8", docs, p)
    counts = np.frombuffer(blob, "<u4", docs, p + 8 * docs).astype(np.int64)
    marks = np.frombuffer(blob, "<u8", blocks, p + 12 * docs).astype(np.int64)
    raw = np.concatenate([np.frombuffer(blob, np.uint8, -1, p + 12 * docs + 8 * blocks), np.zeros(8, np.uint8)])
    window = np.zeros(len(raw) - 3, dtype=np.uint32)  # the four bytes from each place
    for k in range(4):
        window |= raw[k : len(raw) - 3 + k].astype(np.uint32) << np.uint32(24 - 8 * k)
    ids, width = table
    out = np.zeros((block, max(blocks, 1)), dtype=np.uint16)
    at = marks.copy()
    for k in range(min(block, n)):  # all blocks in step; the last may be shorter
        live = blocks if k < n - (blocks - 1) * block else blocks - 1
        a = at[:live]
        peek = (window[a >> 3] >> (32 - MAX_LENGTH - (a & 7)).astype(np.uint32)) & np.uint32((1 << MAX_LENGTH) - 1)
        out[k, :live] = ids[peek]
        a += width[peek]
    return first, doc_ids, counts, out.T.reshape(-1)[:n]


IDS = "doc_id long, n_ids long, ids binary, counts boolean"


def _tokenize(path: str, end_id: int):
    """A row for each document with its ids, and at the end one with the counts of all ids of the partition, as pairs (id, count)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary()), ("counts", pa.bool_())])

    def run(batches):
        coder, total = encoder(path), np.zeros(65536, dtype=np.int64)
        for batch in batches:
            for piece in textscan.chunks(batch, "text", SLICE_BYTES):
                ids, first = coder.encode(piece.column("text"))
                with_end = np.insert(ids, first[1:], end_id)
                total += np.bincount(with_end, minlength=65536)
                ends = first + np.arange(len(first))
                binary = pa.Array.from_buffers(pa.large_binary(), piece.num_rows, [None, pa.py_buffer((2 * ends).astype(np.int64)), pa.py_buffer(with_end.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(ends)), binary.cast(pa.binary()), pa.array(np.zeros(piece.num_rows, bool))], schema=schema)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"doc_id": [None], "n_ids": [0], "ids": [np.stack([seen, total[seen]], axis=1).astype("<i8").tobytes()], "counts": [True]}, schema)

    return run


def _counted(batches):
    for batch in batches:
        for data in batch.column("ids"):
            seen, n = np.frombuffer(data.as_buffer(), "<i8").reshape(-1, 2).T
            yield pa.RecordBatch.from_pydict({"id": pa.array(seen, pa.int32()), "n": pa.array(n, pa.int64())})


def _segments(batches):
    """Rows of documents in order, joined to segments of about SEGMENT_IDS ids; a longer document makes a segment of its own."""
    from pyspark import TaskContext

    schema = pa.schema([("part", pa.int32()), ("segment", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())])
    part, segment, before, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

    def close():
        nonlocal segment, before, held, size
        doc_ids, lengths, ids = zip(*held)
        row = [part, segment, before, size, np.array(doc_ids, "<i8").tobytes(), np.array(lengths, "<u4").tobytes(), b"".join(ids)]
        segment, before, held, size = segment + 1, before + size, [], 0
        return pa.RecordBatch.from_pydict({f.name: [v] for f, v in zip(schema, row)}, schema)

    for batch in batches:
        for doc_id, n, ids in zip(batch.column("doc_id").fill_null(_NULL_ID).to_pylist(), batch.column("n_ids").to_pylist(), batch.column("ids").to_pylist()):
            if held and size + n > SEGMENT_IDS:
                yield close()
            held.append((doc_id, n, ids))
            size += n
    if held:
        yield close()


def write_token_file(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 2) -> str:
    """Encodes docs(doc_id, text) with end_id after each document and writes the file to `path`; a null text is empty, other columns are not read.

    Texts are encoded where they lie; only their ids are sorted by doc_id (rows with one doc_id by their ids).
    """
    spark = docs.sparkSession
    with small_batches(spark):
        coded = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_tokenize(tokenizer_path or vocabulary_path(), end_id), IDS), "token-documents")
    counts = np.zeros(65536, dtype=np.int64)
    for id_, n in coded.where("counts").select("ids").mapInArrow(_counted, "id int, n long").groupBy("id").agg(F.sum("n")).collect():  # one row per id of the vocabulary
        counts[id_] = n
    lengths = code_lengths(counts)
    mark = zlib.crc32(lengths.tobytes())
    ordered = coded.where("not counts").select("doc_id", "n_ids", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    with small_batches(spark):
        raw = written(ordered.mapInArrow(_segments, "part int, segment long, before long, n_ids long, doc_ids binary, lengths binary, ids binary"), "token-ids")
    released(coded)
    totals = raw.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row per partition of the job
    starts, reach = {}, 0
    for part, n in totals:
        starts[part], reach = reach, reach + n

    def encode(batches):
        codes = canonical_codes(lengths)
        for batch in batches:
            for r in batch.to_pylist():
                blob = encode_segment(starts[r["part"]] + r["before"], np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["lengths"], "<u4"), np.frombuffer(r["ids"], "<u2"), lengths, codes, mark)
                yield pa.RecordBatch.from_pydict({"part": pa.array([r["part"]], pa.int32()), "segment": pa.array([r["segment"]], pa.int64()), "blob": pa.array([blob], pa.binary())})

    with small_batches(spark, 8):
        raw.mapInArrow(encode, "part int, segment long, blob binary").write.option("compression", "none").parquet(f"{path}/segments")
    released(raw)
    small_table(spark, lengths=pa.array([lengths.tobytes()], pa.binary())).coalesce(1).write.parquet(f"{path}/codebook")
    return path


def read_token_file(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, and with with_ids the ids themselves."""
    lengths = np.frombuffer(bytes(spark.read.schema("lengths binary").parquet(f"{path}/codebook").first()[0]), np.uint8)
    mark = zlib.crc32(lengths.tobytes())

    def decode(batches):
        tables = decoding_table(lengths)
        for batch in batches:
            for blob in batch.column("blob"):
                first, doc_ids, counts, ids = decode_segment(memoryview(blob.as_buffer()), tables, mark)
                ends = np.cumsum(counts)
                wide = memoryview(ids.astype("<u4")).cast("B")
                cuts = list(zip((4 * (ends - counts)).tolist(), (4 * ends).tolist()))
                out = {
                    "doc_id": pa.array(doc_ids, pa.int64(), mask=doc_ids == _NULL_ID),
                    "start": pa.array(first + ends - counts, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(wide[a:b]) for a, b in cuts], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([np.frombuffer(wide[a:b], "<u4").astype(np.int32) for a, b in cuts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return spark.read.schema("part int, segment long, blob binary").parquet(f"{path}/segments").select("blob").mapInArrow(decode, schema)


def new_path(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/token-file-{uuid.uuid4().hex}"
