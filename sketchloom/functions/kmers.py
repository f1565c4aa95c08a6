"""k-mer windows of byte sequences and their MurmurHash3 x64 128 values.

Spark has no such hash and its integer arithmetic raises on overflow, so both come from one Arrow pass over byte buffers:
a sequence is first cut into chunks that overlap by k-1 bytes, which are dealt to tasks, and each chunk's windows are
hashed together as a matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
ROWS = 1 << 17
# The multipliers and additions of the published hash.
C1, C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
ADD1, ADD2 = np.uint64(0x52DCE729), np.uint64(0x38495AB5)
FINAL1, FINAL2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def _final(x: np.ndarray) -> np.ndarray:
    for factor in (FINAL1, FINAL2):
        x = (x ^ x >> np.uint64(33)) * factor
    return x ^ x >> np.uint64(33)


def murmur3_x64_128(keys: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(h1, h2) of every row of a matrix of bytes, as uint64."""
    rows, length = keys.shape
    padded = np.zeros((rows, -(-max(length, 1) // 16) * 16), dtype=np.uint8)
    padded[:, :length] = keys
    lanes = padded.view("<u8")
    h1 = np.full(rows, seed, dtype=np.uint64)
    h2 = h1.copy()
    for b in range(length // 16):
        h1 ^= _turn(lanes[:, 2 * b] * C1, 31) * C2
        h1 = (_turn(h1, 27) + h2) * np.uint64(5) + ADD1
        h2 ^= _turn(lanes[:, 2 * b + 1] * C2, 33) * C1
        h2 = (_turn(h2, 31) + h1) * np.uint64(5) + ADD2
    left = length % 16
    if left > 8:
        h2 ^= _turn(lanes[:, -1] * C2, 33) * C1
    if left:
        h1 ^= _turn(lanes[:, -2] * C1, 31) * C2
    h1 ^= np.uint64(length)
    h2 ^= np.uint64(length)
    h1 = h1 + h2
    h2 = h2 + h1
    h1, h2 = _final(h1), _final(h2)
    h1 = h1 + h2
    return h1, h2 + h1


def _chunks(k: int, size: int):
    schema = pa.schema([("id", pa.int64()), ("at", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        for batch in batches:
            for i, sequence in zip(batch.column("id").to_pylist(), batch.column("sequence").to_pylist()):
                raw = (sequence or "").encode()
                for at in range(0, max(0, len(raw) - k + 1), size):
                    yield pa.RecordBatch.from_pydict({"id": [i], "at": [at], "bytes": [raw[at : at + size + k - 1]]}, schema)

    return run


def _windows(k: int, seed: int, keys: tuple[tuple[str, pa.DataType], ...] = (("id", pa.int64()),)):
    def run(batches):
        for batch in batches:
            for *key, at, raw in zip(*(batch.column(c).to_pylist() for c in (*(name for name, _ in keys), "at", "bytes"))):
                windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), k) if len(raw) >= k else ()
                for a in range(0, len(windows), ROWS):
                    block = np.ascontiguousarray(windows[a : a + ROWS])
                    h1, h2 = murmur3_x64_128(block, seed)
                    yield pa.RecordBatch.from_pydict(
                        {name: pa.repeat(pa.scalar(value, kind), len(block)) for (name, kind), value in zip(keys, key)}
                        | {
                            "pos": pa.array(np.arange(at + a, at + a + len(block))),
                            "kmer": pa.FixedSizeBinaryArray.from_buffers(pa.binary(k), len(block), [None, pa.py_buffer(block.tobytes())]).cast(pa.binary()),
                            "h1": pa.array(h1.view(np.int64)),
                            "h2": pa.array(h2.view(np.int64)),
                        }
                    )

    return run


def chunk_hashes(chunks: DataFrame, k: int = 21, seed: int = 0) -> DataFrame:
    """chunks(path, record, at, bytes), each with the k - 1 bytes after it -> path, record, pos, kmer, h1, h2 of the windows that begin in them."""
    keys = (("path", pa.string()), ("record", pa.int64()))
    out = chunks.mapInArrow(_windows(k, seed, keys), "path string, record long, pos long, kmer binary, h1 long, h2 long")
    return out.withColumn("kmer", F.col("kmer").cast("string"))


def kmer_hashes(sequences: DataFrame, k: int = 21, seed: int = 0) -> DataFrame:
    """sequences(id, sequence) -> id, pos (0-based byte), kmer, h1, h2 (bit patterns); sequences shorter than k have none.

    Case matters, strands aren't merged and no letter is filtered. Windows are of bytes.
    """
    rows = sequences.select(F.col("id").cast("long"), F.col("sequence").cast("string"))
    chunks = rows.mapInArrow(_chunks(k, CHUNK_BYTES), "id long, at long, bytes binary").repartition("id", "at")
    out = chunks.mapInArrow(_windows(k, seed), "id long, pos long, kmer binary, h1 long, h2 long")
    return out.withColumn("kmer", F.col("kmer").cast("string"))


def kmer_windows(sequences: DataFrame, k: int = 21) -> DataFrame:
    """The same windows without hashes, by expressions alone; for short sequences, since a substring is searched from the start."""
    n = F.length("sequence") - k + 1
    at = F.explode(F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))
    rows = sequences.select("id", "sequence", at.alias("p"))
    return rows.select("id", (F.col("p") - 1).cast("long").alias("pos"), F.col("sequence").substr(F.col("p"), F.lit(k)).alias("kmer"))
