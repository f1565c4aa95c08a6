"""Vectorised scans over the UTF-8 bytes of Arrow string columns: words, their 64-bit hashes and n-gram hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z count as a-z. A hash is a polynomial over the
bytes modulo 2**64 with random byte values, mixed afterwards; equal words have equal hashes in every task, and two
different words of a corpus collide with a chance of about 2**-64 each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_GRAM = _RNG.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 2**64)
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        p = np.full(max(n, CHUNK_BYTES), _STEP if kind == "up" else _BACK, dtype=np.uint64)
        p[0] = 1
        _powers[kind] = np.cumprod(p, dtype=np.uint64)
    return _powers[kind][:n]


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row's begin (one more for the end); null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES):
    """Slices of a batch with about `size` text bytes each; a longer row makes a slice of its own. What Arrow holds of earlier batches goes back to the system."""
    pa.default_memory_pool().release_unused()
    lengths = np.diff(column_bytes(batch.column(column))[1])
    group = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(lengths)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _LOWER) -> np.ndarray:
    """Hashes of the byte spans [starts, ends)."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * _power("up", len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and the first word of each row (one more for the end)."""
    ink = ~_SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty(len(ink), dtype=bool)
    before[0], before[1:] = False, ink[:-1]
    after = np.empty(len(ink), dtype=bool)
    after[-1], after[:-1] = False, ink[1:]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    after[cuts[cuts > 0] - 1] = False
    starts, ends = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in order, and the first word of each row (one more for the end)."""
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of n consecutive words, rows not regarded."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        out += hashes[j : j + m] * _GRAM[j]
    return mix(out)


def shingle_sets(col: pa.Array, n: int) -> list[np.ndarray]:
    """Per row, the sorted distinct hashes of its runs of n words; a row with fewer words has the whole sequence as one, a row without any none."""
    data, offsets = column_bytes(col)
    hashes, first = words(data, offsets)
    grams = gram_hashes(hashes, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            keep = np.empty(len(g), dtype=bool)
            keep[0] = True
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            out.append(g[keep])
        elif b > a:
            out.append(mix((hashes[a:b] * _GRAM[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
