"""Sets of word n-grams by 60 bits of md5, in one Arrow pass over arrays of words."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


SLICE_WORDS = 1 << 17  # words that are Python objects at a time


def _slices(batch: pa.RecordBatch):
    """Rows of a batch in slices of some SLICE_WORDS words, one row at least."""
    counts = pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy()
    before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(before, before[row] + SLICE_WORDS, "right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(row, end - row)
        row = end


def _sets(n: int):
    def run(batches):
        for batch in (piece for whole in batches for piece in _slices(whole)):
            lists = batch.column("words")
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            words = lists.flatten().cast(pa.large_binary())
            ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset + 1 :][: len(words)] if len(words) else np.zeros(0, np.int64)
            base = ends[0] - len(words[0].as_py()) if len(words) else 0
            # with one space between words an n-gram is a stretch of the joined text
            ends = ends - base + np.arange(len(words))
            joined = b" ".join(words.to_pylist())
            starts = np.concatenate([[0], ends[:-1] + 1]) if len(words) else ends
            sets, at = [], 0
            for size in counts.tolist():
                first, last = starts[at : at + size - n + 1].tolist(), ends[at + n - 1 : at + size].tolist()
                grams = dict.fromkeys(joined[a:b] for a, b in zip(first, last))
                sets.append(np.frombuffer(b"".join([md5(g).digest()[:8] for g in grams]), ">u8"))
                at += size
            places = np.cumsum([0, *map(len, sets)])
            values = (np.concatenate(sets) >> np.uint64(4)).astype(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.LargeListArray.from_arrays(pa.array(places, pa.int64()), pa.array(values)).cast(pa.list_(pa.int64()))], names=["id", "mins"])

    return run


def ngram_sets(rows: DataFrame, n: int) -> DataFrame:
    """rows(id, words) -> (id, mins): the distinct hashes of each row's runs of n words, those of the first 15 hexadecimal digits of their md5, words joined by a space; none for fewer words or null."""
    return rows.mapInArrow(_sets(n), f"id {rows.schema['id'].dataType.simpleString()}, mins array<bigint>")
