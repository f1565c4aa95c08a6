"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of the words that a mask selects out of SPAN consecutive words. The masks of MASKS together hit every
window of WINDOW aligned words of which at most two differ. Seeds of documents are joined with the benchmark's; each hit
names an item and a diagonal. Around it the document's words are compared with the item's, and the overlap counts where a
window of WINDOW words (the whole item, if shorter) has a share of MIN_EQUAL equal.

Items of fewer than WINDOW words are cut into one run of words more than may differ, so that a run stays whole wherever the
item is admissible; a run's hash is its seed, and the whole item is compared. A one-word item thus overlaps every document
with that word.

A benchmark of at most BLOCK_WORDS words is broadcast with its seeds, sorted, and joined to documents where they lie: one
scan, no shuffle. A larger one stays in tables: seeds of documents that pass a filter of 2**FILTER_BITS bits are joined to
its seeds by a shuffle, and the candidates meet the word hashes of their documents and items in a second one, sorted by
document, so that no list of candidates is held.

Items with a null id take part and are given with it. Null and empty texts overlap nothing. Repeated rows and items give
repeated results; of the overlaps of one row with one item the longest is given, of equally long ones that with more equal
words, then the first. Very long texts are compared whole. Extra columns are not read by find() and kept by drop_leaks().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm import textscan
from sketchloom.llm.staging import own_name, released, unless_large, written
from sketchloom.llm.textscan import mix

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8
WINDOW = 13
MIN_EQUAL = 0.8
BLOCK_WORDS = 1 << 21
BROADCAST_KEYS = 1 << 22
FILTER_BITS = 23
SLICE = 1 << 20  # candidates or words that are compared at once


def runs(n: int) -> list[tuple[int, int]]:
    """(start, words) of the runs of an item of n words of which one is whole where MIN_EQUAL of the item is equal."""
    cuts = n - math.ceil(MIN_EQUAL * n) + 1
    at = [n * k // cuts for k in range(cuts + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def seeds(hashes: np.ndarray, mask: int) -> np.ndarray:
    """The mask's seed at every position, rows not regarded."""
    m = max(0, len(hashes) - SPAN + 1)
    out = np.full(m, mask + 1, dtype=np.uint64)
    for j, offset in enumerate(MASKS[mask]):
        out += hashes[offset : offset + m] * textscan._GRAM[16 * mask + j]
    return mix(out)


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes, the group of each element and its place there."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _slices(sizes: np.ndarray):
    """Runs of elements with about SLICE in sum; a larger one is a run by itself."""
    group = np.cumsum(sizes) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    yield from (slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def compared(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, item_words: np.ndarray, item_first: np.ndarray, size: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, ...]:
    """(candidate, start, words, equal words) of the candidates that overlap: an item's words, from item_first on, laid at `diagonal` on words between lo and hi of a document; starts count from lo."""
    window = np.minimum(WINDOW, size)
    a, b = np.maximum(lo, diagonal), np.minimum(hi, diagonal + size)
    live = np.flatnonzero((b - a >= window) & (size > 0))
    out = [np.zeros((4, 0), np.int64)]
    for some in _slices((b - a)[live]):
        at = live[some]
        n, w = (b - a)[at], window[at]
        owner, k = _ragged(n)
        equal = words[a[at][owner] + k] == item_words[(item_first[at] + a[at] - diagonal[at])[owner] + k]
        sums = np.concatenate([[0], np.cumsum(equal)])
        whole = np.flatnonzero(k <= (n - w)[owner])
        need = np.ceil(MIN_EQUAL * w - 1e-9).astype(np.int64)
        good = whole[sums[whole + w[owner[whole]]] - sums[whole] >= need[owner[whole]]]
        if not len(good):
            continue
        who, first = np.unique(owner[good], return_index=True)
        last = np.append(first[1:], len(good)) - 1
        begin, end = good[first], good[last] + w[who]
        out.append(np.stack([at[who], (a - lo)[at][who] + k[begin], end - begin, sums[end] - sums[begin]]))
    return tuple(np.concatenate(out, axis=1))


def item_seeds(words: np.ndarray, first: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, seed, item, place) of items given by their words' hashes: kind k of mask k, -n of runs of n words."""
    size = np.diff(first)
    item, place = _ragged(size)
    m = max(0, len(words) - SPAN + 1)
    at = np.flatnonzero((place[:m] + SPAN <= size[item[:m]]) & (size[item[:m]] >= WINDOW))
    out = [(k, seeds(words, k)[at], item[at], place[at]) for k in range(len(MASKS))]
    held: dict[int, list[tuple[int, int]]] = {}  # words of a run: items and places
    for i in np.flatnonzero((size > 0) & (size < WINDOW)).tolist():
        for start, n in runs(int(size[i])):
            held.setdefault(n, []).append((i, start))
    for n, places in held.items():
        of, start = np.array(places).T
        out.append((-n, textscan.gram_hashes(words, n)[first[of] + start], of, start))
    return out


def text_seeds(words: np.ndarray, first: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed, row) at every position, runs over the end of a row included; the comparison rules those out."""
    mine = seeds(words, kind) if kind >= 0 else textscan.gram_hashes(words, -kind)
    return mine, np.searchsorted(first, np.arange(len(mine)), side="right") - 1


class Filter:
    """A bit for the upper bits of each seed."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def of(values: np.ndarray) -> Filter:
        bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        bits[values >> np.uint64(64 - FILTER_BITS)] = True
        return Filter(np.packbits(bits, bitorder="little"))

    def places(self, values: np.ndarray) -> np.ndarray:
        cell = values >> np.uint64(64 - FILTER_BITS)
        return np.flatnonzero(self.bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1)


class Index:
    """The seeds of all items, sorted, with a filter for each kind."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        self.words, self.first = textscan.words(*textscan.column_bytes(pa.array([t for _, t in items], pa.string())))
        self.size = np.diff(self.first)
        self.kinds = []
        for kind, seed, item, place in item_seeds(self.words, self.first):
            order = np.argsort(seed, kind="stable")
            if len(seed):
                self.kinds.append((kind, seed[order], item[order], place[order], Filter.of(seed)))

    def _candidates(self, hashes: np.ndarray, first: np.ndarray):
        """(row, item, diagonal) in slices."""
        for kind, seed, item, place, filter_ in self.kinds:
            mine, row = text_seeds(hashes, first, kind)
            at = filter_.places(mine)
            lo, hi = (np.searchsorted(seed, mine[at], side=s) for s in ("left", "right"))
            hit = hi > lo
            at, lo, many = at[hit], lo[hit], (hi - lo)[hit]
            for some in _slices(many):
                who, k = _ragged(many[some])
                pick = lo[some][who] + k
                yield np.unique(np.stack([row[at[some]][who], item[pick], at[some][who] - place[pick]]), axis=1)

    def _found(self, hashes: np.ndarray, first: np.ndarray, passed: np.ndarray | None = None):
        """Rows, items, starts, words and equal words of verified candidates; rows that `passed` marks are left out."""
        for row, item, diagonal in self._candidates(hashes, first):
            if passed is not None:
                row, item, diagonal = (x[~passed[row]] for x in (row, item, diagonal))
            which, start, n, equal = compared(hashes, first[row], first[row + 1], self.words, self.first[item], self.size[item], diagonal)
            yield row[which], item[which], start, n, equal

    def overlaps(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int | None, int, int, int]]:
        """(row, item id, start word in the row, words, equal words) for documents given by their words' hashes."""
        parts = [x for x in self._found(hashes, first)]
        if not parts:
            return []
        row, item, start, n, equal = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((start, -equal, -n, item, row))
        order = order[np.flatnonzero((np.diff(row[order], prepend=-1) != 0) | (np.diff(item[order], prepend=-1) != 0))]
        return [(r, self.ids[i], a, b, c) for r, i, a, b, c in zip(*(x[order].tolist() for x in (row, item, start, n, equal)))]

    def leaks(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which documents overlap any item."""
        passed = np.zeros(len(first) - 1, dtype=bool)
        for row, *_ in self._found(hashes, first, passed):
            passed[row] = True
        return passed


def _index(benchmark: DataFrame):
    """A function that gives the index in a task; of a benchmark of at most BLOCK_WORDS words."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).collect()
    held = benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])
    cache: list[Index] = []

    def get() -> Index:
        if not cache:
            cache.append(Index(held.value))
        return cache[0]

    return get


def _fits(benchmark: DataFrame) -> bool:
    # a text has at most half as many words as characters, and a word more
    return (benchmark.agg(F.coalesce(F.sum(F.length(F.col("text").cast("string")) / 2 + 1), F.lit(0))).first()[0] or 0) <= BLOCK_WORDS


def _item_tables(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, item_id, item_words) of the items, (kind, seed, key, place) of their seeds."""
    items = written(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")), "leak-texts").withColumn("key", F.monotonically_increasing_id())
    items = written(items.mapInArrow(_words_of(("key", "item_id")), "key long, item_id long, words binary"), "leak-items")

    def run(batches):
        for batch in batches:
            raw = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column("words")]
            first = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
            for kind, seed, item, place in item_seeds(np.concatenate(raw) if raw else np.zeros(0, np.uint64), first):
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(seed), kind, np.int32)), "seed": pa.array(seed.view(np.int64)), "key": batch.column("key").take(pa.array(item)), "place": pa.array(place.astype(np.int64))})

    return items, written(items.select("key", "words").mapInArrow(run, "kind int, seed long, key long, place long"), "leak-seeds")


def _words_of(columns: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            for piece in textscan.chunks(batch, "text"):
                words, first = textscan.words(*textscan.column_bytes(piece.column("text")))
                cuts = (8 * first).tolist()
                raw = memoryview(np.ascontiguousarray(words)).cast("B")
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in columns), pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())], names=[*columns, "words"])

    return run


def _joined(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_key, text) with distinct keys -> doc_key, item_key, item_id, start_word, n_words, n_equal of the longest overlap with each item, through tables alone."""
    spark = docs.sparkSession
    items, item_rows = _item_tables(benchmark)
    kinds = [r[0] for r in item_rows.select("kind").distinct().collect()]  # at most a kind for each mask and length of run
    cell = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    bits[[r[0] for r in item_rows.select(cell).distinct().collect()]] = True  # at most 2**FILTER_BITS rows
    filter_ = spark.sparkContext.broadcast(Filter(np.packbits(bits, bitorder="little")))

    def hits(batches):
        for batch in batches:
            for piece in textscan.chunks(batch, "text"):
                hashes, first = textscan.words(*textscan.column_bytes(piece.column("text")))
                for kind in kinds:
                    mine, row = text_seeds(hashes, first, kind)
                    at = filter_.value.places(mine)
                    yield pa.RecordBatch.from_pydict({"doc_kind": pa.array(np.full(len(at), kind, np.int32)), "doc_seed": pa.array(mine[at].view(np.int64)), "doc_key": piece.column("doc_key").take(pa.array(row[at])), "at": pa.array(at - first[row[at]])})

    found = docs.mapInArrow(hits, "doc_kind int, doc_seed long, doc_key long, at long")
    found = found.join(item_rows, (found.doc_seed == item_rows.seed) & (found.doc_kind == item_rows.kind))
    found = written(found.select("doc_key", "key", (F.col("at") - F.col("place")).alias("diagonal")).distinct(), "leak-candidates")
    texts = docs.join(unless_large(written(found.select(F.col("doc_key").alias("k")).distinct(), "leak-keys"), BROADCAST_KEYS), F.col("doc_key") == F.col("k"), "left_semi")
    texts = texts.mapInArrow(_words_of(("doc_key",)), "doc_key long, words binary")
    nothing = lambda *names: [F.lit(None).cast(t).alias(x) for x, t in names]
    both = texts.select("doc_key", F.lit(-1).cast("long").alias("key"), *nothing(("item_id", "long"), ("diagonal", "long")), "words")
    both = both.unionByName(found.join(items, "key").select("doc_key", "key", "item_id", "diagonal", "words"))

    def verify(batches):
        document, now = np.zeros(0, np.uint64), None
        for batch in batches:
            out = []
            for doc, key, item_id, diagonal, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_key", "key", "item_id", "diagonal", "words"))):
                words = np.frombuffer(raw, "<u8")
                if key < 0:
                    document, now = words, doc
                elif doc == now:
                    one = lambda x: np.array([x], np.int64)
                    out += [(doc, key, item_id, *x) for x in zip(*(x.tolist() for x in compared(document, one(0), one(len(document)), words, one(0), one(len(words)), one(diagonal))[1:]))]
            names = ("doc_key", "key", "item_id", "start_word", "n_words", "n_equal")
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(len(names))], names=list(names))

    shape = "doc_key long, key long, item_id long, start_word long, n_words long, n_equal long"
    out = both.repartition("doc_key").sortWithinPartitions("doc_key", "key").mapInArrow(verify, shape)
    best = out.groupBy("doc_key", "key").agg(F.max(F.struct("n_words", "n_equal", (-F.col("start_word")).alias("back"), "item_id")).alias("b"))
    best = written(best.select("doc_key", "key", "b.item_id", (-F.col("b.back")).alias("start_word"), "b.n_words", "b.n_equal"), "leak-overlaps")
    released(items, item_rows, found)
    return best


_KEY = "xxhash64(doc_id is null, doc_id, text)"  # of a row; equal rows have equal results


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, start_word, n_words, n_equal of every overlap."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if not _fits(benchmark):
        keyed = rows.withColumn("doc_key", F.expr(_KEY))
        counted = keyed.groupBy("doc_key").agg(F.first("doc_id").alias("doc_id"), F.count("*").cast("int").alias("rows"))
        found = _joined(keyed.select("doc_key", "text").dropDuplicates(["doc_key"]), benchmark).join(counted, "doc_key")
        return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows")))).select("doc_id", "item_id", "start_word", "n_words", "n_equal")
    index = _index(benchmark)

    def run(batches):
        for batch in batches:
            for piece in textscan.chunks(batch, "text"):
                found = index().overlaps(*textscan.words(*textscan.column_bytes(piece.column("text"))))
                row, *rest = (list(x) for x in zip(*found)) if found else [[]] * 5
                columns = [piece.column("doc_id").take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in rest]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "start_word", "n_words", "n_equal"])

    return rows.mapInArrow(run, "doc_id long, item_id long, start_word long, n_words long, n_equal long")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text overlaps an item; all columns stay."""
    if not _fits(benchmark):
        keyed = docs.select(F.expr(_KEY).alias("doc_key"), F.col("text").cast("string").alias("text")).dropDuplicates(["doc_key"])
        leak = own_name("leak")
        leaks = written(_joined(keyed, benchmark).select(F.col("doc_key").alias(leak)).distinct(), "leak-keys")
        return docs.join(unless_large(leaks, BROADCAST_KEYS), F.expr(_KEY) == F.col(leak), "left_anti")
    index = _index(benchmark)

    def run(batches):
        for batch in batches:
            for piece in textscan.chunks(batch, "text"):
                yield piece.filter(pa.array(~index().leaks(*textscan.words(*textscan.column_bytes(piece.column("text"))))))

    return docs.mapInArrow(run, docs.schema)
