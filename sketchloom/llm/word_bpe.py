"""BPE encoding and decoding through a table of the distinct words.

A word-level BPE splits a text into words before it merges, and a word's ids don't depend on what stands around it. So
tasks split texts into words and keep, per block of documents, the block's distinct words and the sequence of their
places in that list. Spark brings equal words of all blocks together, in buckets by a hash of the word: the task of a
bucket keeps the table of its distinct words, encodes each once, and sends the ids back to the blocks' words, where they
are put at the words' positions. Ids are decoded by a join with the vocabulary's pieces, an array by id that every task has.
Only the distinct words of blocks are shuffled, as lists by block and bucket, never their occurrences: blocks are stored in
buckets, and their words' ids come to where they lie.

Texts are split by the library's own rules: its normalizer and its pattern. Where a text holds only characters on which
Python and the library agree, the same pattern runs in Python, which is faster. Null texts and texts of white space have
no ids and decode to the empty text; a null doc_id stays null; repeated rows give a row each; an empty table gives no
rows; other columns are not read. A long text is split in slices cut at white space, which no word spans.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm import textscan
from sketchloom.llm.staging import bucketed, small_batches
from sketchloom.llm.tokenids import vocabulary_path

BLOCK_CHARS = 1 << 23
BUCKET_WORDS = 1 << 18  # of all blocks' words in one bucket, up to MOST_BUCKETS of them
MOST_BUCKETS = 8192
TABLE_WORDS = 1 << 21  # a bucket's table is begun anew beyond
SLICE_CHARS = 1 << 20
_CUT = re.compile(r"[ \t\n\r](?=[!-~])")
#: Characters beyond those that Python's lower() and classes treat as the library does; NFC leaves the rest as they are.
_OTHER = re.compile("[^\t-\r -\x84\x86-įı-ɏ‐-‧€]")


class _Places(dict):
    """Words by the place at which they were met first."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


class Splitter:
    """Splits texts into the words that the tokenizer of a file encodes one by one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        kinds = [s.get("type") for s in (spec["normalizer"] or {}).get("normalizers", [])]
        known = kinds == ["NFC", "Replace", "Lowercase"] and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
        if not known or steps[1]["add_prefix_space"] or steps[1]["use_regex"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{path} is no vocabulary of lower-cased words without a decoder")
        pattern = steps[0]["pattern"]["Regex"]
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.fast = regex.compile(pattern).findall
        added = [t["content"] for t in spec["added_tokens"] if not t["normalized"]]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in what stands around them")
        self.added = re.compile("(" + "|".join(re.escape(a) for a in sorted(added, key=len, reverse=True)) + ")") if added else None
        # words are normalized already: a second time could change marks that lower-casing left
        self.tokenizer = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "truncation": None, "padding": None}))

    def words(self, text: str):
        """Lists of the words of a text in order; an added token is a word."""
        segments = self.added.split(text) if self.added and "<" in text else [text]
        for k, segment in enumerate(segments):
            if k % 2:
                yield [segment]
                continue
            at = 0
            while at < len(segment):
                cut = _CUT.search(segment, at + SLICE_CHARS) if len(segment) - at > SLICE_CHARS else None
                end = cut.end() if cut else len(segment)
                yield self._slice(segment[at:end])
                at = end

    def _slice(self, text: str) -> list[str]:
        if _OTHER.search(text) is None:
            return self.fast(text.lower())
        return [w for w, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    @functools.cached_property
    def pieces(self) -> pa.Array:
        """The vocabulary's pieces by id."""
        known = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        return pa.array([known.get(i) for i in range(max(known) + 1)], pa.string())


_splitters: dict[str, Splitter] = {}


def splitter(path: str) -> Splitter:
    """One per task process and vocabulary."""
    if path not in _splitters:
        _splitters[path] = Splitter(path)
    return _splitters[path]


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32 as compressed planes of bytes: most are small."""
    planes = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


BLOCKS = "block long, doc_ids array<long>, ends array<long>, places binary, words array<string>"
LISTS = "block long, bucket int, steps binary, words binary"
CODED = "block long, steps binary, counts binary, ids binary"


def _blocks(path: str):
    """Documents to blocks: their ids, where each one's words end, and all words as places in the block's list of distinct words."""
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("places", pa.binary()), ("words", pa.list_(pa.string()))])

    def run(batches):
        from pyspark import TaskContext

        split, part, made = splitter(path), TaskContext.get().partitionId() << 32, 0
        doc_ids, ends, places, index, size = [], [], array("I"), _Places(), 0

        def block():
            met = np.array(places, np.int64)
            order = np.argsort(-np.bincount(met, minlength=len(index)), kind="stable")  # frequent words get small places
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            words = pa.array(list(index), pa.string()).take(pa.array(order))
            columns = [[part + made], [doc_ids], [ends], [squeezed(rank[met])], [words]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                if doc_ids and size + len(text) > BLOCK_CHARS:
                    yield block()
                    made += 1
                    doc_ids, ends, places, index, size = [], [], array("I"), _Places(), 0
                for words in split.words(text):
                    places.extend(map(index.__getitem__, words))
                doc_ids.append(doc_id)
                ends.append(len(places))
                size += len(text)
        if doc_ids:
            yield block()

    return run


def _listed(buckets: int):
    """A block's words as a list for each bucket, with the steps from place to place."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("steps", pa.binary()), ("words", pa.binary())])

    def run(batches):
        for batch in batches:
            for block, words in zip(batch.column("block").to_pylist(), batch.column("words")):
                words = words.values
                data, offsets = textscan.column_bytes(words)
                bucket = (textscan.span_hashes(data, offsets[:-1], offsets[1:], textscan._BYTE) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    of = order[cuts[k] : cuts[k + 1]]
                    text = "\n".join(words.take(pa.array(of)).to_pylist()).encode()  # no word has white space
                    packed = len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([k], pa.int32()), pa.array([squeezed(np.diff(of, prepend=0))]), pa.array([packed])], schema=schema)

    return run


def _encoded(path: str):
    """Lists of words in order of buckets to their ids: the table of a bucket's words has each word's ids."""

    def run(batches):
        split = splitter(path)
        bucket, table = None, {}
        for batch in batches:
            for block, now, steps, words in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "steps", "words"))):
                if now != bucket or len(table) > TABLE_WORDS:
                    bucket, table = now, {}
                words = pa.decompress(words[8:], int.from_bytes(words[:8], "little"), codec="zstd", asbytes=True).decode().split("\n")
                fresh = [w for w in words if w not in table]  # a list has a word once
                table.update(zip(fresh, split.ids(fresh)))
                ids = [table[w] for w in words]
                counts = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(counts.sum()))
                yield pa.RecordBatch.from_pydict({"block": pa.array([block]), "steps": pa.array([steps]), "counts": pa.array([squeezed(counts)]), "ids": pa.array([squeezed(flat)])})

    return run


def _texts(path: str):
    """One block's documents: the ids and pieces of its words put where the words stand."""

    def run(blocks: pa.Table, words: pa.Table) -> pa.Table:
        lists = [tuple(unsqueezed(x) for x in row) for row in zip(*(words.column(c).to_pylist() for c in ("steps", "counts", "ids")))]
        lists = [(np.cumsum(steps), size, ids) for steps, size, ids in lists]
        n = sum(len(places) for places, _, _ in lists)
        counts, first = np.zeros(n, np.int64), np.zeros(n, np.int64)
        flat = np.concatenate([ids for _, _, ids in lists]) if lists else np.zeros(0, np.int64)
        before = 0
        for places, size, ids in lists:
            counts[places], first[places] = size, before + np.cumsum(size) - size
            before += len(ids)
        own = flat[np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(len(flat))]  # in order of places
        pieces = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts))), splitter(path).pieces.take(pa.array(own)))
        decoded = np.array(pc.binary_join(pieces, " ").to_pylist(), dtype=object)
        out = [_NOTHING]
        for doc_ids, ends, raw in zip(*(blocks.column(c).to_pylist() for c in ("doc_ids", "ends", "places"))):
            places, ends = unsqueezed(raw), np.concatenate([[0], ends]).astype(np.int64)
            for a in range(0, len(doc_ids), 256):
                cuts = ends[a : a + 257]
                here = places[cuts[0] : cuts[-1]]
                size = counts[here]
                reach = np.concatenate([[0], np.cumsum(size)])
                ids = flat[np.repeat(first[here] - reach[:-1], size) + np.arange(reach[-1])]
                cuts = cuts - cuts[0]
                texts = [" ".join(decoded[here[x:y]]) for x, y in zip(cuts, cuts[1:])]
                arrays = pa.LargeListArray.from_arrays(pa.array(reach[cuts]), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32()))
                out.append(pa.table({"doc_id": pa.array(doc_ids[a : a + 256], pa.int64()), "ids": arrays, "decoded": pa.array(texts, pa.string())}))
        return pa.concat_tables(out)

    return run


_NOTHING = pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32())), "decoded": pa.array([], pa.string())})


def encode(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids (without special tokens), decoded (what those ids decode to, special tokens kept)."""
    path = tokenizer_path or vocabulary_path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with small_batches(docs.sparkSession):  # the blocks' texts, the larger part, are not shuffled: ids come to where they lie
        blocks = bucketed(rows.mapInArrow(_blocks(path), BLOCKS), "word-blocks", "block", max(8, min(MOST_BUCKETS, 2 * rows.rdd.getNumPartitions())))
    words = blocks.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    buckets = min(MOST_BUCKETS, -(-words // BUCKET_WORDS)) or 1
    lists = blocks.select("block", "words").mapInArrow(_listed(buckets), LISTS)
    coded = lists.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_encoded(path), CODED)
    texts = blocks.select("block", "doc_ids", "ends", "places")
    return texts.groupBy("block").cogroup(coded.withColumnRenamed("block", "of").groupBy("of")).applyInArrow(_texts(path), "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """encode()'s rows -> doc_id, n_tokens, and SHA-256 of the ids as text and of the decoded text."""
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
