"""Token ids of whole texts by the tokenizers library, with each distinct stretch of text encoded once per task.

A byte-level BPE splits a text by a pattern before it merges. No part of that split spans the place before a single
space that stands between two characters other than white space, or before punctuation after an ASCII letter or digit.
So a text is cut there, and the ids of a text are those of its stretches joined. Added tokens of the vocabulary are matched before that split, so a text with the content of
one of them is encoded whole. A task keeps the ids of the stretches it has met, at most CACHE_STRETCHES of them; beyond,
those met in several slices stay.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from sketchloom.llm import textscan

CACHE_STRETCHES = 1_000_000
JOINED = 64  # stretches encoded as one text
SLICE_BYTES = 1 << 18  # of text that is encoded at once
_THREE = np.zeros(256, dtype=bool)
_THREE[[0xE1, 0xE2, 0xE3]] = True  # first bytes of all white space outside ASCII and Latin-1
_LATIN = np.zeros(256, dtype=bool)
_LATIN[[0x85, 0xA0]] = True

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[[ord(c) for c in "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"]] = True


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Table:
    """Stretches by hash, sorted: where their ids lie in the pool, how many, and in how many slices they were met."""

    def __init__(self, *columns: np.ndarray):
        self.known, self.at, self.count, self.met = columns or (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there)"""
        place = np.searchsorted(self.known, hashes)
        if not len(self.known):
            return place, np.zeros(len(hashes), dtype=bool)
        return place, self.known[np.minimum(place, len(self.known) - 1)] == hashes

    def joined(self, other: _Table) -> _Table:
        order = np.argsort(np.concatenate([self.known, other.known]), kind="stable")
        return _Table(*(np.concatenate([a, b])[order] for a, b in zip(self.columns(), other.columns())))

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.known, self.at, self.count, self.met


class IdEncoder:
    """Encodes Arrow string columns; ids below 65536 are needed."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        if max(vocabulary.values()) >= 65536:
            raise ValueError("ids must fit 16 bits")
        self.width = np.zeros(65536, dtype=np.int64)  # bytes of each id: a byte-level vocabulary writes one character a byte
        for text, i in vocabulary.items():
            self.width[i] = len(text)
        self.old, self.new = _Table(), _Table()  # new stretches join the old ones when they are an eighth of them
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (uint16), and where each row's begin (one more for the end)."""
        data, offsets = textscan.column_bytes(col)
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        if any(token in raw for token in self.added):
            return self._with_added(raw, offsets)
        starts = self._cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = textscan.span_hashes(data, starts, ends, textscan._BYTE)
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at, counts = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        missing = np.ones(len(unique), dtype=bool)
        for table in (self.old, self.new):
            rest = np.flatnonzero(missing)
            place, hit = table.find(unique[rest])
            rest, place = rest[hit], place[hit]
            at[rest], counts[rest], missing[rest] = table.at[place], table.count[place], False
            table.met[place] += 1
        if missing.any():
            at[missing], counts[missing] = self._learn(data, raw, unique[missing], starts[where[missing]], ends[where[missing]])
        at, counts = at[inverse], counts[inverse]
        before = np.concatenate([[0], np.cumsum(counts)])
        ids = self.pool[np.repeat(at - before[:-1], counts) + np.arange(before[-1])]
        self._keep_bounds()
        return ids, before[np.searchsorted(starts, offsets)]

    def _with_added(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows one by one, whole where they hold an added token."""
        out = []
        for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
            text = raw[a:b]
            if any(token in text for token in self.added):
                out.append(np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype=np.uint16))
            else:
                out.append(self.encode(pa.array([text.decode()]))[0])
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])

    def _keep_bounds(self) -> None:
        if 8 * len(self.new.known) >= len(self.old.known) or len(self.new.known) > CACHE_STRETCHES // 8:
            self.old, self.new = self.old.joined(self.new), _Table()
        if len(self.old.known) <= CACHE_STRETCHES:
            return
        keep = np.zeros(len(self.old.known), dtype=bool)
        keep[np.argpartition(-self.old.met, CACHE_STRETCHES // 2)[: CACHE_STRETCHES // 2]] = True
        known, at, count, met = (x[keep] for x in self.old.columns())
        stops = np.cumsum(count, dtype=np.int64)
        self.pool = self.pool[np.repeat(at - (stops - count), count) + np.arange(stops[-1])]
        self.old, self.used = _Table(known, stops - count, count, met // 2), len(self.pool)

    @staticmethod
    def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        space = np.flatnonzero(data == 0x20)
        space = space[(space > 2) & (space < len(data) - 1)]
        prev, nxt = data[space - 1], data[space + 1]
        ok = (prev > 0x20) & (nxt > 0x20) & ~_THREE[nxt] & (nxt != 0xC2) & ~_THREE[data[space - 3]] & ~((data[space - 2] == 0xC2) & _LATIN[prev])
        alnum = _ALNUM[data]
        inner = np.flatnonzero(alnum[:-1] & _POINT[data[1:]]) + 1
        cuts, last = np.concatenate([space[ok], inner]), np.concatenate([space[ok] + 1, inner])
        rows = offsets[:-1][np.diff(offsets) > 0]
        ends = offsets[1:][np.diff(offsets) > 0]
        row = np.searchsorted(rows, cuts, side="right") - 1
        inside = (cuts > rows[row]) & (last < ends[row])  # the neighbours are of the same row
        return np.sort(np.concatenate([rows, cuts[inside]]))

    def _learn(self, data: np.ndarray, raw: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes stretches, given by ascending hashes; (place in the pool, number of ids) of each."""
        joins = (ends - starts > 3) & (data[starts] == 0x20) & (data[np.minimum(starts + 1, len(data) - 1)] > 0x20) & (data[ends - 1] > 0x20)
        joins &= ~_THREE[data[np.maximum(ends - 3, 0)]] & ~((data[np.maximum(ends - 2, 0)] == 0xC2) & _LATIN[data[ends - 1]]) & ~_THREE[data[np.minimum(starts + 1, len(data) - 1)]]
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        n = int(joins.sum())
        pieces = [raw[a:b] for a, b in zip(starts[order].tolist(), ends[order].tolist())]
        texts = [b"".join(pieces[k : min(k + JOINED, n)]).decode() for k in range(0, n, JOINED)] + [p.decode() for p in pieces[n:]]
        ids = np.concatenate([np.array(e.ids, dtype=np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        reach = np.cumsum(self.width[ids])
        stops = np.cumsum((ends - starts)[order])
        last = np.searchsorted(reach, stops)
        if not np.array_equal(reach[last], stops):
            raise ValueError("a token spans a cut")
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool) // 2, len(ids)), np.uint16)])
        self.pool[self.used : self.used + len(ids)] = ids
        at, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int32)
        at[order] = self.used + np.concatenate([[0], last[:-1] + 1])
        count[order] = np.diff(last + 1, prepend=0)
        self.used += len(ids)
        self.new = self.new.joined(_Table(hashes, at, count, np.ones(len(hashes), np.int32)))
        return at, count


_encoders: dict[str, IdEncoder] = {}


def encoder(path: str) -> IdEncoder:
    """One per task process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = IdEncoder(path)
    return _encoders[path]
