"""A hidden Markov language model over the words of a corpus.

Tokens are lower-cased words and one end a document, by 64-bit hash. The `own` words that are counted most are symbols of
the model; the others share `tail` symbols by their hash, and within a tail symbol every word has a distribution of its own
in each state. Start, transition and symbol emissions are sent to tasks; what is kept of single words (counts of all words,
expected counts by state of all tail words) is a table that grows with the corpus and is joined to the words of each
partition.

Training: in each of `rounds` rounds every partition runs Baum-Welch's expectation over the whole of its training documents
and its expected counts are added up across partitions in blocks of symbols; the last round also adds up those of tail words.
An emission in a state is its expected count, half a count for each word and for an unknown one in proportion to the state's
share of all tokens, and PRIOR tokens like the whole corpus. A tail word's share of its symbol in a state goes by its count
plus a half, times its share of expected counts in the state, drawn towards the symbol's by DRAW tokens (words counted fewer
than LEAST times have the symbol's); so probabilities of known words and one unknown word a symbol add up to 1. Documents are cut into chunks only to compute in step: products of
transition and emission matrices carry the forward and backward messages over chunk bounds, so expectations and likelihoods
are those of whole documents. Likelihoods are scaled forward recursions.

There is a tail symbol for TAIL_WORDS words, up to TAIL. The driver sees symbols' counts and expected counts (states x symbols), the `own` most counted words and a filter of
2**FILTER_BITS bits for words counted LEAST times or more, all of fixed size.

A null or empty text is one end. Without training documents nothing is known. Repeated rows are scored one by one, null
doc_ids count as empty ones in the split, very long texts are scored whole, and extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm import textscan
from sketchloom.llm.staging import released, small_batches, small_table, written

STATES = 4
ROUNDS = 4
OWN = 49_152
TAIL = 4_096  # a power of two, as all numbers of tail symbols
TAIL_WORDS = 16  # words that a tail symbol has, until there are TAIL symbols
CHUNK = 96
BATCH_TOKENS = 1 << 19
BLOCK = 4_096
END = np.uint64(0x5EED0E4D0C0DE001)
PRIOR = 20.0
DRAW = 2.0
LEAST = 4
FILTER_BITS = 24
HELD_WORDS = 1_000_000
BUCKET_WORDS = 1 << 15
SALTS = 64


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every token, ends included, and each row's first (one more for the end)."""
    hashes, first = textscan.words(*textscan.column_bytes(col))
    return np.insert(hashes, first[1:], END), first + np.arange(len(first))


def _count_words(batches):
    def merged(parts):
        words, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(words)
        words, n = words[order], n[order]
        first = np.flatnonzero(np.diff(words, prepend=words[:1] - np.uint64(1)))
        return words[first], np.add.reduceat(n, first)

    def rows(words, n):
        for k in range(0, len(words), 1 << 17):
            yield pa.RecordBatch.from_pydict({"word": pa.array(words[k : k + (1 << 17)].view(np.int64)), "n": pa.array(n[k : k + (1 << 17)])})

    held, size = [], 0
    for batch in batches:
        for piece in textscan.chunks(batch, "text"):
            words, n = np.unique(tokens(piece.column("text"))[0], return_counts=True)
            if len(words):
                held.append((words, n))
                size += len(words)
            if size > 2_000_000:
                held = [merged(held)]
                size = len(held[0][0])
                if size > 1_500_000:
                    yield from rows(*held[0])
                    held, size = [], 0
    if held:
        yield from rows(*merged(held))


class Words:
    """The words with symbols of their own, sorted by hash: symbols and counts."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, own: int, tail: int):
        order, rank = np.argsort(words), np.lexsort((words, -counts))
        self.own, self.tail = own, tail
        self.words, self.counts = words[order], counts[order]
        symbol = np.zeros(len(words), dtype=np.int64)
        symbol[rank] = np.arange(len(rank))
        self.symbol = symbol[order].astype(np.uint16)
        self.symbol_counts = np.zeros(own, dtype=np.int64)
        self.symbol_counts[: len(rank)] = counts[rank]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, 0 for tail words; symbol) of every token."""
        tail = (self.own + (hashes & np.uint64(self.tail - 1)).astype(np.int64)).astype(np.uint16)
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), tail
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        here = self.words[at] == hashes
        return np.where(here, self.counts[at], 0), np.where(here, self.symbol[at], tail)


def _encode(words):
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("known", pa.int64()), ("log", pa.float64()), ("symbols", pa.binary()), ("rest", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        part, table = TaskContext.get().partitionId(), words.value
        for batch in batches:
            for piece in textscan.chunks(batch, "text"):
                hashes, first = tokens(piece.column("text"))
                count, symbol = table.find(hashes)
                tail = symbol >= table.own
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
                cut = lambda x, at: [memoryview(x).cast("B")[a * x.itemsize : b * x.itemsize] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                left = np.concatenate([[0], np.cumsum(tail)])[first]
                log = np.where(tail, 0.0, np.log10(count + 0.5))
                columns = [np.full(piece.num_rows, part), piece.column("doc_id"), piece.column("held_out"), total(~tail), total(log), cut(symbol.astype("<u2"), first), cut(np.ascontiguousarray(hashes[tail]), left)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run, "part int, doc_id long, held_out boolean, known long, log double, symbols binary, rest binary"


def _tail_words(batches):
    """(part, word): the tail words of each partition, repeated only where a partition has very many."""
    part, held, size = None, [], 0

    def rows():
        words = np.unique(np.concatenate(held))
        return pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(words), part, np.int32)), "word": pa.array(words.view(np.int64))})

    for batch in batches:
        for p, raw in zip(batch.column("part").to_pylist(), batch.column("rest").to_pylist()):
            if held and (p != part or size > HELD_WORDS):
                yield rows()
                held, size = [], 0
            part = p
            if raw:
                held.append(np.frombuffer(raw, "<u8"))
                size += len(held[-1])
    if held:
        yield rows()


class Chunks:
    """Documents of symbols, cut into chunks of at most CHUNK, longest first."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray):
        length = np.diff(first)
        parts = -(-length // CHUNK)
        doc = np.repeat(np.arange(len(length)), parts)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(CHUNK, length[doc] - place * CHUNK)
        order = np.argsort(-size, kind="stable")
        self.symbols, self.docs = symbols, len(length)
        self.start, self.size, self.place, self.doc = (first[doc] + place * CHUNK)[order], size[order], place[order], doc[order]
        self.active = np.searchsorted(-self.size, -np.arange(CHUNK), side="left")  # chunks longer than t
        by_place = np.lexsort((self.doc, self.place))
        cuts = np.searchsorted(self.place[by_place], np.arange(self.place.max(initial=-1) + 2))
        self.turns = [by_place[a:b] for a, b in zip(cuts[:-1], cuts[1:])]  # the kth chunk of every document that has it

    def products(self, step: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled products of the chunks' matrices and the logarithms of the scales; a document's first symbol has no transition before it."""
        h = len(step)
        out = np.broadcast_to(np.eye(h), (len(self.start), h, h)).copy()
        logs, begins = np.zeros(len(self.start)), self.place == 0
        for t in range(CHUNK):
            n = self.active[t]
            if not n:
                break
            x = out[:n]
            moved = (x.reshape(-1, h) @ step).reshape(-1, h, h)
            if t == 0:
                moved[begins[:n]] = x[begins[:n]]
            moved *= emit[self.symbols[self.start[:n] + t]][:, None, :]
            if t % 12 == 11 or t == CHUNK - 1:
                scale = moved.sum(axis=(1, 2))
                moved /= scale[:, None, None]
                logs[:n] += np.log(scale)
            out[:n] = moved
        return out, logs

    def forward(self, start: np.ndarray, products: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(each document's log likelihood, the states before each chunk)."""
        v, before = np.tile(start, (self.docs, 1)), np.zeros((len(self.start), len(start)))
        total = np.zeros(self.docs)
        for at in self.turns:
            doc = self.doc[at]
            before[at] = v[doc]
            x = np.einsum("ni,nij->nj", v[doc], products[at])
            scale = x.sum(axis=1)
            v[doc] = x / scale[:, None]
            total[doc] += np.log(scale) + logs[at]
        return total, before

    def backward(self, products: np.ndarray) -> np.ndarray:
        """The messages behind each chunk."""
        h = products.shape[1]
        v, behind = np.full((self.docs, h), 1.0 / h), np.zeros((len(self.start), h))
        for at in reversed(self.turns):
            doc = self.doc[at]
            behind[at] = v[doc]
            x = np.einsum("nij,nj->ni", products[at], v[doc])
            v[doc] = x / x.sum(axis=1, keepdims=True)
        return behind

    def expect(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray, total: dict) -> None:
        """Adds the expected counts of starts, transitions and emissions to total."""
        products, logs = self.products(step, emit)
        likelihood, before = self.forward(start, products, logs)
        behind = self.backward(products)
        h, begins = len(step), self.place == 0
        emitted = np.zeros((CHUNK, len(self.start), h))
        ahead = np.zeros((CHUNK, len(self.start), h))
        v = before.copy()
        for t in range(CHUNK):
            n = self.active[t]
            if not n:
                break
            x = v[:n] @ step
            if t == 0:
                x[begins[:n]] = v[:n][begins[:n]]
            emitted[t, :n] = emit[self.symbols[self.start[:n] + t]]
            x *= emitted[t, :n]
            x /= x.sum(axis=1, keepdims=True)
            ahead[t, :n] = v[:n] = x
        b = behind.copy()
        for t in range(CHUNK - 1, -1, -1):
            n = self.active[t]
            if not n:
                continue
            gamma = ahead[t, :n] * b[:n]
            gamma /= gamma.sum(axis=1, keepdims=True)
            w = emitted[t, :n] * b[:n]
            previous = ahead[t - 1, :n] if t else before[:n]
            pulled = w @ step.T
            norm = (previous * pulled).sum(axis=1, keepdims=True)
            weighted = previous / norm
            if t == 0:
                weighted[begins[:n]] = 0
                total["start"] += gamma[begins[:n]].sum(axis=0)
            total["step"] += step * (weighted.T @ w)
            emitted[t, :n] = gamma
            b[:n] = pulled / pulled.sum(axis=1, keepdims=True)
        places = [np.arange(self.active[t]) for t in range(CHUNK) if self.active[t]]
        seen = np.concatenate([self.symbols[self.start[p] + t] for t, p in enumerate(places)]) if places else np.zeros(0, np.int64)
        for k in range(h):
            held = np.concatenate([emitted[t, : len(p), k] for t, p in enumerate(places)]) if places else np.zeros(0)
            total["emit"][k] += np.bincount(seen, held, len(emit))
        total["log"] += likelihood.sum()


def counters(states: int, symbols: int) -> dict:
    return {"start": np.zeros(states), "step": np.zeros((states, states)), "emit": np.zeros((states, symbols)), "log": 0.0}


def _batches_of(batches, columns=()):
    """Documents in batches of about BATCH_TOKENS symbols: (values of columns, symbols, first symbol of each, tail words in order)."""
    rows, raw, rest, size = [], [], [], 0

    def out():
        return rows, np.frombuffer(b"".join(raw), "<u2"), np.concatenate([[0], np.cumsum([len(x) // 2 for x in raw])]), np.frombuffer(b"".join(rest), "<u8")

    for batch in batches:
        extra = [batch.column(c).to_pylist() for c in columns]
        for i, (data, words) in enumerate(zip(batch.column("symbols").to_pylist(), batch.column("rest").to_pylist())):
            rows.append(tuple(c[i] for c in extra))
            raw.append(data)
            rest.append(words)
            size += len(data) // 2
            if size >= BATCH_TOKENS:
                yield out()
                rows, raw, rest, size = [], [], [], 0
    if raw:
        yield out()


def _apart(symbols: np.ndarray, rest: np.ndarray, own: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with a number from size on for every tail word, those words)."""
    words, which = np.unique(rest, return_inverse=True)
    out = symbols.astype(np.int64)
    out[symbols >= own] = size + which
    return out, words


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, values = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(words, kind="stable")
    words, values = words[order], values[order]
    first = np.flatnonzero(np.diff(words, prepend=words[:1] - np.uint64(1)))
    return words[first], np.add.reduceat(values, first) if len(first) else values


def _expectation(model, own: int, buckets: int = 0, wanted=None):
    """Rows (block, data): -1 the starts, transitions and likelihood, from 0 on emissions of blocks of symbols; with buckets, below -1 the expected counts of the tail words that the filter lets through, dealt over buckets by hash."""

    def run(batches):
        start, step, emit = model.value
        total, held, size = counters(len(step), len(emit)), [], 0
        row = lambda block, data: pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "data": pa.array([data], pa.binary())})

        def out(words, values):
            bucket = (words >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                yield row(-2 - int(bucket[at[0]]), words[at].astype("<u8").tobytes() + values[at].astype("<f4").tobytes())

        for _, symbols, first, rest in _batches_of(batches):
            if not buckets:
                Chunks(symbols, first).expect(start, step, emit, total)
                continue
            symbols, words = _apart(symbols, rest, own, len(emit))
            classes = own + (words & np.uint64(len(emit) - own - 1)).astype(np.int64)
            part = counters(len(step), len(emit) + len(words))
            Chunks(symbols, first).expect(start, step, np.concatenate([emit, emit[classes]]), part)
            found = part["emit"][:, len(emit) :].T
            part["emit"] = part["emit"][:, : len(emit)]
            np.add.at(part["emit"].T, classes, found)
            for k in total:
                total[k] = total[k] + part[k]
            cell = words & np.uint64((1 << FILTER_BITS) - 1)
            often = (np.frombuffer(wanted.value, np.uint8)[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0
            if often.any():
                held.append((words[often], found[often]))
                size += len(held[-1][0])
            if size > HELD_WORDS:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > HELD_WORDS // 2:
                    yield from out(*held[0])
                    held, size = [], 0
        if held:
            yield from out(*_summed(held))
        yield row(-1, np.concatenate([total["start"], total["step"].reshape(-1), [total["log"]]]).astype("<f8").tobytes())
        for k in range(0, len(emit), BLOCK):
            part = total["emit"][:, k : k + BLOCK]
            if part.any():
                yield row(k // BLOCK, part.astype("<f8").tobytes())

    return run


def _word_sums(states: int):
    """Rows come sorted by block. Gives each word's sums, one bucket at a time."""

    def run(batches):
        block, held, size = None, [], 0
        names = ["word", *(f"g{k}" for k in range(states))]

        def out():
            words, values = _summed(held)
            for k in range(0, len(words), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(words[k : k + (1 << 16)].view(np.int64)), *(pa.array(values[k : k + (1 << 16), x].astype(np.float32)) for x in range(states))], names=names)

        for batch in batches:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                if b != block or size > HELD_WORDS:
                    if b != block and held:
                        yield from out()
                    held, block = ([] if b != block else [_summed(held)]), b
                    size = sum(len(x) for x, _ in held)
                n = len(data) // (8 + 4 * states)
                held.append((np.frombuffer(data, "<u8", n), np.frombuffer(data, "<f4", n * states, 8 * n).reshape(n, states).astype(np.float64)))
                size += n
        if held:
            yield from out()

    return run


def _add(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
            held[b] = held.get(b, 0) + np.frombuffer(data, "<f8")
    for b, x in held.items():
        yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "data": pa.array([x.tobytes()], pa.binary())})


def first_model(unigram: np.ndarray, states: int = STATES, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States that tend to stay, with the corpus' distribution perturbed for each."""
    noise = np.exp(np.random.default_rng(seed).normal(0, 0.5, (states, len(unigram))))
    emit = unigram * noise
    step = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(step, 0.95 if states > 1 else 1.0)
    return np.full(states, 1 / states), step, np.ascontiguousarray((emit / emit.sum(axis=1, keepdims=True)).T)


def train(encoded: DataFrame, unigram: np.ndarray, halves: np.ndarray, own: int, states: int, rounds: int, buckets: int, wanted) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, DataFrame]:
    """((start, step, emit by symbol), expected counts by state and symbol, staged expected counts of tail words by bucket) from encoded(symbols, rest) by Baum-Welch."""
    context, model = encoded.sparkSession.sparkContext, first_model(unigram, states)
    for turn in range(rounds):
        sent, last = context.broadcast(model), turn == rounds - 1
        expected = encoded.select("symbols", "rest").mapInArrow(_expectation(sent, own, buckets if last else 0, wanted), "block int, data binary")
        if last:
            with small_batches(encoded.sparkSession, 200):
                expected = written(expected, "lm-expected")
        # summed in two steps, so that no task reads a block of every partition
        some = expected.where("block >= -1").repartition("block", F.spark_partition_id() % SALTS).mapInArrow(_add, "block int, data binary")
        counts = some.repartition("block").mapInArrow(_add, "block int, data binary").collect()  # a row a block
        emit = np.zeros((states, len(unigram)))
        head = np.zeros(states + states**2 + 1)
        for b, data in counts:
            if b < 0:
                head = np.frombuffer(data, "<f8")
            else:
                part = np.frombuffer(data, "<f8").reshape(states, -1)
                emit[:, b * BLOCK : b * BLOCK + part.shape[1]] = part
        start = head[:states] + 1
        step = head[states : states + states**2].reshape(states, states) + np.eye(states) + 0.1
        share = emit.sum(axis=1, keepdims=True) / emit.sum() if emit.any() else np.full((states, 1), 1 / states)
        smooth = emit + share * halves + PRIOR * unigram
        model = start / start.sum(), step / step.sum(axis=1, keepdims=True), np.ascontiguousarray((smooth / smooth.sum(axis=1, keepdims=True)).T)
        sent.unpersist()
    return model, emit, expected


def _packed(states: int):
    """Rows (part, word, c, weights or nulls) as blobs (part, often, data): of one part, words with counts and weights, or words and counts below LEAST."""
    schema = pa.schema([("part", pa.int32()), ("often", pa.bool_()), ("data", pa.binary())])

    def run(batches):
        for batch in batches:
            part, word, c = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("part", "word", "c"))
            weights = np.stack([batch.column(f"g{k}").to_numpy(zero_copy_only=False) for k in range(states)], axis=1).astype("<f4")
            order = np.lexsort((c >= LEAST, part))
            key = np.stack([part[order], c[order] >= LEAST], axis=1)
            out = []
            for at in np.split(order, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1) if len(order) else []:
                often = bool(c[at[0]] >= LEAST)
                out.append((int(part[at[0]]), often, word[at].astype("<i8").tobytes() + (c[at].astype("<i8").tobytes() + weights[at].tobytes() if often else c[at].astype("u1").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return run, "part int, often boolean, data binary"


def _score(model, own: int, norm: float):
    """Rows come sorted by (part, kind): a partition's tail words with their parts of their symbols, then its documents."""
    columns = ("doc_id", "held_out", "known", "log")

    def run(batches):
        start, step, emit, parts, sums = model.value
        states, part, words, values, blobs = len(step), None, None, None, []
        classes_of = lambda w: (w & np.uint64(len(parts) - 1)).astype(np.int64)

        def table():
            """The words of the part, sorted, with counts and shares of their symbols."""
            found = []
            for often, data in blobs:
                if often:
                    n = len(data) // (16 + 4 * states)
                    w, c, weight = np.frombuffer(data, "<u8", n), np.frombuffer(data, "<i8", n, 8 * n), np.frombuffer(data, "<f4", n * states, 16 * n).reshape(n, states)
                else:
                    n = len(data) // 9
                    w, c = np.frombuffer(data, "<u8", n), np.frombuffer(data, "u1", n, 8 * n)
                    weight = (c + 0.5)[:, None] * parts[classes_of(w)]
                found.append((w, np.concatenate([c[:, None], weight / sums[classes_of(w)]], axis=1)))
            w, x = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros((0, states + 1)))
            order = np.argsort(w)
            return w[order], x[order]

        def scored(batch):
            nonlocal words, values
            if words is None:
                words, values = table()
            for rows, symbols, first, rest in _batches_of([batch], columns):
                numbers, mine = _apart(symbols, rest, own, len(emit))
                at = np.minimum(np.searchsorted(words, mine), max(len(words) - 1, 0))
                known = words[at] == mine if len(words) else np.zeros(len(mine), dtype=bool)
                classes = classes_of(mine)
                share, count = 0.5 * parts[classes] / sums[classes], np.zeros(len(mine))
                share[known], count[known] = values[at[known], 1:], values[at[known], 0]
                chunks = Chunks(numbers, first)
                likelihood, _ = chunks.forward(start, *chunks.products(step, np.concatenate([emit, emit[own + classes] * share])))
                tail = np.concatenate([np.zeros(len(emit)), np.log10(count + 0.5)])
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
                doc_id, held_out, n_known, log = zip(*rows)
                n = np.diff(first)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(doc_id, pa.int64()), "held_out": pa.array(held_out, pa.bool_()), "n_tokens": pa.array(n),
                        "n_known": pa.array(np.array(n_known) + total(np.concatenate([np.zeros(len(emit), np.int64), known.astype(np.int64)])[numbers])),
                        "base_score": pa.array(np.array(log) + total(tail[numbers]) - n * norm), "score": pa.array(likelihood / np.log(10)),
                    }
                )

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("part", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if key[a, 0] != part:
                    part, words, blobs = key[a, 0], None, []
                if key[a, 1] == 0:
                    blobs += zip(*(batch.column(x).slice(a, b - a).to_pylist() for x in ("often", "data")))
                else:
                    yield from scored(batch.slice(a, b - a))

    return run


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, own: int = OWN, tail: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    context = spark.sparkContext
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out)
    counts = written(rows.where("not held_out").select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tail = tail or min(TAIL, 1 << max(4, (max(v - own, 1) // TAIL_WORDS).bit_length()))
    top = counts.orderBy(F.desc("c"), "word").limit(own).toArrow()  # the words with symbols of their own; all others are joined
    words = Words(top.column("word").to_numpy().view(np.uint64), top.column("c").to_numpy(), own, tail)
    # tail words by symbol: all words less those with symbols of their own
    held, kinds = np.zeros(tail), np.zeros(tail)
    for b, c, k in counts.groupBy(F.col("word").bitwiseAND(tail - 1).alias("b")).agg(F.sum("c"), F.count("*")).collect():  # one row a tail symbol
        held[b], kinds[b] = c, k
    place = (words.words & np.uint64(tail - 1)).astype(np.int64)
    np.subtract.at(held, place, words.counts)
    np.subtract.at(kinds, place, 1)
    halves = 0.5 * np.concatenate([words.symbol_counts > 0, kinds + 1])
    unigram = np.concatenate([words.symbol_counts, held]) + halves
    encode, shape = _encode(context.broadcast(words))
    with small_batches(spark):
        encoded = written(rows.mapInArrow(encode, shape), "lm-encoded")
    cell = F.col("word").bitwiseAND((1 << FILTER_BITS) - 1)
    often = counts.where(F.col("c") >= LEAST).select(cell.alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    bits = np.zeros(1 << FILTER_BITS >> 6, dtype="<i8")
    found = often.toArrow()  # at most 2**(FILTER_BITS - 6) rows
    bits[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    buckets = max(16, -(-v // BUCKET_WORDS))
    model, emit, staged = train(encoded.where("not held_out"), unigram / unigram.sum(), halves, own, states, rounds, buckets, context.broadcast(bits.tobytes()))

    # a tail word's part of its symbol: (c + 1/2) (g + DRAW q) / (c + DRAW) over its sum, q the symbol's parts of the states
    g = [f"g{k}" for k in range(states)]
    with small_batches(spark, 200):
        expected = written(staged.where("block < -1").repartition("block").sortWithinPartitions("block").mapInArrow(_word_sums(states), "word long, " + ", ".join(f"{x} float" for x in g)), "lm-sums")
    released(staged)
    symbol = F.col("word").bitwiseAND(tail - 1)
    part = emit[:, own:].T
    parts = np.where(part.sum(axis=1, keepdims=True) > 0, part / np.maximum(part.sum(axis=1, keepdims=True), 1e-300), 1 / states)
    shares = small_table(spark, symbol=pa.array(np.arange(tail)), **{f"q{k}": pa.array(np.ascontiguousarray(parts[:, k])) for k in range(states)})
    weight = lambda k: (F.col("c") + 0.5) * (F.col(f"g{k}").cast("double") + DRAW * F.col(f"q{k}")) / (F.col("c") + DRAW)
    mine = small_table(spark, word=pa.array(words.words.view(np.int64)))  # at most `own` rows
    rest = counts.join(F.broadcast(mine), "word", "left_anti")
    weighed = rest.join(expected, "word", "left").join(F.broadcast(shares), symbol == F.col("symbol"))  # one row a tail symbol
    weighed = written(weighed.select("word", "symbol", "c", *[F.when(F.col("c") >= LEAST, weight(k)).cast("float").alias(f"g{k}") for k in range(states)]), "lm-words")
    released(expected)
    sums = 0.5 * parts
    # one row a tail symbol
    for b, c, *x in weighed.groupBy("symbol").agg(F.sum(F.when(F.col("c") < LEAST, F.col("c") + 0.5).otherwise(0.0)), *[F.sum(F.coalesce(F.col(x).cast("double"), F.lit(0.0))) for x in g]).collect():
        sums[b] += np.array(x) + c * parts[b]

    pack, shape = _packed(states)
    found = encoded.select("part", "rest").mapInArrow(_tail_words, "part int, word long").repartition("word").distinct().join(weighed.drop("symbol"), "word").select("part", "word", "c", *g)
    nothing = lambda names: [F.lit(None).cast(t).alias(x) for x, t in names]
    texts = [("doc_id", "long"), ("held_out", "boolean"), ("known", "long"), ("log", "double"), ("symbols", "binary"), ("rest", "binary")]
    blobs = [("often", "boolean"), ("data", "binary")]
    both = found.mapInArrow(pack, shape).select("part", F.lit(0).alias("kind"), "often", "data", *nothing(texts))
    both = both.unionByName(encoded.select("part", F.lit(1).alias("kind"), *nothing(blobs), *[x for x, _ in texts]))
    model = context.broadcast((*model, parts, sums))
    norm = float(np.log10(n + 0.5 * (v + 1)))
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = written(both.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_score(model, own, norm), shape), "lm-scores")
    released(counts, encoded, weighed)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
