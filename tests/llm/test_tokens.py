"""Token files and packing against the tokenizer itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sketchloom.llm import packing, textscan, token_file, tokenids

ODD = ["", "  ", "a  b", "\n\na \n b c ", "x  y  z", "é à la 　 b", "don't  't", None, " lead b c", "tail ", "a\x1f b\x1f c", "«a» «b» c   d\te", "<|endoftext|> a", "a <|endoftext|> b<|endoftext|>", "<|endoftext|", "|> c", "a 'll b 's", "x" * 5000, "日本 語 です ", "word " * 3000]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenids.vocabulary_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_stretches_join(tokenizer):
    coder = tokenids.IdEncoder(tokenids.vocabulary_path())
    for texts in (ODD, ODD[::-1], [" ".join(random.Random(1).choices("the of Xy é, 12 a\nb \t".split(" ") + ["", "\n"], k=3000))]):
        ids, first = coder.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [ids_of(tokenizer, t) for t in texts]


def test_stretches_beyond_the_cache(tokenizer, monkeypatch):
    monkeypatch.setattr(tokenids, "CACHE_STRETCHES", 200)
    coder, rnd = tokenids.IdEncoder(tokenids.vocabulary_path()), random.Random(2)
    for _ in range(30):
        texts = [" ".join(f"w{int(rnd.paretovariate(0.5)) % 5000}" for _ in range(60)) for _ in range(3)]
        ids, first = coder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [ids_of(tokenizer, t) for t in texts]
        assert len(coder.old.known) <= 200


@pytest.mark.parametrize("used", [0, 1, 2, 3, 300])
def test_code(used):
    rnd = np.random.default_rng(used)
    counts = np.zeros(65536, np.int64)
    counts[rnd.choice(65536, used, replace=False)] = (2.0 ** rnd.uniform(0, 40, used)).astype(np.int64)
    lengths = token_file.code_lengths(counts)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= token_file.MAX_LENGTH
    if used > 1:
        assert sum(2.0 ** -int(x) for x in lengths[lengths > 0]) == 1
    ids = rnd.choice(np.flatnonzero(counts), 5000).astype(np.uint16) if used else np.zeros(0, np.uint16)
    codes, table = token_file.canonical_codes(lengths), token_file.decoding_table(lengths)
    for n in (0, 1, 255, 256, 257, 5000):
        n = min(n, len(ids))
        blob = token_file.encode_segment(7, np.array([3, 9]), np.array([n, 0]), ids[:n], lengths, codes, 5)
        first, docs, each, back = token_file.decode_segment(blob, table, 5)
        assert first == 7 and docs.tolist() == [3, 9] and each.tolist() == [n, 0] and (back == ids[:n]).all()
    with pytest.raises(ValueError):
        token_file.decode_segment(blob, table, 6)


def test_lengths_are_optimal():
    import heapq

    counts = np.random.default_rng(3).integers(1, 1000, 200)
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert (token_file.code_lengths(counts) * counts).sum() == cost


def documents(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, f"s{i % 3}" if i % 5 else None, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, ids string, start int")


def test_token_file(spark, tokenizer, monkeypatch):
    order = list(range(len(ODD)))
    random.Random(0).shuffle(order)
    docs = documents(spark, ODD, order)
    path = token_file.write_token_file(docs, token_file.new_path(spark))
    found = {r.doc_id: r for r in token_file.read_token_file(spark, path, with_ids=True).collect()}
    start = 0
    for i, text in sorted(zip(order, ODD)):
        ids = [*ids_of(tokenizer, text), 2]
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32, found[i].ids) == (start, len(ids), crc(ids), ids)
        start += len(ids)


def test_token_file_of_nothing_and_of_repeats(spark):
    path = token_file.write_token_file(documents(spark, []), token_file.new_path(spark))
    assert token_file.read_token_file(spark, path).collect() == []
    path = token_file.write_token_file(documents(spark, ["a b", "a b", "c"], [4, 4, None]), token_file.new_path(spark))
    found = sorted(token_file.read_token_file(spark, path).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start) for r in found] == [(None, 0), (4, 2), (4, 5)]


def check_pieces(tokenizer, docs, rows, size):
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in docs.items():
        ids, at = [*ids_of(tokenizer, text), 1], 0
        for r in sorted(by.pop(i), key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    assert not by
    for k, held in sequences.items():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == size or (k == max(sequences) and at < size)
    assert sorted(sequences) == list(range(len(sequences)))
    return sequences


@pytest.mark.parametrize("targets", [None, {"s0": 0.7, "s1": 0.2}])
def test_packing(spark, tokenizer, targets):
    rows = packing.pack(documents(spark, ODD), targets, size=128).collect()
    check_pieces(tokenizer, dict(enumerate(ODD)), rows, 128)
    assert packing.pack(documents(spark, [])).collect() == []


def test_windows_follow_the_targets(spark, tokenizer):
    texts = [f"word{i} text of some length " * 40 for i in range(60)]
    sequences = check_pieces(tokenizer, dict(enumerate(texts)), packing.pack(documents(spark, texts), size=512).collect(), 512)
    total = defaultdict(int)
    for held in sequences.values():
        for r in held:
            total[r.source] += r.length
    whole = sum(total.values())
    for k, held in sequences.items():
        if k < len(sequences) - 1:
            for source, n in total.items():
                assert abs(sum(r.length for r in held if r.source == source) - 512 * n / whole) <= packing.MIN_PIECE + len(total)


def test_unnamed_sources_share_what_is_left(spark, tokenizer):
    texts = [f"word{i} text of some length " * 40 for i in range(60)]
    docs = spark.createDataFrame([(i, t, "abc"[i % 3]) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    sequences = check_pieces(tokenizer, dict(enumerate(texts)), packing.pack(docs, {"a": 0.3, "b": 0.3}, size=512).collect(), 512)
    for k in range(len(sequences) // 2):
        share = {x: sum(r.length for r in sequences[k] if r.source == x) for x in "abc"}
        assert all(abs(share[x] - 512 * t) <= packing.MIN_PIECE + 4 for x, t in zip("abc", (0.3, 0.3, 0.4)))


@pytest.mark.parametrize("targets", [None, {"s3": 0.2, None: 0.1}])
def test_more_sources_than_queues(spark, tokenizer, monkeypatch, targets):
    """Sources in groups of groups have queues and targets of their own."""
    monkeypatch.setattr(packing, "FANOUT", 3)
    rnd = random.Random(3)
    texts = [f"word{i} of a text " * rnd.randint(1, 30) for i in range(150)]
    source = [f"s{i % 40}" if i % 41 else None for i in range(150)]
    docs = spark.createDataFrame(list(zip(range(150), texts, source)), "doc_id long, text string, source string").repartition(3)
    sequences = check_pieces(tokenizer, dict(enumerate(texts)), packing.pack(docs, targets, size=256).collect(), 256)
    if targets:
        share = sum(r.length for k in range(3) for r in sequences[k] if r.source == "s3") / (3 * 256)
        assert abs(share - 0.2) < 0.05


def test_packing_of_repeated_rows(spark, tokenizer):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "c", None), (2, "tie", "y")], "doc_id long, text string, source string")
    rows = packing.pack(docs, size=8).collect()
    n = {t: len(ids_of(tokenizer, t)) + 1 for t in ("a b", "c", "tie")}
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in rows if r.start == 0) == [(0, n["c"]), (1, n["a b"]), (1, n["a b"]), (2, n["tie"])]
    assert sum(r.length for r in rows) == 2 * n["a b"] + n["c"] + n["tie"]


def test_schedule_against_a_loop():
    totals, weights, size = [1000, 37, 4000, 1], [1.0, 2.0, 1.0, 0.5], 100
    plan = packing.schedule(totals, weights, size)
    rounds = np.arange(int(plan.first[-1]) + 1)
    paid = plan.paid(rounds)
    assert (paid[0] == 0).all() and (paid[-1] == totals).all() and (np.diff(paid, axis=0) >= 0).all()
    # the deficit counters, kept by a plain loop
    credit, out, done = [0.0] * 4, [0] * 4, [0] * 4
    for r in rounds[:-1].tolist():
        left = [k for k in range(4) if done[k] < totals[k]]
        p = int(np.searchsorted(plan.first, r, side="right") - 1)
        for k in left:
            credit[k] += plan.rate[p, k] / (1 << packing.SHIFT)
        for k in range(4):
            assert paid[r + 1, k] <= credit[k] + 1e-6 or paid[r + 1, k] == totals[k]
            assert credit[k] - paid[r + 1, k] <= packing.MIN_PIECE + 1 or paid[r + 1, k] == totals[k]
            done[k] = paid[r + 1, k]
    for q in range(4):
        places = np.arange(totals[q])
        turn = plan.round_of(np.full(len(places), q), places)
        assert ((paid[turn, q] <= places) & (paid[turn + 1, q] > places)).all()
