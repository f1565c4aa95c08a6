"""Vector search, the n-gram join, hidden Markov scoring and the pipeline against brute force."""

import collections
import itertools
import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sketchloom.llm import _signatures, components, hidden_markov, ngram_join, textscan, vector_search


def brute_top(rows, k):
    whole = {}
    for i, x in rows:
        if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            whole.setdefault(i, []).append([math.floor(256 * v) for v in x])
    out = []
    for q, (x,) in ((i, v[:1]) for i, v in whole.items() if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, ys in whole.items() for y in ys if i != q and len(y) == len(x))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_top_k(spark):
    rnd = random.Random(0)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(600)]
    rows += [(i, rows[7][1]) for i in range(600, 900)]  # one very common vector
    rows += [(901, None), (950, [1.0, None] + [0.0] * 6), (1000, [float("nan")] + [0.0] * 7), (None, [1.0] * 8), (1050, [1.0, 2.0]), (1100, [1e30] + [0.0] * 7), (1101, [0.5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    rows += [rows[50]] * 3 + [rows[13]] * 2 + [rows[100]]  # repeated queries and candidates
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    found = vector_search.top_k(df, "vec_id", "embedding", F.col("id") % 50 == 0, k=5)
    rows = [(i, x) for i, x in rows if i != 1100]  # beyond 64 bits
    assert sorted(map(tuple, found.collect())) == brute_top(rows, 5)
    assert vector_search.top_k(df.limit(0), "vec_id", "embedding", F.col("id") % 50 == 0).count() == 0


def test_scores_beyond_64_bits():
    big = np.array([[2**62, 2**61], [2**62, -(2**62)], [1, 1]])
    shard = vector_search.Shard(np.arange(3), big, 2)
    who, found, score = shard.search(np.array([9]), np.array([[1, 1]]), np.array([vector_search.NONE]))
    assert [(int(i), int(s)) for i, s in zip(found, score)] == [(0, 2**62 + 2**61), (2, 2)]
    with pytest.raises(OverflowError):
        shard.search(np.array([9]), big[:1], np.array([vector_search.NONE]))


@pytest.mark.parametrize("scale", [1, 1 << 24])
def test_shard_visits_what_it_must(scale):
    rnd = np.random.default_rng(1)
    vectors = rnd.integers(-40, 40, (700, 5)) * scale
    ids = rnd.permutation(700)
    shard = vector_search.Shard(ids, vectors, 4)
    who, found, score = shard.search(ids[:50], vectors[:50], np.full(50, vector_search.NONE))
    for n in range(50):
        s = [(-int(sum(int(a) * int(b) for a, b in zip(vectors[n], vectors[j]))), int(ids[j])) for j in range(700) if j != n]
        assert [(-int(a), int(b)) for a, b in zip(score[who == n], found[who == n])] == sorted(s)[:4]


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in texts}


def changed(rnd, words, n, vocabulary):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
    return words


def join_cases(seed=0):
    rnd = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(500)]
    base, passage = rnd.choices(vocabulary, k=90), rnd.choices(vocabulary, k=60)
    texts = ["", None, "one", "One", "two words", " a b\tc d ", "a b c d", "a b c d e", "a b c d e"]
    texts += [" ".join(base)] * 25  # exact copies
    texts += [" ".join(changed(rnd, base, rnd.randint(0, 8), vocabulary)) for _ in range(150)]  # a large group of near copies
    texts += [" ".join(passage + rnd.choices(vocabulary, k=rnd.randint(0, 60))) for _ in range(80)]  # a common passage
    texts += [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 60))) for _ in range(60)]
    long_ = rnd.choices(vocabulary, k=1500)
    texts += [" ".join(changed(rnd, long_, k, vocabulary)) for k in (0, 10, 30, 60, 90, 200)] + [" ".join(long_[:1150]), " ".join(long_[:1100])]
    return dict(enumerate(texts))


def test_join(spark):
    texts = join_cases()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, cls string, n int").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
    assert found == brute_components(texts)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in found.items() if i == c)
    assert ngram_join.join(df.limit(0)).count() == 0


@pytest.mark.parametrize("list_rows, block_rows, block_grams", [(1, 16, 1 << 20), (4, 2048, 3000)])
def test_join_in_blocks(spark, monkeypatch, list_rows, block_rows, block_grams):
    """Long lists in many small blocks give the same components."""
    for name, value in (("LIST_ROWS", list_rows), ("BLOCK_ROWS", block_rows), ("BLOCK_GRAMS", block_grams)):
        monkeypatch.setattr(ngram_join, name, value)
    texts = join_cases(3)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()} == brute_components(texts)


def test_join_keeps_one_row_of_each_group(spark):
    rows = [(1, "a b c", 2), (1, "a b c", 1), (None, "q", 0), (None, "Q", 0), (2, None, 0), (3, "x y", 0), (3, "z", 0), (None, "x  y", 0), (4, "", 0), (4, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other int")
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.other) for r in ngram_join.keep_one(df).collect())
    q = next(t for is_null, _, t, _ in kept if is_null)
    assert q in ("q", "Q") and kept == [(False, 1, "a b c", 1), (False, 2, "", 0), (False, 3, "x y", 0), (False, 3, "z", 0), (False, 4, "", 0), (False, 4, "", 0), (True, 0, q, 0)]
    assert ngram_join.keep_one(df.limit(0)).count() == 0


def test_join_of_a_very_long_text(spark):
    words = [f"w{i % 7919}x{i % 104729}" for i in range(150_000)]
    other = [*words[:20_000], "cut", *words[22_000:]]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:60_000]))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.join(df).collect()} == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("seed", range(4))
def test_linked_sets_share_a_signature(seed):
    rnd = np.random.default_rng(seed)
    for _ in range(120):
        universe = rnd.integers(0, 2**63, 4000, dtype=np.uint64)
        classes = dict(zip(universe.tolist(), rnd.choice([0, 1, 2], len(universe), p=[[0.1, 0.6, 0.3], [0.9, 0.1, 0.0], [0, 1, 0], [0, 0, 1]][seed])))
        n = int(rnd.integers(1, 400))
        common = rnd.choice(universe, n, replace=False)
        extra = int(rnd.integers(0, n // 3 + 1))
        cut = int(rnd.integers(0, extra + 1))
        rest = np.setdiff1d(universe, common)[:extra]
        a, b = np.sort(np.concatenate([common, rest[:cut]])), np.sort(np.concatenate([common, rest[cut:]]))
        assert _signatures.linked(n, len(a), len(b)) == (100 * n >= 75 * (n + extra))
        if _signatures.linked(n, len(a), len(b)):
            x, y = (_signatures.signatures(s, np.array([classes[g] for g in s.tolist()], np.uint8))[0] for s in (a, b))
            assert len(np.intersect1d(x, y)), (n, extra)
        maps = [np.frombuffer(_signatures.bitmap(s), "<u8")[None, :] for s in (a, b)]
        assert _signatures.bound_pairs(maps, [np.array([len(a)]), np.array([len(b)])])[0] >= n


def test_rarest_tokens_make_the_prefix():
    counts = np.concatenate([np.full(900, 100), np.arange(1, 101), [479, 480, 500, 480 * 32, 10**6]]).astype(np.uint32)
    few = np.resize(np.array([80, 160], np.uint32), 1000)
    for c in (counts, few, np.zeros(8, np.uint32)):
        frequent = max(16, 4 * (int(c.sum()) // len(c)))
        levels = ngram_join._levels(c)
        assert np.array_equal(_signatures.classes_of(levels), (c >= frequent).astype(int) + (c >= 32 * frequent))  # what is rare stays as it was
        assert (np.diff(levels[np.argsort(c, kind="stable")].astype(int)) >= 0).all()
    grams = np.arange(40, dtype=np.uint64)
    shared = ngram_join._levels(np.append(np.where(grams < 25, 400, 100), np.full(960, 120)).astype(np.uint32))[:40]  # all are rare, the first 25 in four times as many documents
    found, kinds = _signatures.signatures(grams, _signatures.classes_of(shared), shared)
    assert not kinds.any() and found.tolist() == list(range(25, 36))


def test_components(spark):
    rnd = random.Random(9)
    links = [(i, i + 1) for i in range(20)] + [(rnd.randint(100, 130), rnd.randint(100, 130)) for _ in range(25)] + [(7, 7)]
    found = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for p in links for x in p}
    for _ in parent:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: parent[x] for x in nodes}


def test_words_are_those_of_the_contract():
    import pyarrow as pa

    texts = ["A b\x0bC", "é É\x1cx  ", None, "", "a b"]
    hashes, first = textscan.words(*textscan.column_bytes(pa.array(texts)))
    assert np.diff(first).tolist() == [3, 2, 0, 0, 1]
    again, _ = textscan.words(*textscan.column_bytes(pa.array(["a B c"])))
    assert hashes[:3].tolist() == again.tolist() and len(set(hashes.tolist())) == 6


def test_model_probabilities(spark):
    """The forward recursion, chunked, against a plain one, and expectations against brute force."""
    rnd = np.random.default_rng(0)
    symbols = rnd.integers(0, 6, 700).astype(np.uint16)
    first = np.array([0, 1, 300, 301, 500, 700])
    h = 3
    start, step = rnd.dirichlet(np.ones(h)), rnd.dirichlet(np.ones(h), h)
    emit = np.ascontiguousarray(rnd.dirichlet(np.ones(6), h).T)
    chunks = hidden_markov.Chunks(symbols, first)
    found, _ = chunks.forward(start, *chunks.products(step, emit))
    total = hidden_markov.counters(h, 6)
    chunks.expect(start, step, emit, total)
    starts, steps, emits = np.zeros(h), np.zeros((h, h)), np.zeros((h, 6))
    for d, (a, b) in enumerate(zip(first, first[1:])):
        e = emit[symbols[a:b]]
        alpha, scale = np.zeros((b - a, h)), np.zeros(b - a)
        for t in range(b - a):
            alpha[t] = (start if t == 0 else alpha[t - 1] @ step) * e[t]
            scale[t] = alpha[t].sum()
            alpha[t] /= scale[t]
        assert np.isclose(found[d], np.log(scale).sum())
        beta = np.ones((b - a, h))
        for t in range(b - a - 2, -1, -1):
            beta[t] = step @ (e[t + 1] * beta[t + 1]) / scale[t + 1]
        gamma = alpha * beta
        starts += gamma[0]
        for t in range(b - a):
            emits[:, symbols[a + t]] += gamma[t]
            if t:
                steps += np.outer(alpha[t - 1], e[t] * beta[t]) * step / scale[t]
    assert np.allclose(total["start"], starts) and np.allclose(total["step"], steps) and np.allclose(total["emit"], emits)


def test_scores(spark):
    rnd = random.Random(1)
    speech = [[f"{p}{int(rnd.paretovariate(0.9)) % 300}" for _ in range(3000)] for p in "xy"]
    texts = [" ".join(rnd.choices(speech[i % 2], k=rnd.randint(1, 80))) for i in range(400)] + ["", None, "NEVER seen x1", "new " * 300]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    found = {r.doc_id: r for r in hidden_markov.score(df).collect()}
    tokens = {i: [*(t or "").lower().split(), None] for i, t in enumerate(texts)}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    counts = collections.Counter(w for i, t in tokens.items() if not out[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
    held = [r for r in found.values() if r.held_out and r.doc_id < 400]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert hidden_markov.score(df.limit(0)).count() == 0
    alone = hidden_markov.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()
    assert alone.n_tokens == 3


def plain_scores(texts, held_out, states, rounds, own, tail):
    """The whole model by plain loops over tokens."""
    import pyarrow as pa

    docs = []
    for t in texts:
        hashes, _ = hidden_markov.tokens(pa.array([t], pa.string()))
        docs.append(hashes.tolist())
    counts = collections.Counter(w for d, out in zip(docs, held_out) if not out for w in d)
    signed = lambda w: w - 2**64 if w >= 2**63 else w
    ranked = sorted(counts, key=lambda w: (-counts[w], signed(w)))[:own]
    symbol = {w: k for k, w in enumerate(sorted(ranked, key=lambda w: (-counts[w], w)))}
    of = lambda w: symbol.get(w, own + w % tail)
    halves, unigram = np.full(own + tail, 0.5), np.zeros(own + tail)
    halves[len(symbol) : own] = 0
    for w, c in counts.items():
        unigram[of(w)] += c
        halves[of(w)] += 0.5 * (w not in symbol)
    unigram = (unigram + halves) / (unigram + halves).sum()
    start, step, emit = hidden_markov.first_model(unigram, states)

    def passes(d, emission):
        e = np.array([emission(w) for w in d])
        alpha, scale = np.zeros((len(d), states)), np.zeros(len(d))
        for t in range(len(d)):
            alpha[t] = (start if t == 0 else alpha[t - 1] @ step) * e[t]
            scale[t] = alpha[t].sum()
            alpha[t] /= scale[t]
        beta = np.ones((len(d), states))
        for t in range(len(d) - 2, -1, -1):
            beta[t] = step @ (e[t + 1] * beta[t + 1]) / scale[t + 1]
        return e, alpha, beta, scale

    for _ in range(rounds):
        starts, steps, emits, words = np.zeros(states), np.zeros((states, states)), np.zeros((own + tail, states)), collections.defaultdict(lambda: np.zeros(states))
        for d, out in zip(docs, held_out):
            if out:
                continue
            e, alpha, beta, scale = passes(d, lambda w: emit[of(w)])
            starts += alpha[0] * beta[0]
            for t, w in enumerate(d):
                emits[of(w)] += alpha[t] * beta[t]
                words[w] += alpha[t] * beta[t]
                if t:
                    steps += np.outer(alpha[t - 1], e[t] * beta[t]) * step / scale[t]
        start, step = (starts + 1) / (starts + 1).sum(), steps + np.eye(states) + 0.1
        step = step / step.sum(axis=1, keepdims=True)
        emit = emits + np.outer(halves, emits.sum(axis=0) / emits.sum()) + hidden_markov.PRIOR * unigram[:, None]
        emit = emit / emit.sum(axis=0)
    q = np.array([x / x.sum() if x.sum() else np.full(states, 1 / states) for x in emits])
    drawn = lambda w, c: (words[w] + hidden_markov.DRAW * q[of(w)]) / (c + hidden_markov.DRAW) if c >= hidden_markov.LEAST else q[of(w)]
    weight = {w: (c + 0.5) * drawn(w, c) for w, c in counts.items() if w not in symbol}
    sums = 0.5 * q
    for w, x in weight.items():
        sums[of(w)] += x
    assert np.allclose(emit.sum(axis=0), 1)
    parts = lambda w: 1.0 if w in symbol else weight.get(w, 0.5 * q[of(w)]) / sums[of(w)]
    return [np.log10(passes(d, lambda w: emit[of(w)] * parts(w))[3]).sum() for d in docs]


def test_scores_against_plain_loops(spark):
    rnd = random.Random(4)
    texts = [" ".join(f"{'xy'[i % 2]}{int(rnd.paretovariate(0.8)) % 200}" for _ in range(rnd.randint(0, 40))) for i in range(60)] + ["Never seen", "", None, "x1 " * 250]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = sorted(hidden_markov.score(df, states=3, rounds=3, own=20, tail=8).collect())
    expected = plain_scores(texts, [r.held_out for r in found], 3, 3, 20, 8)
    assert np.allclose([r.score for r in found], expected, rtol=1e-5)
    few = sorted(hidden_markov.score(df.limit(9), states=2, rounds=2, own=400, tail=4).collect())
    assert np.allclose([r.score for r in few], plain_scores([texts[r.doc_id] for r in few], [r.held_out for r in few], 2, 2, 400, 4), rtol=1e-5)


def test_scores_of_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a c"), (None, None)], "doc_id long, text string")
    found = hidden_markov.score(df).collect()
    assert sorted(r.n_tokens for r in found) == [1, 3, 3, 3] and len({(r.score, r.base_score) for r in found if r.doc_id == 1}) == 1


def test_pipeline(spark, tmp_path):
    rnd = random.Random(6)
    words = "the and of to in that is was for with house water people because world".split()
    text = lambda n=60: " ".join(rnd.choice(words) + rnd.choice(["", "", "ing", "s"]) for _ in range(n))
    clean = [text() for _ in range(40)]
    items = [" ".join(f"item{rnd.randint(0, 99)}" for _ in range(30)) for _ in range(3)]
    texts = clean + [clean[0], clean[1] + " end", "12 34 !!", f"{text()} {items[0]} {text()}", text() + " password=abc123456 " + text()]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = corpus_pipeline.written(docs, "test")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    n = len(clean)
    assert set(seen["language_id"]) == set(range(n + 5)) - {n + 2}
    assert set(seen["ngram_join"]) == set(range(n + 5)) - {n, n + 1, n + 2}
    assert set(seen["decontamination"]) == set(range(n)) | {n + 4}
    last = seen["secret_scan"][n + 4]
    assert "abc123456" not in last.text and last.n_chars == len(last.text) and all(seen["secret_scan"][i].text == clean[i] for i in range(n))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen["secret_scan"]) and sum(r.length for r in packed) == sum({r.doc_id: r.doc_tokens for r in packed}.values())


@pytest.mark.skipif(not Path("/root/testdata/sf0.001/documents.parquet").exists(), reason="needs the driver's tables")
def test_base_columns_equal_sql(spark):
    """What the language model's contract fixes, counted by SQL: training rows, tokens and the base score."""
    import duckdb

    from sketchloom.llm import queries

    data = "/root/testdata/sf0.001"
    sql = f"""WITH {queries._CRC_TABLE},
d AS (SELECT doc_id, {queries._crc32("doc_id::VARCHAR")} % 5 = 1 AS held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM read_parquet('{data}/documents.parquet'), crc_table),
t AS (SELECT doc_id, held_out, unnest(list_append(list_transform(w, lambda x: 'w' || x), 'end')) AS token FROM d),
c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token),
n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) AS base_score
FROM t LEFT JOIN c USING (token), n GROUP BY doc_id, held_out"""
    expected = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    found = {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in queries.op9_hidden_markov(spark, data).collect()}
    assert set(found) == set(expected)
    for i, row in expected.items():
        assert found[i][:4] == row[:4] and found[i][4] == pytest.approx(row[4], rel=1e-9)
