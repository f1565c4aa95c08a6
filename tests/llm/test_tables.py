"""Manifests, spelling variants and word-level encoding against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from sketchloom.llm import merkle, queries, spelling, tokenids, word_bpe

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place long, leaf string, word string, ids string, n long, part string"


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source, n_chars) with columns of clashing names."""
    return spark.createDataFrame([(*r, 1, "x", "y", "z", 2, "p") for r in rows], SCHEMA)


def equals_sql(spark, name, docs=None):
    import duckdb

    con = duckdb.connect()
    if docs is None:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
        found = queries.QUERIES[name](spark, str(DATA))
    else:
        docs.write.parquet(docs.path)
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{docs.path}/*.parquet')")
        found = docs.result
    expected = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in expected.description]
    assert sorted(found.columns) == sorted(columns)
    key = lambda row: tuple((x is not None, str(x)) for x in row)
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=key) == sorted(expected.fetchall(), key=key)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_spelling_variants"])
def test_query_equals_sql(spark, name):
    equals_sql(spark, name)


# manifests


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """The contract with lists: rows of (doc_id, text, lang, source, n_chars) -> counted result rows."""

    def leaf(doc_id, text, lang, source, n_chars):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
        return out

    def path(tree, at):
        out = []
        for nodes in tree[:-1]:
            low = at - at % 8
            out.append((at % 8, [x for k, x in enumerate(nodes[low : low + 8]) if k != at % 8]))
            at //= 8
        return out

    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append(r)
    order = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([leaf(*r) for r in sorted(parts[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))]) for x in order}
    top = levels([trees[x][-1][0] for x in order]) if order else None
    found = Counter()
    for lang in order:
        for at, r in enumerate(sorted(parts[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))):
            steps = path(trees[lang], at) + path(top, order.index(lang))
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            node = leaf(r[0], re.sub("[A-Z]", lambda m: m[0].lower(), r[1]), *r[2:]) if changed else leaf(*r)
            for k, others in steps:
                node = h(*others[:k], node, *others[k:])
            found[r[0], leaf(*r), trees[lang][-1][0], top[-1][0], h(*[x for _, o in steps for x in o]), node, node == top[-1][0]] += 1
    return found


def check_manifest(spark, rows):
    found = merkle.manifest(documents(spark, rows)).collect()
    assert Counter(tuple(r) for r in found) == plain_manifest(rows)


def odd_rows():
    rnd = random.Random(5)
    rows = [(i * 977 - 3000, rnd.choice(["Ab é", "x", "", None, "ABC ÀÉ"]), rnd.choice(["en", "de", "é", "", None]), rnd.choice(["s", None]), rnd.choice([1, None])) for i in range(90)]
    rows += rows[:7] + rows[:3]  # repeated rows
    rows += [(rows[0][0], f"other {k}", rows[0][2], "s", k) for k in range(20)]  # one id, many texts
    rows += [(None, f"none {k % 5}", "en", "s", None) for k in range(30)]
    return rows + [(2**63 - 1, "A", "en", "s", 1), (-(2**63), "B", "en", "s", 1), (5, "lone", "zz", None, None)]


def test_manifest_of_odd_rows(spark):
    check_manifest(spark, odd_rows())


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 600])
def test_manifest_of_one_language(spark, n):
    check_manifest(spark, [(7 * i, f"Text {i}", "en", "s", i) for i in range(n)])


def test_manifest_of_several_arrays(spark):
    rows = [(i, f"T{i}", "en" if i % 50 else f"l{i}", None, i) for i in range(4500)]
    check_manifest(spark, rows)


def test_manifest_of_nothing_and_of_many_copies(spark, monkeypatch):
    assert merkle.manifest(documents(spark, [])).collect() == []
    monkeypatch.setattr(merkle, "SLOTS", 4096)
    check_manifest(spark, [(3, "Same", "en", "s", 1)] * 5000)


def test_directory(spark):
    rnd = random.Random(3)
    rows = list({(rnd.choice("ab"), rnd.randrange(3), rnd.randrange(4), rnd.randrange(5)): rnd.randrange(1, 9) for _ in range(80)}.items())
    table = spark.createDataFrame([(*k, n) for k, n in rows], "g string, x int, y int, z int, rows long")
    for r in merkle.directory(table, ["g"], ["x", "y", "z"]).collect():
        assert r.before == sum(n for k, n in rows if k[0] == r.g and k[1:] < (r.x, r.y, r.z)) and r.total == sum(n for k, n in rows if k[0] == r.g)


# spelling variants


def plain_groups(rows, least=6, occurrences=5, ratio=5, misspelt=199):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            x = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: x % len(run)] + run[x % len(run) + 1 :] if x % misspelt == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= occurrences}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    close = {w: [x for x in words if near(w, x)] for w in words}
    forms = {}
    for w, others in close.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= ratio * words[w] else None

    def root(w):
        return root(forms[w]) if forms[w] else w

    return {w: (n, len(close[w]), forms[w], words[forms[w]] if forms[w] else None, root(w)) for w, n in words.items()}


def spelling_rows(seed):
    rnd = random.Random(seed)
    base = ["Straße", "garçon", "letters", "LETTERS", "another", "château", "naïveté", "banana", "abcdef", "zzzzzz", "ÀÉÎÕÜÝ", "tomorrow"]
    out = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = rnd.choice(base[: 1 + int(rnd.paretovariate(1.0)) % len(base)])
            for _ in range(min(3, int(rnd.paretovariate(2.5)) - 1)):
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("abcéz") + w[k:], w[:k] + rnd.choice("abÉz") + w[k + 1 :]])
            words.append(w)
        out.append((i if i % 9 else None, " ".join(words) if i % 20 else None, None, None, None))
    return out + out[:5]


@pytest.mark.parametrize("seed,misspelt,block", [(1, 199, 2048), (2, 3, 2), (3, 7, 17)])
def test_spelling_variants(spark, monkeypatch, seed, misspelt, block):
    rows = spelling_rows(seed)
    monkeypatch.setattr(spelling.near, "__defaults__", (block,))
    found = spelling.group(documents(spark, rows), misspelt=misspelt).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found} == plain_groups(rows, misspelt=misspelt)
    assert len(found) == len({r.word for r in found}) and sum(r.n_near > 0 for r in found) > 20


def test_roots_go_to_the_last(spark):
    chain = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(11)] + [("x", "w3")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(chain).collect()} == {f"w{k}": "w11" for k in range(11)} | {"x": "w11"}


def test_spelling_of_nothing_and_of_long_texts(spark, monkeypatch):
    assert spelling.group(documents(spark, [])).collect() == []
    assert spelling.group(documents(spark, [(1, None, None, None, None), (2, "", None, None, None)])).collect() == []
    text = "lengthy " * 300_000 + "x" * 2_000_000 + " lengthx" * 7
    found = {r.word: (r.n, r.form) for r in spelling.group(documents(spark, [(4, text, None, None, None)] * 5), misspelt=None).collect()}
    assert found == {"lengthy": (1_500_000, None), "lengthx": (35, "lengthy"), "x" * 2_000_000: (5, None)}


def test_distances_are_exact():
    long = ["a" * 5000, "a" * 4999 + "b", "a" * 4999]
    assert sorted(spelling.near_pairs(long, long, True)) == [(0, 1), (0, 2), (1, 2)]
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcÀÿ", k=rnd.randint(6, 8))) for _ in range(300)]
    counts = spelling.letter_counts(words)
    assert counts.sum(1).tolist() == [len(w) for w in words] and counts.shape[1] == spelling.LETTERS


# words of a word-level vocabulary


ODD = ["", "  ", None, "Don't they'LL 'S", "x''s !'s", "ΟΔΟΣ Σ", "J̌ á", "<|endoftext|>x<|startoftext|><|endoftext", "Ị̇ x İ", "日本語 です", "a\x1c\x85\xa0b c", "tab\tnew\nline ", "1234 5½ ²", "\x00\x07 é", "ﬁ ﬂ", "word " * 3000, "y" * 4000, "😀 ok 👍🏽"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenids.vocabulary_path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def splitter():
    return word_bpe.Splitter(tokenids.vocabulary_path("word_bpe_49k.json"))


def plain(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


def test_words_are_the_library_s(tokenizer, splitter):
    own = lambda text: [i for words in splitter.words(text) for ids in splitter.ids(words) for i in ids]
    texts = [t or "" for t in ODD] + [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}'s" for c in [*range(0x250), *range(0x2000, 0x2070), 0x20AC, 0x3000]]
    for text in texts:
        assert own(text) == plain(tokenizer, text)[0], text


def test_slices_of_long_texts(tokenizer, splitter, monkeypatch):
    monkeypatch.setattr(word_bpe, "SLICE_CHARS", 10)
    rnd = random.Random(3)
    for _ in range(200):
        text = "".join(rnd.choices(["word", "é", "́", " ", "\n", "'s", "1", "<|endoftext|>", "Σ", "-"], k=60))
        assert [i for words in splitter.words(text) for ids in splitter.ids(words) for i in ids] == plain(tokenizer, text)[0]


def test_squeezed():
    for values in ([], [0], [2**32 - 1, 0, 255, 256], list(range(70000))):
        assert word_bpe.unsqueezed(word_bpe.squeezed(np.array(values, np.int64))).tolist() == values


@pytest.mark.parametrize("buckets", [1, 64])
def test_encoding(spark, tokenizer, monkeypatch, buckets):
    if buckets > 1:
        monkeypatch.setattr(word_bpe, "BUCKET_WORDS", 10)
    rows = [(i if i % 7 else None, t, None, None, None) for i, t in enumerate(ODD * 2)]
    found = word_bpe.encode(documents(spark, rows))
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in found.collect()) == Counter((i, tuple(ids), text) for i, t, *_ in rows for ids, text in [plain(tokenizer, t)])
    digests = Counter(tuple(r) for r in word_bpe.digests(found).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert digests == Counter((i, len(ids), sha(" ".join(map(str, ids))), sha(text)) for i, t, *_ in rows for ids, text in [plain(tokenizer, t)])


def test_encoding_of_nothing(spark):
    assert word_bpe.encode(documents(spark, [])).collect() == []
    found = word_bpe.encode(documents(spark, [(1, None, None, None, None), (2, " \n", None, None, None)])).collect()
    assert sorted((r.doc_id, r.ids, r.decoded) for r in found) == [(1, [], ""), (2, [], "")]


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_whole_documents(spark, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op13_word_bpe(spark, str(DATA)).collect():
        ids, text = plain(tokenizer, docs.pop(r.doc_id))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert not docs


def test_each_word_is_encoded_once(spark):
    path = tokenids.vocabulary_path("word_bpe_49k.json")
    made = []

    class Seen(word_bpe.Splitter):
        def ids(self, words):
            made.extend(words)
            return super().ids(words)

    word_bpe._splitters[path] = Seen(path)
    try:
        lists = pa.RecordBatch.from_pydict({"block": [1, 2, 3], "bucket": pa.array([0, 0, 1], pa.int32()), "steps": [word_bpe.squeezed(np.array([0, 1]))] * 3, "words": [(3).to_bytes(8, "little") + pa.compress(w, codec="zstd", asbytes=True) for w in (b"a\nb", b"b\nc", b"d\ne")]})
        out = list(word_bpe._encoded(path)([lists]))
    finally:
        word_bpe._splitters.clear()
    assert made == ["a", "b", "c", "d", "e"] and len(out) == 3
