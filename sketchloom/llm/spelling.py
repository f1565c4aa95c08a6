"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Tasks count the words of whole texts and Spark adds the counts up. Words are then dealt to cells by length and by how many
of their letters fall in three classes; one edit changes a length by one at most and moves at most one letter from class
to class, so near words lie in the same or in neighbouring cells. A cell's words make blocks of at most BLOCK words. For
each pair of blocks in neighbouring cells, a task takes the words' letter counts as matrices: with G their product,
|a|^2 + |b|^2 - 2 G are the squared distances of all pairs at once. One edit changes them by two at most, so the pairs at
one or two are kept and their edits verified letter by letter. A task returns the near words of a word already summed up:
their number, and the best of them.

A word's form is its near word of most occurrences, where that has `ratio` times its own; forms have more occurrences
than their words, so following them ends after a few steps, which double at each round.

Null texts have no words; a null doc_id is written as nothing before the colon of the deletion rule; repeated rows count
again; ties between forms go to the smaller word; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.staging import released, small_batches, written

BLOCK = 2048
HELD_WORDS = 500_000  # of one task, before it hands its counts on
MISSPELT = 199
SLICE_CHARS = 1 << 20
_RUN = "[A-Za-zÀ-ÿ]"
_GAP = re.compile("[^A-Za-zÀ-ÿ]")
#: Letters by class: a cell counts those of the first three.
_CLASSES = ("etlmzxéèä", "aoinuöüá", "srdcpwíóß")
_PLACE = np.full(256, -1, np.int64)
_PLACE[97:123], _PLACE[0xC0:] = np.arange(26), np.arange(26, 90)
LETTERS = 90


def _slices(text: str):
    """A text in slices cut behind characters that are no letters."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + SLICE_CHARS) if len(text) - at > SLICE_CHARS else None
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


def _counts(least: int, misspelt: int | None):
    """Words by occurrences: maximal runs of letters, lower-cased in ASCII, a few of them with a letter deleted by the rule on doc_id and run."""
    find = re.compile(f"{_RUN}{{{least},}}").findall  # shorter runs stay too short; a run is met at its first letter, so the match is the whole run

    def run(batches):
        held: Counter[bytes] = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                seen: Counter[str] = Counter()
                for part in _slices(text.as_py() or ""):
                    seen.update(find(part))
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                lowered: Counter[bytes] = Counter()
                for word, n in seen.items():
                    lowered[word.encode().lower()] += n  # bytes lower-case A-Z alone
                for word, n in lowered.items():
                    if misspelt and (h := zlib.crc32(word, start)) % misspelt == 0:
                        letters = word.decode()
                        at = h % len(letters)
                        if len(letters) > least:
                            held[(letters[:at] + letters[at + 1 :]).encode()] += n
                    else:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    return run


def words(docs: DataFrame, least: int = 6, occurrences: int = 5, misspelt: int | None = MISSPELT) -> DataFrame:
    """docs(doc_id, text) -> word, n of the words of at least so many letters and occurrences."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = texts.mapInArrow(_counts(least, misspelt), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= occurrences).select(F.decode("word", "UTF-8").alias("word"), "n")


def letter_counts(words: list[str], kind: type = np.float64) -> np.ndarray:
    """A row of letter counts for each word."""
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    cell = np.repeat(np.arange(len(words)), lengths) * LETTERS + _PLACE[codes]
    return np.bincount(cell, minlength=len(words) * LETTERS).reshape(-1, LETTERS).astype(kind)


def one_edit(a: str, b: str) -> bool:
    """Whether b is a with exactly one letter inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def near_pairs(a: list[str], b: list[str], same: bool) -> list[tuple[int, int]]:
    """Places of near words of two blocks; of one block with itself, each pair once."""
    kind = np.float32 if max(map(len, a + b)) <= 1024 else np.float64  # distances are whole numbers, exact below 2**24
    x, y = letter_counts(a, kind), letter_counts(b, kind)
    distance = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
    close = (distance > 0.5) & (distance < 2.5)
    if same:
        close = np.triu(close, 1)
    return [(i, j) for i, j in zip(*(k.tolist() for k in np.nonzero(close))) if one_edit(a[i], b[j])]


def _near(batches):
    """Pairs of blocks to near words, summed up per word: how many, and the best as (-n, word)."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("minus", pa.int64()), ("form", pa.string())])
    for batch in batches:
        for row in batch.to_pylist():
            a, m = row["words_a"], row["n_a"]
            b, n = (a, m) if row["same"] else (row["words_b"], row["n_b"])
            found: dict[str, tuple[int, tuple[int, str]]] = {}
            for i, j in near_pairs(a, b, row["same"]):
                for word, other in ((a[i], (-n[j], b[j])), (b[j], (-m[i], a[i]))):
                    number, best = found.get(word, (0, other))
                    found[word] = number + 1, min(best, other)
            if found:
                yield pa.RecordBatch.from_pydict({"word": list(found), "n_near": [x for x, _ in found.values()], "minus": [x[0] for _, x in found.values()], "form": [x[1] for _, x in found.values()]}, schema)


def _cell(word) -> list:
    """length, and the letters of each class."""
    left = lambda letters: F.length(F.translate(word, letters, ""))
    return [F.length(word).alias("length"), *[(F.length(word) - left(x)).alias(f"c{k}") for k, x in enumerate(_CLASSES)]]


def near(counted: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n -> word, n_near, minus, form of the words that have near ones: their number, and the one of most occurrences (minus is -n)."""
    cell = ["length", "c0", "c1", "c2"]
    placed = counted.select("word", "n", *_cell(F.col("word")))
    sizes = placed.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    parts = placed.join(sizes, cell).withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
    row = F.array_sort(F.collect_list(F.struct("word", "n")))  # about `block` words: chunks deal a cell out evenly
    key = F.concat_ws("-", *cell, "chunk")
    blocks = written(parts.groupBy(*cell, "chunk").agg(row.alias("r")).select(*cell, key.alias("key"), F.col("r.word").alias("words"), F.col("r.n").alias("n")), "spelling-blocks")
    # neighbours of a cell: the length stays or grows by one; each class count moves by one at most, all of them by two in sum
    steps = [(d, x, y, z) for d in (0, 1) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if _moves(d, x, y, z)]
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{k}") for k, v in enumerate(s)]) for s in steps])).alias("s")
    keys = blocks.select(*cell, "key")
    toward = keys.select(F.col("key").alias("a"), "length", "c0", "c1", "c2", step).select("a", *[(F.col(c) + F.col(f"s.d{k}")).alias(c) for k, c in enumerate(cell)])
    pairs = toward.join(keys.withColumnRenamed("key", "b"), cell).select("a", "b", *cell)
    own = F.col("a") == F.col("b")
    forward = pairs.where((F.substring_index("a", "-", 1) != F.substring_index("b", "-", 1)) | (F.col("a") <= F.col("b"))).select("a", "b", own.alias("same"))
    a, b = blocks.select(F.col("key").alias("a"), F.col("words").alias("words_a"), F.col("n").alias("n_a")), blocks.select(F.col("key").alias("b"), F.col("words").alias("words_b"), F.col("n").alias("n_b"))
    tasks = forward.join(a, "a").join(b, "b").repartition("a", "b")
    with small_batches(counted.sparkSession, 16):
        found = written(tasks.mapInArrow(_near, "word string, n_near long, minus long, form string"), "spelling-near")
    best = F.min(F.struct("minus", "form"))
    out = written(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.minus", "b.form"), "spelling-forms")
    released(blocks, found)
    return out


def _moves(d: int, x: int, y: int, z: int) -> bool:
    """Whether one edit can change length and class counts so: a letter more of one class or of none, or a letter of another class."""
    changes = sorted(v for v in (x, y, z) if v)
    return changes in ([], [1]) if d else changes in ([], [-1], [1], [-1, 1])


def roots(forms: DataFrame) -> DataFrame:
    """word, form -> word, root: forms followed to the last, twice as far at each round."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        released(now)
        now = step.select("word", "root")
        now.staged_path = step.staged_path
        if not step.where("moved").limit(1).count():
            return now


def group(docs: DataFrame, least: int = 6, occurrences: int = 5, ratio: int = 5, misspelt: int | None = MISSPELT) -> DataFrame:
    """docs(doc_id, text) -> word, n, n_near, form, form_n, root of every word of at least `least` letters and `occurrences`."""
    with small_batches(docs.sparkSession):
        counted = written(words(docs, least, occurrences, misspelt), "spelling-words")
    close = near(counted)
    kept = -F.col("minus") >= ratio * F.col("n")
    formed = counted.join(close, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(kept, F.col("form")).alias("form"), F.when(kept, -F.col("minus")).alias("form_n"))
    ends = roots(formed.where("form is not null"))
    out = written(formed.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")), "spelling-groups")
    released(counted, close, ends)
    return out
