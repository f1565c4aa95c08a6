"""Secret scans: three base patterns, and a token-efficiency test for random strings.

A stretch of at least MIN_RUN characters of keys, digits and their punctuation is random if a byte-pair vocabulary needs
many tokens for it: words and identifiers have merges, random strings don't. Known digests (hex of a digest's length),
UUIDs, plain numbers, one or two characters repeated and stretches made of words are excluded before the test; words are told by the same efficiency, in
small letters and apart, as case and joints split their merges. Stretches below LONG_RUN are tested with a tighter bound
and not if they are one plain word, so random small letters alone are found from LONG_RUN characters on, other alphabets
from MIN_RUN; random strings below MIN_RUN are not looked for. Of a stretch that overlaps base matches, the parts outside
them are tested: parts of MIN_RUN alone, shorter ones where they go on an access or hex match without a joint.

Null and empty texts give no spans. Rows are independent, so repeated rows give repeated results, and extra columns are
kept unless scan() is asked for digests. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm import textscan

# The base patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

MIN_RUN = 16
LONG_RUN = 20
MAX_RATIO = 2.1
SHORT_RATIO = 1.8  # of stretches below LONG_RUN, whose ratios vary more
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128})\Z")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
PLAIN_WORD = re.compile(r"[A-Z]?[a-z]+\Z")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_RUN_BYTES = np.zeros(256, dtype=bool)
_RUN_BYTES[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_vocabularies: dict[str, object] = {}


def vocabulary(path: str):
    import public_tokenizers
    import tiktoken

    if path not in _vocabularies:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _vocabularies[path] = tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _vocabularies[path]


def ratio(run: str, coder) -> float:
    """Characters per token."""
    return len(run) / len(coder.encode_ordinary(run))


def is_identifier(run: str, coder, max_ratio: float = MAX_RATIO) -> bool:
    """Whether a stretch is a known digest, a UUID, a number or made of words and short numbers."""
    if DIGEST.match(run) or UUID.match(run) or not re.search(r"[A-Za-z]", run) or len(set(run)) < 3:
        return True
    parts = PARTS.findall(run)
    words = [x for x in parts if x.isalpha()]
    if len(parts) * 4 > len(run) or any(len(x) > 4 for x in parts if x.isdigit()):
        return False
    return sum(map(len, words)) > max_ratio * sum(len(coder.encode_ordinary(" " + x.lower())) for x in words)


def is_random(run: str, coder, max_ratio: float = MAX_RATIO) -> bool:
    """Whether a stretch needs too many tokens for its length; below LONG_RUN, plain words don't count and the bound is SHORT_RATIO."""
    if len(run) < LONG_RUN:
        if PLAIN_WORD.match(run):
            return False
        max_ratio = min(max_ratio, SHORT_RATIO)
    return not is_identifier(run, coder, max_ratio) and ratio(run, coder) <= max_ratio


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base matches."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, base: list[tuple[int, int, int]], coder, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    out, near, later = [], [], 0
    for m in RUN.finditer(text):
        a, b = m.span()
        while later < len(base) and base[later][0] < b:
            near.append(base[later])
            later += 1
        near = hits = [x for x in near if a < x[2]]
        if not hits:
            if is_random(m[0], coder, max_ratio):
                out.append((a, 3, b))
            continue
        at = a
        for x, _, y in [*hits, (b, -1, b)]:
            part = text[at:x]
            goes_on = any(k in (1, 2) and (q == at and part[:1].isalnum() or p == x and part[-1:].isalnum()) for p, k, q in hits)
            rest = goes_on and part and not is_identifier(part, coder, max_ratio) and ratio(part, coder) <= max_ratio
            if rest or len(part) >= MIN_RUN and is_random(part, coder, max_ratio):
                out.append((at, 3, x))
            at = max(at, y)
    return out


def spans_of(text: str, coder) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted(base + random_spans(text, base, coder))


def written_form(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _suspects(piece: pa.RecordBatch) -> tuple[np.ndarray, list[str | None]]:
    """Rows that may hold a span: a long stretch, or a name of an assignment."""
    data, offsets = textscan.column_bytes(piece.column("text"))
    ink = np.concatenate([[False], _RUN_BYTES[data], [False]])
    edges = np.flatnonzero(ink[1:] != ink[:-1])
    long_ = edges[0::2][edges[1::2] - edges[0::2] >= MIN_RUN]
    flagged = np.zeros(piece.num_rows, dtype=bool)
    flagged[np.searchsorted(offsets, long_, side="right") - 1] = True
    texts = piece.column("text").to_pylist()
    for i, text in enumerate(texts):
        if text and not flagged[i]:
            low = text.lower()
            flagged[i] = any(name in low for name in _NAMES)
    # a stretch that runs over the end of a row begins in it, and a row after it that it covers is searched too
    ends = edges[1::2][edges[1::2] - edges[0::2] >= MIN_RUN]
    for a, b in zip(long_.tolist(), ends.tolist()):
        lo, hi = np.searchsorted(offsets, [a, b - 1], side="right") - 1
        flagged[lo : hi + 1] = True
    return flagged, texts


def scan(docs: DataFrame, tiktoken_path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    import public_tokenizers

    path = tiktoken_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        coder = vocabulary(path)
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for piece in textscan.chunks(batch, "text"):
                flagged, texts = _suspects(piece)
                counts = np.zeros((piece.num_rows, 4), dtype=np.int64)
                sha, spans = [nothing] * piece.num_rows, [""] * piece.num_rows
                for i in np.flatnonzero(flagged).tolist():
                    found = spans_of(texts[i] or "", coder)
                    for _, k, _ in found:
                        counts[i, k] += 1
                    sha[i] = hashlib.sha256(written_form([x for x in found if x[1] < 3]).encode()).hexdigest()
                    spans[i] = written_form(found)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": piece.column("doc_id")} | {f"n_{k}": pa.array(counts[:, j]) for j, k in enumerate(KINDS[:3])} | {"base_sha256": pa.array(sha), "spans": pa.array(spans), "n_random": pa.array(counts[:, 3])}
                )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[SECRET]", tiktoken_path: str | None = None) -> DataFrame:
    """docs with every span of its text replaced by mark (overlapping spans by one) and n_chars, if there, counted anew; all rows and columns stay."""
    import public_tokenizers

    path = tiktoken_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    at = docs.columns.index("text")

    def run(batches):
        coder = vocabulary(path)
        for batch in batches:
            for piece in textscan.chunks(batch, "text"):
                flagged, texts = _suspects(piece)
                for i in np.flatnonzero(flagged).tolist():
                    out, reach = [], 0
                    for a, _, b in spans_of(texts[i] or "", coder):
                        if a >= reach:
                            out += [texts[i][reach:a], mark]
                        reach = max(reach, b)
                    if out:
                        texts[i] = "".join(out) + texts[i][reach:]
                yield piece.set_column(at, piece.schema.field(at), pa.array(texts, piece.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
