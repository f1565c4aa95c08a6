"""Format-preserving Feistel pseudonyms for personal data in texts.

A value that passes its validity test (e-mail addresses, telephone numbers, IPv4 addresses, payment cards by Luhn, bank
accounts by IBAN's remainder, social security numbers, calendar dates) is ranked among all values of its format, the rank
is permuted by a keyed Feistel network, and the value at the new rank takes its place: separators, lengths, character
classes, check digits and calendars stay valid. The permutation depends on the key and the kind only, so equal values
have equal pseudonyms in all documents, and unmask() inverts it with the key. Equal means: a calendar day in any of its
notations, a telephone number with any separators and with or without its country code, a card or account with or without
spaces, an address in small or large letters.

Telephone numbers are those with a plus sign, those of three, three and four digits, and national ones with a leading zero
and a separator behind the area code. National and international forms of one number are linked where ten digits follow the
zero or the country code.

What stays: whether a date's day is above 12 and whether day or month is below 10 (so that its reading stays the same), digits of a telephone number before the
last ten, the country of an account, the top-level domain of an address. Dates are of 1900 to 2099, in digits, with years of
four digits; a/b/year is read month first where both readings are valid. A match that fails its test is tried again at its
shorter ends, and the scan goes on behind its start. unmask() reads values as this scan does; where neighbouring numbers
make other values than before, only the spans tell.

Kinds earlier in KINDS win where matches overlap. Null texts stay null, empty ones empty; rows are independent, so
repeated rows give repeated results, long texts take time in proportion to their length, and other columns than doc_id and
text are not read.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import textscan

ROUNDS = 10
_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "date": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?:(?=T\d)|(?!\w|[/.-]\d))",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?!\w|-\d)",
    "card": r"(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\w|[.-]\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|(?<![.,/-])0\d{1,4}[ /-]\d{3,4}[ -]?\d{3,4}(?![/.,-]\d))(?!\w)",
}
_TEN_DIGITS = re.compile(r"\d{3}[.-]\d{3}[.-]\d{4}", re.A)  # without a zero of its own
KINDS = tuple(_PATTERNS)
PATTERNS = {k: re.compile(p, re.A) for k, p in _PATTERNS.items()}
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY


class Permutation:
    """Keyed bijections of [0, n), by a Feistel network over a grid of at least n cells, walked until inside."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _mix(self, kind: str, n: int, turn: int, half: int, modulus: int) -> int:
        size = (modulus.bit_length() + 7) // 8 + 8
        seed = f"{kind}|{n}|{turn}|{half}|".encode()
        out = b"".join(hashlib.blake2b(seed + bytes([i]), key=self.key).digest() for i in range(-(-size // 64)))
        return int.from_bytes(out[:size], "big") % modulus

    def _walk(self, x: int, n: int, kind: str, turns: range, sign: int) -> int:
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(x, b)
            for turn in turns:
                if turn % 2:
                    right = (right + sign * self._mix(kind, n, turn, left, b)) % b
                else:
                    left = (left + sign * self._mix(kind, n, turn, right, a)) % a
            x = left * b + right
            if x < n:
                return x

    def forward(self, x: int, n: int, kind: str) -> int:
        return self._walk(x, n, kind, range(ROUNDS), 1) if n > 1 else x

    def back(self, x: int, n: int, kind: str) -> int:
        return self._walk(x, n, kind, range(ROUNDS - 1, -1, -1), -1) if n > 1 else x


def luhn_digit(payload: str) -> str:
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def _permuted(text: str, move, kind: str) -> str:
    """text with its digits and letters moved within their classes; all else stays."""
    radix = [10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 0 for c in text]
    base = [48 if "0" <= c <= "9" else 97 if "a" <= c <= "z" else 65 for c in text]
    rank, n = 0, 1
    for c, r, b in zip(text, radix, base):
        if r:
            rank, n = rank * r + ord(c) - b, n * r
    rank, out = move(rank, n, kind), []
    for c, r, b in zip(reversed(text), reversed(radix), reversed(base)):
        if r:
            rank, digit = divmod(rank, r)
            c = chr(b + digit)
        out.append(c)
    return "".join(reversed(out))


def _put(shape: str, digits: str) -> str:
    """digits in the places of shape's digits."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def _email(text, move):
    shown, _, top = text.rpartition(".")
    return _permuted(shown, move, "email") + "." + top if re.search("[A-Za-z0-9]", text.partition("@")[0]) else None


def _iban(text, move):
    plain = text.replace(" ", "")
    remainder = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
    if not 15 <= len(plain) <= 34 or remainder(plain) != 1:
        return None
    body = _permuted(plain[4:], move, f"iban{plain[:2]}")
    new = f"{plain[:2]}{98 - remainder(plain[:2] + '00' + body):02d}{body}"
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in text)


def _ip(text, move):
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    x = move(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _kind_of_day(day: datetime.date) -> int:
    """Whether the day is above 12, and whether day or month is written with one digit: what tells how a date is to be read."""
    return 2 * (day.day > 12) + (min(day.day, day.month) < 10)


_KINDS_OF_DAYS = np.array([_kind_of_day(datetime.date.fromordinal(_FIRST_DAY + k)) for k in range(_DAYS)])
_LIKE = [np.flatnonzero(_KINDS_OF_DAYS == k) for k in range(4)]  # days from _FIRST_DAY


def _date(text, move):
    """Written with or without leading zeros, as before."""
    sep = re.search(r"[-/.]", text)[0]
    parts = text.split(sep)
    padded = sep == "-" or len(parts[0]) + len(parts[1]) == 4
    for order in ((0, 1, 2),) if sep == "-" else ((2, 1, 0),) if sep == "." else ((2, 0, 1), (2, 1, 0)):
        year, month, day = (int(parts[i]) for i in order)
        try:
            at = datetime.date(year, month, day).toordinal() - _FIRST_DAY
        except ValueError:
            continue
        if not 0 <= at < _DAYS:
            continue
        like = _LIKE[_KINDS_OF_DAYS[at]]
        new = datetime.date.fromordinal(int(like[move(int(np.searchsorted(like, at)), len(like), f"date{_KINDS_OF_DAYS[at]}")]) + _FIRST_DAY)
        out = [""] * 3
        for i, x, width in zip(order, (new.year, new.month, new.day), (4, 2, 2)):
            out[i] = f"{x:0{width if padded else 1}d}"
        return sep.join(out)
    return None


def _ssn(text, move):
    ok = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = text.replace("-", "")
    if not ok(digits):
        return None
    while True:
        digits = f"{move(int(digits), 10**9, 'ssn'):09d}"
        if ok(digits):
            return _put(text, digits)


def _card(text, move):
    digits = re.sub("[ -]", "", text)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    payload = _permuted(digits[:-1], move, "card")
    return _put(text, payload + luhn_digit(payload))


def _phone(text, move):
    """The last ten digits move; where there are no more, all but the first after a plus sign and but a leading zero."""
    digits = re.sub(r"\D", "", text, flags=re.A)
    if not 8 <= len(digits) <= 15:
        return None
    n = min(10, len(digits) - (text[0] == "+" or text[0] == "0" and not _TEN_DIGITS.fullmatch(text)))
    return _put(text, digits[:-n] + _permuted(digits[-n:], move, "phone"))


_RULES = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def _valid(text: str, kind: str, start: int, end: int, move) -> tuple[int, str] | None:
    """(end, new value) of a match of which the whole or a shorter part up to a separator is valid; numbers of ten digits or more from the shortest on."""
    if (new := _RULES[kind](text[start:end], move)) is not None:
        return end, new
    if kind not in ("iban", "phone"):
        return None
    ends = [k for k in range(start + 8, end) if not text[k].isalnum()]
    if kind == "phone":
        many = lambda k: sum(c.isdigit() for c in text[start:k]) >= 10
        ends = [k for k in ends if many(k)] + [k for k in reversed(ends) if not many(k)]
    else:
        ends.reverse()
    for k in ends:
        if (m := PATTERNS[kind].match(text, start, k)) and m.end() == k and (new := _RULES[kind](m[0], move)) is not None:
            return k, new
    return None


def replaced(text: str, move, kinds: tuple[str, ...] = KINDS) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with every valid value moved, and (start, end, kind) of each value in the text given."""
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    for kind in kinds:
        at = 0
        while m := PATTERNS[kind].search(text, at):
            start, end = m.span()
            hit = taken.find(1, start, end)
            if hit >= 0:  # what comes before a value that is taken
                end, cut = hit, PATTERNS[kind].match(text, start, hit)
                m = cut if cut and cut.end() == hit else None
            if m and (good := _valid(text, kind, start, end, move)):
                found.append((start, good[0], kind, good[1]))
                taken[start : good[0]] = b"\1" * (good[0] - start)
                at = good[0]
            else:
                at = start + 1
    found.sort()
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], [x[:3] for x in found]


def unmask(text: str, key: bytes) -> str:
    return replaced(text, Permutation(key).back)[0]


_MARKS = np.zeros(256, dtype=bool)
_MARKS[[ord(c) for c in "0123456789"]] = True


def session_key(spark: SparkSession) -> bytes:
    """The key in spark.sketchloom.pseudonyms.key; where that is unset, a random one for this session, whose pseudonyms nobody can undo later."""
    name = "spark.sketchloom.pseudonyms.key"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name).encode()


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text with pseudonyms, spans ("kind:start:end" in the old text, comma-joined), n_values."""

    def run(batches):
        move = Permutation(key).forward
        for batch in batches:
            for piece in textscan.chunks(batch, "text"):
                data, offsets = textscan.column_bytes(piece.column("text"))
                marks = np.concatenate([[0], np.cumsum(_MARKS[data])])[offsets]
                at = np.concatenate([[0], np.cumsum(data == 64)])[offsets]
                texts, spans, n = piece.column("text").to_pylist(), [""] * piece.num_rows, [0] * piece.num_rows
                most = np.diff(marks)
                for i in np.flatnonzero((most >= 2) | (np.diff(at) > 0)).tolist():
                    # with fewer than four digits only addresses and accounts are left
                    texts[i], found = replaced(texts[i], move, KINDS if most[i] >= 4 else ("email", "iban"))
                    spans[i], n[i] = ",".join(f"{k}:{a}:{b}" for a, b, k in found), len(found)
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "text": pa.array(texts, pa.string()), "spans": pa.array(spans), "n_values": pa.array(n, pa.int64())})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string, spans string, n_values long")
