"""Per-document helpers of the n-gram Jaccard join: frequency classes, prefixes and signatures, and bitmap bounds."""

from __future__ import annotations

import numpy as np

from sketchloom.llm.textscan import mix

LOG_COUNTERS = 23
RARE_LEVELS = 254  # levels of rare tokens, by their counts; then one of frequent and one of very frequent ones
SMALL = 24  # sets below this size are indexed by single tokens
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def class_id(grams: np.ndarray) -> int:
    """A 64-bit name of a set, the same for equal sets."""
    size = np.array([len(grams)], dtype=np.uint64)
    return int(mix(mix(grams ^ _A).sum(dtype=np.uint64, keepdims=True) + size * _B).view(np.int64)[0])


def cell(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - LOG_COUNTERS)).astype(np.int64)


def bitmap(grams: np.ndarray) -> bytes:
    """Which of h cells hold one token of the set or more, and which two or more, as two runs of h bits; h is a power of two of one to two times the set's size, 64 at least."""
    h = 1 << max(6, (len(grams) - 1).bit_length())
    counts = np.bincount(((grams >> np.uint64(20)) & np.uint64(h - 1)).astype(np.int64), minlength=h)
    return np.packbits(np.concatenate([counts > 0, counts > 1]), bitorder="little").tobytes()


def folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64-bit words as the bitmaps of the same sets over fewer cells, width words a row."""
    while maps.shape[1] > width:
        quarter = maps.shape[1] // 4
        a, b, a2, b2 = (maps[:, k * quarter : (k + 1) * quarter] for k in range(4))
        maps = np.concatenate([a | b, a2 | b2 | (a & b)], axis=1)
    return maps


def bound_pairs(maps: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
    """For rows of two matrices of bitmaps, a number of common tokens that no pair exceeds: in each cell the smaller count, up to two, and all that cells hold beyond two."""
    width = min(m.shape[1] for m in maps)
    x, y = (folded(m, width) for m in maps)
    spare = [n - np.bitwise_count(m).sum(axis=1, dtype=np.int64) for m, n in zip((x, y), sizes)]
    return np.bitwise_count(x & y).sum(axis=1, dtype=np.int64) + np.minimum(*spare)


def linked(common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """100 * intersection >= 75 * union."""
    return 7 * common >= 3 * (n + m)


def band(n: int) -> int:
    """Sets of which one has at least three quarters of the other's size are in the same band or in neighbouring ones."""
    return int(np.floor(np.log(n) / np.log(4 / 3) + 1e-9))


def classes_of(levels: np.ndarray) -> np.ndarray:
    """The frequency class (0 rare, 1 frequent, 2 very frequent) of tokens by their levels."""
    return (levels >= RARE_LEVELS).astype(np.uint8) + (levels > RARE_LEVELS)


def signatures(grams: np.ndarray, classes: np.ndarray, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signature, kind) of a set: single tokens (kind 0) or combinations of tokens (kind 1).

    Tokens are ordered by frequency class, then by level, if there are levels that ascend with the class, then by hash. A set's prefix is extended until the tokens in it that can be left
    out by a set which shares none of its signatures are more than any partner may leave out: a class of k-token
    combinations with c tokens in the prefix, dealt over groups, accounts for c - k + 1 in each group that has k or more.
    """
    n = len(grams)
    need = n - (3 * n + 3) // 4 + 1
    rank = np.lexsort((grams, classes if levels is None else levels))
    tokens, kinds = grams[rank], classes[rank]
    rare = int((kinds == 0).sum())
    if rare >= need:
        return tokens[:need], np.zeros(need, np.int8)
    out, what = [], []
    if n < SMALL * 4 / 3 + 1:
        out.append(tokens[:need])
        what.append(np.zeros(need, np.int8))
    else:
        out.append(tokens[:rare])
        what.append(np.zeros(rare, np.int8))
    if n >= SMALL:
        own = band(n)
        for scheme in (own - 1, own):
            found = _combinations(tokens[rare:], kinds[rare:], need - rare, scheme)
            if found is not None:
                out.append(found)
                what.append(np.ones(len(found), np.int8))
    out, first = np.unique(np.concatenate(out), return_index=True)
    return out, np.concatenate(what)[first]


def _combinations(tokens: np.ndarray, kinds: np.ndarray, need: int, scheme: int) -> np.ndarray | None:
    """Hashes of the pairs (class 1) and triples (class 2) within groups, until they account for need."""
    groups = max(1, int((4 / 3) ** scheme) // 24)
    group = (mix(tokens ^ _A) % np.uint64(groups)).astype(np.int64) * 2 + (kinds - 1)
    held: dict[int, list[int]] = {}
    salt = np.array([scheme], dtype=np.uint64) * _B
    out: list[np.ndarray] = []
    for i, g in enumerate(group.tolist()):
        if need <= 0:
            break
        mine = held.setdefault(g, [])
        k = 2 + g % 2
        old = np.array(mine, dtype=np.int64)
        if k == 2 and len(mine) >= 1:
            out.append(mix(mix(tokens[old] + salt) + tokens[i]))
        elif k == 3 and len(mine) >= 2:
            a, b = np.triu_indices(len(mine), 1)
            out.append(mix(mix(mix(tokens[old[a]] + salt) + tokens[old[b]]) + tokens[i]))
        need -= len(mine) >= k - 1
        mine.append(i)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
