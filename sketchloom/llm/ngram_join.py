"""Jaccard join of n-gram sets by token-combination prefixes, exact for a threshold of three quarters.

1. A scan names every document's set of word n-grams (equal sets share a 64-bit class id and go on as one class), keeps a
   bitmap of it, and adds up a frequency sketch of all n-grams. The sketch never counts too low, so n-grams of its rare
   class truly are rare. It only decides the order of tokens; any order gives the same links.
2. A second scan gives each class its signatures: the rare tokens of its prefix, rarest first, one by one, frequent ones as pairs and the
   most frequent as triples (see _signatures.signatures). Classes that link share a signature. Signatures are shuffled,
   those of frequent tokens salted, and streamed in order; rare ones met once are dropped there.
3. Every signature links its members to its first member. Pairs are tested by size and bitmap bound, survivors exactly on
   their whole sets, which a scan fetches for these classes alone. Verified links make components.
4. Signatures that still join several components: of lists longer than LIST_ROWS, all with the same first member form a
   group. A group's members are dealt to blocks, bounded in rows and bytes, and each pair of blocks is one task's work: it
   holds the members' whole sets, rules pairs out by component, size and bitmap bound, tests the rest exactly, and gives
   only the links that join components, less than one a member. Components are made anew.
5. Lists of at most LIST_ROWS members that still join several components are joined with themselves, which makes at most
   LIST_ROWS / 2 pairs a row; these are tested as in 3, and components are made anew.

No pair of classes that may link and isn't in one component already goes untested, so components are exact (up to the
chance that two of the 64-bit hashes collide). Groups of exact copies take part as one class; groups of near copies are
never expanded into pairs outside the task that tests them.

A null or empty text has no n-grams, n_shingles 0, and is its own component; a text of fewer than n words has its whole
word sequence as one. Repeated doc_ids count as one document with several texts. Extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm import _signatures as sig
from sketchloom.llm import textscan
from sketchloom.llm.components import components
from sketchloom.llm.staging import own_name, released, small_batches, unless_large, written

BLOCK = 1 << 16
SALTS = 16
LIST_ROWS = 64
BLOCK_ROWS = 2048
BLOCK_GRAMS = 1 << 20  # of all sets of a block
BROADCAST_KEYS = 1 << 22
FILTER_BITS = 24


def _rows(batches, n):
    """(piece, sets) of every slice of the input."""
    for batch in batches:
        for piece in textscan.chunks(batch, "text"):
            yield piece, textscan.shingle_sets(piece.column("text"), n)


def _scan(n: int):
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("block", pa.int32()), ("data", pa.binary())])

    def run(batches):
        seen: set[int] = set()
        counts = np.zeros(1 << sig.LOG_COUNTERS, dtype=np.uint16)
        for piece, sets in _rows(batches, n):
            classes, maps, fresh = [], [], []
            for s in sets:
                c = sig.class_id(s) if len(s) else None
                new = c is not None and c not in seen
                if new:
                    seen.add(c)
                    fresh.append(s)
                classes.append(c)
                maps.append(sig.bitmap(s) if new else None)
            if fresh:
                cells, k = np.unique(sig.cell(np.concatenate(fresh)), return_counts=True)
                counts[cells] = np.minimum(counts[cells].astype(np.int64) + k, 65535)
            rows = len(sets)
            yield pa.RecordBatch.from_arrays([pa.array([0] * rows, pa.int32()), piece.column("key"), piece.column("doc_id"), pa.array(list(map(len, sets)), pa.int64()), pa.array(classes, pa.int64()), pa.nulls(rows, pa.int32()), pa.array(maps, pa.binary())], schema=schema)
        for b, part in enumerate(counts.reshape(-1, BLOCK)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"kind": [1], "key": [None], "doc_id": [None], "n": [None], "cls": [None], "block": [b], "data": [zlib.compress(part.astype("<u2").tobytes(), 1)]}, schema)

    return run


def _add_counts(width: str):
    """Sums of blocks of counts of this width, as counts of four bytes."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                more = np.frombuffer(zlib.decompress(data), width).astype(np.uint32)
                if b in held:
                    held[b] += np.minimum(more, 0xFFFFFFFF - held[b])
                else:
                    held[b] = more
        for b, total in held.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "data": pa.array([zlib.compress(total.astype("<u4").tobytes(), 1)], pa.binary())})

    return run


def _levels(counts: np.ndarray) -> np.ndarray:
    """The level of every cell of the sketch, a byte each.

    The counters are as many however large the table, so what counts as rare grows with what a cell holds on average. Within
    that, a token of fewer documents comes first: it is the one that few lists and no long ones are made of.
    """
    frequent = max(16, 4 * (int(counts.sum(dtype=np.uint64)) // len(counts)))
    rare = np.minimum(counts, frequent - 1).astype(np.uint64) * np.uint64(sig.RARE_LEVELS) // np.uint64(frequent)
    return np.where(counts >= frequent, sig.RARE_LEVELS + (counts >= 32 * frequent), rare).astype(np.uint8)


def _frequency_levels(scan: DataFrame) -> np.ndarray:
    counts = np.zeros(1 << sig.LOG_COUNTERS, dtype=np.uint32)
    shape = "block int, data binary"
    some = scan.where("kind = 1").select("block", "data").repartition("block", F.spark_partition_id() % SALTS).mapInArrow(_add_counts("<u2"), shape)
    for b, data in some.repartition("block").mapInArrow(_add_counts("<u4"), shape).collect():  # one row a block
        counts[b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(zlib.decompress(data), "<u4")
    return _levels(counts)


def _postings(n: int, frequency):
    def run(batches):
        seen: set[int] = set()
        for _, sets in _rows(batches, n):
            out, kinds, classes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int8)], [], []
            for s in sets:
                if not len(s) or (c := sig.class_id(s)) in seen:
                    continue
                seen.add(c)
                levels = frequency.value[sig.cell(s)]
                marks, kind = sig.signatures(s, sig.classes_of(levels), levels)
                out.append(marks)
                kinds.append(kind)
                classes.append(np.full(len(marks), c))
                sizes.append(np.full(len(marks), len(s)))
            if classes:
                cls = np.concatenate(classes)
                salt = np.where(np.concatenate(kinds) > 0, cls % SALTS, -1)
                yield pa.RecordBatch.from_pydict({"sig": pa.array(np.concatenate(out).view(np.int64)), "salt": pa.array(salt.astype(np.int32)), "cls": pa.array(cls), "n": pa.array(np.concatenate(sizes).astype(np.int32))})

    return run


def _lists(batches):
    """Rows come sorted by (sig, salt, cls). Gives every row of a list its first row as center; lists of rare tokens with one row go."""
    names = ("sig", "salt", "cls", "n")
    open_ = None  # the key and center of the list that the last batch ended in, and whether its first row is still held back
    for batch in batches:
        s, salt, c, n = (batch.column(x).to_numpy(zero_copy_only=False) for x in names)
        if open_ and open_[3]:
            s, salt, c, n = (np.insert(x, 0, v) for x, v in zip((s, salt, c, n), (*open_[0], *open_[1])))
        if not len(s):
            continue
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (salt[1:] != salt[:-1])
        repeat = np.zeros(len(s), dtype=bool)
        repeat[1:] = ~new[1:] & (c[1:] == c[:-1])
        if open_ and not open_[3] and (s[0], salt[0]) == open_[0]:
            repeat[0] = c[0] == open_[2]
        last = c[-1]
        s, salt, c, n = s[~repeat], salt[~repeat], c[~repeat], n[~repeat]
        if not len(s):
            continue
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (salt[1:] != salt[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(s)))
        center, center_n = np.repeat(c[first], size), np.repeat(n[first], size)
        goes_on = bool(open_) and not open_[3] and (s[0], salt[0]) == open_[0]
        if goes_on:
            center[: size[0]], center_n[: size[0]] = open_[1]
        keep = np.repeat(size > 1, size) | (salt >= 0)
        keep[: size[0]] |= goes_on
        held = size[-1] == 1 and salt[-1] < 0 and not (goes_on and len(first) == 1)
        open_ = ((s[-1], salt[-1]), (center[-1], center_n[-1]), last, held)
        yield pa.RecordBatch.from_pydict({"sig": pa.array(s[keep]), "combined": pa.array(salt[keep] >= 0), "cls": pa.array(c[keep]), "n": pa.array(n[keep]), "center": pa.array(center[keep]), "center_n": pa.array(center_n[keep])})


def _matrix(maps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(maps), "<u8").reshape(len(maps), -1)


def _bounded(batches):
    """Pairs that size and bitmaps don't rule out."""
    for batch in batches:
        n = [batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("n_a", "n_b")]
        maps = [batch.column(x).to_pylist() for x in ("map_a", "map_b")]
        shape = np.array([(len(x), len(y)) for x, y in zip(*maps)], dtype=np.int64).reshape(-1, 2)
        keep = np.zeros(batch.num_rows, dtype=bool)
        for pair in np.unique(shape, axis=0):
            at = np.flatnonzero((shape == pair).all(axis=1))
            common = sig.bound_pairs([_matrix([m[i] for i in at]) for m in maps], [x[at] for x in n])
            keep[at] = sig.linked(common, n[0][at], n[1][at])
        yield batch.select(["a", "b"]).filter(pa.array(keep))


class _Block:
    """The rows of a pair of blocks: classes with their whole sets, components, and the side each is of."""

    def __init__(self, rows: list[dict]):
        self.cls, self.comp, self.side = (np.array([r[k] for r in rows], dtype=np.int64) for k in ("cls", "comp", "side"))
        sets = [_whole(r["high"], r["low"]) for r in rows]
        self.n = np.array([len(x) for x in sets], dtype=np.int64)
        self.both_sides = rows[0]["left"] != rows[0]["right"]
        maps = [sig.bitmap(x << np.uint64(16)) for x in sets]
        width = np.array([len(m) for m in maps])
        self.groups = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
        self.maps = {w: _matrix([maps[i] for i in at]) for w, at in self.groups.items()}
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.grams = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.here = np.zeros(int(self.grams.max()) + 1, dtype=np.int64)

    def _equal(self, left: int, rights: np.ndarray) -> np.ndarray:
        """How many n-grams a row has in common with each of the others."""
        mine = self.grams[self.first[left] : self.first[left + 1]]
        self.here[mine] = 1
        at = np.concatenate([self.grams[self.first[r] : self.first[r + 1]] for r in rights.tolist()])
        out = np.add.reduceat(self.here[at], np.concatenate([[0], np.cumsum(self.n[rights])[:-1]]))
        self.here[mine] = 0
        return out

    def _likely(self, left: np.ndarray, left_maps: np.ndarray, right: np.ndarray, right_maps: np.ndarray, same: bool) -> np.ndarray:
        """Which pairs of rows neither components, sides, sizes nor bitmaps rule out."""
        n, m = self.n[left][:, None], self.n[right]
        ok = (self.comp[left][:, None] != self.comp[right]) & (4 * n >= 3 * m) & (4 * m >= 3 * n)
        if same:
            ok &= self.cls[left][:, None] < self.cls[right]
        if self.both_sides:
            ok &= self.side[left][:, None] != self.side[right]
        i, j = np.nonzero(ok)
        spare = [self.n[at] - np.bitwise_count(maps).sum(axis=1, dtype=np.int64) for at, maps in ((left, left_maps), (right, right_maps))]
        common = np.bitwise_count(left_maps[i] & right_maps[j]).sum(axis=1, dtype=np.int64) + np.minimum(spare[0][i], spare[1][j])
        ok[i, j] = sig.linked(common, self.n[left][i], self.n[right][j])
        return ok

    def links(self) -> list[tuple[int, int]]:
        """Links that join components, one for each component that a row joins to its own."""
        found = []
        for w, at in self.groups.items():
            for v in (w, 2 * w):
                if v not in self.groups:
                    continue
                right, right_maps = self.groups[v], sig.folded(self.maps[v], w // 8)
                for k in range(0, len(at), 64):
                    left = at[k : k + 64]
                    likely = self._likely(left, self.maps[w][k : k + 64], right, right_maps, v == w)
                    for i in np.flatnonzero(likely.any(axis=1)).tolist():
                        row = left[i]
                        rights = right[likely[i] & (self.comp[right] != self.comp[row])]
                        if not len(rights):
                            continue
                        rights = rights[sig.linked(self._equal(row, rights), self.n[row], self.n[rights])]
                        joined, where = np.unique(self.comp[rights], return_index=True)
                        found += [(int(self.cls[row]), int(self.cls[rights[x]])) for x in where.tolist()]
                        if len(joined):
                            self.comp[np.isin(self.comp, joined)] = self.comp[row]
        return found


def _block_links(batches):
    """Rows come sorted by (first, left, right). Gives the links between components that each pair of blocks holds."""

    def out(rows):
        a, b = np.array(_Block(rows).links(), dtype=np.int64).reshape(-1, 2).T if len(rows) > 1 else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    key, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if (now := (r["first"], r["left"], r["right"])) != key:
                if rows:
                    yield out(rows)
                key, rows = now, []
            rows.append(r)
    if rows:
        yield out(rows)


def _whole(high: bytes, low: bytes) -> np.ndarray:
    """The upper 48 bits of every n-gram of a set."""
    return np.frombuffer(high, "<u4").astype(np.uint64) << np.uint64(16) | np.frombuffer(low, "<u2")


def _sets(n: int, wanted):
    """The sets of the classes that a fixed-size filter lets through, by the upper 48 bits of each n-gram's hash."""

    def run(batches):
        seen: set[int] = set()
        for _, sets in _rows(batches, n):
            classes, high, low = [], [], []
            for s in sets:
                if not len(s) or (c := sig.class_id(s)) in seen:
                    continue
                h = c & ((1 << FILTER_BITS) - 1)
                if wanted.value[h >> 3] >> (h & 7) & 1:
                    seen.add(c)
                    classes.append(c)
                    high.append((s >> np.uint64(32)).astype("<u4").tobytes())
                    low.append((s >> np.uint64(16)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_pydict({"cls": pa.array(classes, pa.int64()), "high": pa.array(high, pa.binary()), "low": pa.array(low, pa.binary())})

    return run


def _verified(batches):
    for batch in batches:
        keep = []
        for ha, la, hb, lb in zip(*(batch.column(c).to_pylist() for c in ("high_a", "low_a", "high_b", "low_b"))):
            x, y = _whole(ha, la), _whole(hb, lb)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            keep.append(7 * int((both[1:] == both[:-1]).sum()) >= 3 * (len(x) + len(y)))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _fetched(docs: DataFrame, n: int, classes: DataFrame) -> DataFrame | None:
    """(cls, high, low): the whole sets of classes(c), by a scan that passes over most others; None without any."""
    spark = docs.sparkSession
    words = classes.select(F.col("c").bitwiseAND((1 << FILTER_BITS) - 1).alias("h")).distinct()
    words = words.groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    wanted = np.zeros(1 << FILTER_BITS >> 6, dtype="<i8")
    for w, bits in words.collect():  # at most 2**(FILTER_BITS - 6) rows
        wanted[w] = bits
    if not wanted.any():
        return None
    sets = docs.mapInArrow(_sets(n, spark.sparkContext.broadcast(wanted.tobytes())), "cls long, high binary, low binary")
    with small_batches(spark):
        return written(sets.groupBy("cls").agg(F.min(F.struct("high", "low")).alias("s")).select("cls", "s.high", "s.low"), "join-sets")


def _check(docs: DataFrame, n: int, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link, tested on their whole sets."""
    pairs = written(pairs, "join-pairs")
    sets = _fetched(docs, n, pairs.select(F.col("a").alias("c")).union(pairs.select("b")))
    if sets is None:
        return pairs
    side = lambda x: sets.toDF(x, f"high_{x}", f"low_{x}")
    with small_batches(docs.sparkSession):
        links = written(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verified, "a long, b long"), "join-links")
    released(sets, pairs)
    return links


def _long_lists(docs: DataFrame, n: int, rows: DataFrame) -> DataFrame:
    """rows(cls, n, comp, first) of lists -> (a, b): links that join the components of all that link among members of lists with the same first."""
    tied = written(rows.select("cls", "n", "comp", "first").distinct(), "join-tied")
    sets = _fetched(docs, n, tied.select(F.col("cls").alias("c")).distinct())
    size = tied.groupBy("first").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    placed = tied.join(size, "first").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).join(sets, "cls")
    placed = placed.withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("first", F.least("own", "peer").alias("left"), F.greatest("own", "peer").alias("right"), F.col("own").alias("side"), "comp", "cls", "high", "low")
    with small_batches(docs.sparkSession):
        links = written(placed.repartition("first", "left", "right").sortWithinPartitions("first", "left", "right").mapInArrow(_block_links, "a long, b long"), "join-links")
    released(tied, sets)
    return links


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(node, label) after links(a, b) between nodes, with or without labels so far."""
    at = lambda x: labels.toDF(x, f"label_{x}")
    between = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).distinct()
    tops = components(between)
    moved = labels.join(tops.toDF("label", "top"), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return written(moved.union(tops.join(labels.select("node"), "node", "left_anti")), "join-labels")


def _mixed(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, cls, n, comp, first, rows) of the lists(sig, cls, n) that join several components."""
    placed = lists.select("sig", "cls", "n").join(labels.toDF("cls", "label"), "cls", "left").select("sig", "cls", "n", F.coalesce("label", "cls").alias("comp"))
    placed = written(placed, "join-placed")
    mixed = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("cls").alias("first"), F.count("*").alias("rows")).where("lo < hi").drop("lo", "hi")
    rows = written(placed.join(mixed, "sig"), "join-rows")
    released(placed)
    return rows


def link_classes(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(members: key, doc_id, n, cls; labels: node, label) of docs(key, doc_id, text)."""
    spark = docs.sparkSession
    with small_batches(spark):
        scan = written(docs.mapInArrow(_scan(n), "kind int, key long, doc_id long, n long, cls long, block int, data binary"), "join-scan")
    members = written(scan.where("kind = 0").select("key", "doc_id", "n", "cls"), "join-members")
    classes = written(scan.where("kind = 0 and data is not null").groupBy("cls").agg(F.min(F.struct("n", "data")).alias("x")).select("cls", F.col("x.n").cast("int").alias("n"), "x.data"), "join-classes")
    frequency = spark.sparkContext.broadcast(_frequency_levels(scan))
    released(scan)
    postings = docs.mapInArrow(_postings(n, frequency), "sig long, salt int, cls long, n int").repartition("sig", "salt").sortWithinPartitions("sig", "salt", "cls")
    with small_batches(spark, 4000):
        lists = written(postings.mapInArrow(_lists, "sig long, combined boolean, cls long, n int, center long, center_n int"), "join-lists")

    fits = lambda x, y: (4 * F.col(x) >= 3 * F.col(y)) & (4 * F.col(y) >= 3 * F.col(x))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = lists.where("not combined and cls <> center").where(fits("n", "center_n")).select(*pair("cls", "center"))
    # lists of combinations were salted, so their first member is found by an aggregate
    combined = lists.where("combined").select("sig", "cls", "n")
    first = combined.groupBy("sig").agg(F.min(F.struct("cls", "n")).alias("f"))
    crossed = combined.join(first, "sig").where("cls <> f.cls").where(fits("n", "f.n")).select(*pair("cls", "f.cls"))
    side = lambda x: classes.toDF(x, f"n_{x}", f"map_{x}")
    bounded = lambda pairs: pairs.distinct().join(side("a"), "a").join(side("b"), "b").mapInArrow(_bounded, "a long, b long")
    links = _check(docs, n, bounded(stars.union(crossed)))
    labels = written(components(links), "join-labels")
    rows = _mixed(lists, labels)
    released(lists)

    long_ = rows.where(F.col("rows") > LIST_ROWS)
    if long_.limit(1).count():
        more = _long_lists(docs, n, long_)
        if more.limit(1).count():
            labels = _merged(labels, more)
            again = _mixed(rows.where(F.col("rows") <= LIST_ROWS), labels)
            released(rows)
            rows = again
    short = rows.where(F.col("rows") <= LIST_ROWS)
    other = short.select("sig", *[F.col(c).alias(f"{c}_2") for c in ("cls", "n", "comp")])
    near = short.join(other, "sig").where("cls < cls_2 and comp <> comp_2").where(fits("n", "n_2")).select(F.col("cls").alias("a"), F.col("cls_2").alias("b"))
    more = _check(docs, n, bounded(near))
    released(rows, classes)
    return members, _merged(labels, more) if more.limit(1).count() else labels


def _rooted(docs: DataFrame, n: int) -> DataFrame:
    """(key, doc_id, n, root) of docs(key, doc_id, text); rows with links, direct or not, or with equal sets have the same root, rows without n-grams none."""
    members, labels = link_classes(docs, n)
    rooted = written(members.join(labels.toDF("cls", "label"), "cls", "left").select("key", "doc_id", "n", F.coalesce("label", "cls").alias("root")), "join-rooted")
    released(members, labels)
    return rooted


def join(docs: DataFrame, n: int = 5) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id (the smallest doc_id that is reached by links)."""
    rooted = _rooted(docs.select(F.lit(0).cast("long").alias("key"), F.col("doc_id").cast("long"), F.col("text").cast("string")), n)
    roots = written(rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")), "join-roots")
    return rooted.join(roots, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5) -> DataFrame:
    """docs with one row of each group of rows that link, directly or not, or have equal sets: that of the smallest doc_id.

    Each row is judged by itself: of a group's rows with one doc_id the one with the smallest hash stays, of equal rows one;
    null ids come last. Rows without words stay. Rows are told by a 64-bit hash of id and text, and only the keys of the rows
    that go are joined: broadcast up to BROADCAST_KEYS of them, by a shuffle beyond.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")
    rooted = _rooted(docs.select(key.alias("key"), F.col("doc_id").cast("long"), F.col("text").cast("string")), n)
    groups = rooted.where("root is not null")
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("k")).select("root", F.col("k.key").alias("kept"))
    counted = written(groups.join(kept, "root").groupBy("key").agg(F.bool_or(F.col("key") == F.col("kept")).alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1"), "join-going")
    released(rooted)
    going, twice = own_name("going"), own_name("twice")
    out = docs.join(unless_large(counted.select(F.col("key").alias(going)), BROADCAST_KEYS), key == F.col(going), "left_anti")
    again = counted.where("stays").select(F.col("key").alias(twice))
    if not again.limit(1).count():
        return out
    # equal rows: one of each stays, the least by the text of its other columns, which any kind of column has
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    equal = docs.join(unless_large(again, BROADCAST_KEYS), key == F.col(twice)).select(row.alias("row"), F.col(twice).alias("told"))
    one = equal.groupBy("told").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return out.unionByName(one.select(*[F.col(f"row.`{c}`") for c in docs.columns]))
