"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of token ids. In every round each queue earns a window's worth of credit in its target
proportion, pays out the whole tokens its deficit counter allows (a queue that earns less than MIN_PIECE a round waits
until it can pay MIN_PIECE), and carries the rest into the next round. What the queues pay out, round by round and queue
by queue, is cut into windows of `size` tokens. When a queue runs dry the others share its credit.

A queue's credit after r rounds of a phase (the rounds between two queues running dry) is a product, so the deficits at
any window follow from the queues' totals alone. Every document therefore places its own pieces wherever it lies, with
the deficits carried across windows and partitions, and no token is shuffled. Credit is kept in units of 1/2**SHIFT
tokens in 64-bit integers.

Every source has a queue of its own; a null source is a source. Named sources (those with a target) and the FANOUT with the
most tokens are queues of the top schedule. Where more than FANOUT others are left, they are dealt to groups of about FANOUT
by hash, groups to groups again, and each group's queues pay out into a stream by a schedule of the group; the groups at the
top are queues of the top schedule, with the sums of their members' tokens and targets. A piece passes through one schedule a
level.

Without targets, a queue's proportion is its share of all tokens. With targets, named sources have theirs and the others
share what is left of 1 by their tokens; where nothing is left they come after the named ones. When a queue runs dry, the
others share its credit in proportion. Equal totals go by source.

Null and very long texts are packed whole, repeated rows one by one with the id they have; a null doc_id stays null.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.llm import textscan
from sketchloom.llm.staging import small_batches, small_table, unless_large, written
from sketchloom.llm.tokenids import SLICE_BYTES, encoder, vocabulary_path

FANOUT = 128
HELD_SCHEDULES = 256
MIN_PIECE = 64
BROADCAST_ROWS = 1 << 19
SHIFT = 10


@dataclass
class Schedule:
    """The rounds of all phases: row p of `credit` and `rate` holds for the rounds from first[p] on."""

    size: int
    totals: np.ndarray
    first: np.ndarray
    credit: np.ndarray
    rate: np.ndarray

    def paid(self, rounds: np.ndarray, queues: np.ndarray | None = None) -> np.ndarray:
        """Tokens paid out before each of the rounds: by all queues (a row each), or by the queue given for each."""
        p = np.maximum(np.searchsorted(self.first, rounds, side="right") - 1, 0)
        gone = rounds - self.first[p]
        if queues is None:
            rate, credit, total, gone = self.rate[p], self.credit[p], self.totals[None, :], gone[:, None]
        else:
            rate, credit, total = self.rate[p, queues], self.credit[p, queues], self.totals[queues]
        whole = (credit + gone * rate) >> SHIFT
        slow = rate < MIN_PIECE << SHIFT
        return np.where(whole >= total, total, np.where(slow, whole // MIN_PIECE * MIN_PIECE, whole))

    def round_of(self, queues: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The round in which each queue pays out its token at the place given (by bisection)."""
        low, high = np.zeros(len(places), np.int64), np.full(len(places), self.first[-1], np.int64)
        while (high - low > 1).any():
            mid = (low + high) // 2
            below = self.paid(mid, queues) <= places
            low, high = np.where(below, mid, low), np.where(below, high, mid)
        return low


def schedule(totals: list[int], targets: list[float], size: int) -> Schedule:
    """Phases end when a queue has run dry; at the first round of the last entry all have."""
    totals_, weights = np.array(totals, np.int64), np.array(targets, np.float64)
    credit, now = np.zeros(len(totals_), np.int64), 0
    first, credits, rates = [], [], []
    full = totals_ << SHIFT
    while (left := credit < full).any():
        share = np.where(left, np.maximum(weights, 1e-12), 0)
        rate = np.where(left, np.maximum((size * share / share.sum() * (1 << SHIFT)).astype(np.int64), 1), 0)
        rounds = int((-((credit - full)[left] // rate[left])).min())
        first.append(now)
        credits.append(credit.copy())
        rates.append(rate)
        now, credit = now + rounds, np.where(left, credit + rounds * rate, credit)
    return Schedule(size, totals_, np.array([*first, now], np.int64), np.array([*credits, credit], np.int64), np.array([*rates, np.zeros_like(credit)], np.int64))


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes, the group of each element and its place there."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def flow(plan: Schedule, queues: np.ndarray, places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start in it, length, place in what the queues pay out) of the runs of documents that lie in queues at these places."""
    lo, hi = plan.round_of(queues, places), plan.round_of(queues, places + counts - 1)
    doc, k = _ragged(hi - lo + 1)
    rounds, q = lo[doc] + k, queues[doc]
    seen, inverse = np.unique(rounds, return_inverse=True)
    before, after = plan.paid(seen), plan.paid(seen + 1)
    line = before.sum(axis=1)[:, None] + np.cumsum(after - before, axis=1) - (after - before)
    from_, upto = before[inverse, q], after[inverse, q]
    a, b = np.maximum(places[doc], from_), np.minimum((places + counts)[doc], upto)
    keep = b > a
    doc, a, b, at = doc[keep], a[keep], b[keep], (line[inverse, q] + np.maximum(a - from_, 0))[keep]
    return doc, a - places[doc], b - a, at


def windows(size: int, start: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(run, start, length, sequence, offset) of runs at these places, cut at the ends of windows."""
    window = at // size
    run, k = _ragged((at + length - 1) // size - window + 1)
    sequence = window[run] + k
    begin = np.maximum(at[run], sequence * size)
    end = np.minimum((at + length)[run], (sequence + 1) * size)
    return run, start[run] + begin - at[run], end - begin, sequence, begin - sequence * size


class Levels:
    """Sends documents' tokens through the schedules of their groups up to the top."""

    def __init__(self, top: Schedule):
        self.top, self.size, self.held = top, top.size, {}

    def _schedule(self, key: tuple, totals: list[int], targets: list[float]) -> Schedule:
        if key not in self.held:
            if len(self.held) >= HELD_SCHEDULES:
                self.held.clear()
            self.held[key] = schedule(totals, targets, self.size)
        return self.held[key]

    def pieces(self, queues: np.ndarray, places: np.ndarray, counts: np.ndarray, chains: list) -> tuple[np.ndarray, ...]:
        """(document, start, length, sequence, offset) of every piece. chains: for documents in groups, the groups from the first to the top as (id, totals, targets, queue above)."""
        doc, start = np.arange(len(queues)), np.zeros(len(queues), np.int64)
        for level in range(max((len(c) for c in chains if c), default=0)):
            inner = np.array([bool(chains[d]) for d in doc.tolist()])
            out = [(doc[~inner], start[~inner], queues[~inner], places[~inner], counts[~inner])]
            ids = np.array([chains[d][level]["id"] if chains[d] else -1 for d in doc.tolist()], dtype=np.int64)
            for i in np.unique(ids[inner]).tolist():
                mine = np.flatnonzero(ids == i)
                group = chains[doc[mine[0]]][level]
                d, s, n, at = flow(self._schedule((level, i), group["totals"], group["targets"]), queues[mine], places[mine], counts[mine])
                out.append((doc[mine][d], start[mine][d] + s, np.full(len(d), group["queue"]), at, n))
            doc, start, queues, places, counts = (np.concatenate(x) for x in zip(*out))
        d, s, n, at = flow(self.top, queues, places, counts)
        doc, start = doc[d], start[d] + s
        run, start, n, sequence, offset = windows(self.size, start, n, at)
        return doc[run], start, n, sequence, offset


def _tokenize(path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        part, reach = TaskContext.get().partitionId(), {}
        coder = encoder(path)
        for batch in batches:
            for piece in textscan.chunks(batch, "text", SLICE_BYTES):
                ids, first = coder.encode(piece.column("text"))
                ids, counts = np.insert(ids, first[1:], end_id), np.diff(first) + 1
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u2")).cast("B")
                places = []
                for source, n in zip(piece.column("source").to_pylist(), counts.tolist()):
                    places.append(reach.get(source, 0))
                    reach[source] = places[-1] + n
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(np.full(len(counts), part), pa.int32()), "source": piece.column("source"), "place": pa.array(places, pa.int64()), "doc_id": piece.column("doc_id"),
                        "doc_tokens": pa.array(counts, pa.int64()), "ids": pa.array([raw[2 * (e - n) : 2 * e] for e, n in zip(ends.tolist(), counts.tolist())], pa.binary()),
                    }
                )

    return run, "part int, source string, place long, doc_id long, doc_tokens long, ids binary"


def _groups(others: DataFrame, n_others: int, first: int) -> tuple[DataFrame, DataFrame, list[tuple[int, float]]]:
    """others(source, n, target) of the sources without a queue at the top, whose groups' queues there have numbers from `first` on.

    Gives (source, group, queue), (group, chain) and the totals and targets of the groups at the top.
    """
    depth = 1
    while n_others > FANOUT ** (depth + 1):
        depth += 1
    dealt = others.withColumn("group", F.pmod(F.xxhash64(F.col("source").isNull(), "source"), F.lit(FANOUT**depth)))
    members = dealt.groupBy("group").agg(F.array_sort(F.collect_list(F.struct(F.struct(F.col("source").isNull(), "source").alias("key"), "n", "target"))).alias("m"))
    levels = [written(members, "packing-groups")]  # the hash deals about FANOUT sources to a group
    for _ in range(depth - 1):
        up = levels[-1].select("group", F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"), F.aggregate("m", F.lit(0.0), lambda a, x: a + x["target"]).alias("target"))
        up = up.groupBy(F.floor(F.col("group") / FANOUT).alias("up")).agg(F.array_sort(F.collect_list(F.struct(F.col("group").alias("key"), "n", "target"))).alias("m"))
        levels.append(written(up.withColumnRenamed("up", "group"), "packing-groups"))
    sums = levels[-1].select("group", F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.aggregate("m", F.lit(0.0), lambda a, x: a + x["target"])).orderBy("group").collect()  # at most FANOUT rows
    own = lambda queue: F.struct(F.col("group").alias("id"), F.col("m.n").alias("totals"), F.col("m.target").alias("targets"), queue.cast("int").alias("queue"))
    place = F.create_map(*[F.lit(x) for k, (g, *_) in enumerate(sums) for x in (g, first + k)])
    chains = levels[-1].select("group", "m", F.array(own(place[F.col("group")])).alias("chain"))
    for below in reversed(levels[:-1]):
        above = chains.select(F.col("chain").alias("rest"), F.posexplode("m").alias("k", "x")).select("rest", "k", F.col("x.key").alias("g"))
        chains = below.join(above, below.group == above.g).select("group", "m", F.concat(F.array(own(F.col("k"))), "rest").alias("chain"))
    chains = written(chains, "packing-chains")
    queues = chains.select("group", F.posexplode("m").alias("queue", "x")).select(F.col("x.key.source").alias("source"), "group", "queue")
    return queues, chains.select("group", "chain"), [tuple(r[1:]) for r in sums]


def pack(docs: DataFrame, targets: dict[str | None, float] | None = None, size: int = 2048, tokenizer_path: str | None = None, end_id: int = 1) -> DataFrame:
    """Packs docs(doc_id, text, source) into sequences of `size` ids; only the last may be shorter.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source. A null text is empty
    and has its end id only; empty input gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    run, schema = _tokenize(tokenizer_path or vocabulary_path(), end_id)
    with small_batches(spark):
        rows = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")).mapInArrow(run, schema), "packing-ids")
    parts = written(rows.groupBy("source", "part").agg(F.sum("doc_tokens").alias("n")), "packing-queues")
    sources = written(parts.groupBy("source").agg(F.sum("n").alias("n")), "packing-sources")
    named = list((targets or {}).items())
    wanted = small_table(spark, name=pa.array([s for s, _ in named], pa.string()), target=pa.array([float(t) for _, t in named], pa.float64()), named=pa.array([True] * len(named), pa.bool_()))
    sources = sources.join(F.broadcast(wanted), sources.source.eqNullSafe(wanted.name), "left").select("source", "n", "target", F.coalesce("named", F.lit(False)).alias("named"))
    unnamed, n_unnamed = sources.where("not named").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    left = max(0.0, 1 - sum(t for _, t in named)) if named else 1.0
    sources = sources.withColumn("target", F.coalesce("target", F.lit(max(left, 1e-12) / max(unnamed, 1)) * F.col("n")))
    own = sources.where("named").collect() + sources.where("not named").orderBy(F.desc("n"), "source").limit(2 * FANOUT if n_unnamed <= 2 * FANOUT else FANOUT).collect()  # named sources, and at most 2 * FANOUT
    own.sort(key=lambda r: (-r.n, r.source is not None, r.source or ""))
    queues = [(r.n, r.target) for r in own]
    numbers = small_table(spark, name=pa.array([r.source for r in own], pa.string()), queue=pa.array(range(len(own)), pa.int32()))
    placed = sources.select("source").join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("name")), "left").select("source", F.lit(None).cast("long").alias("group"), "queue")
    chains = None
    if n_unnamed > 2 * FANOUT:
        others = sources.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("name")), "left_anti").select("source", "n", "target")
        inner, chains, groups = _groups(others, n_unnamed - FANOUT, len(own))
        placed, queues = placed.where("queue is not null").unionByName(inner), queues + groups
    top = schedule([n for n, _ in queues], [t for _, t in queues], size)
    # a source's rows here are one for each partition, not one for each document
    starts = parts.withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    at = placed.toDF("of", "group", "queue")
    starts = starts.join(at, starts.source.eqNullSafe(at.of)).select(F.col("source").alias("s"), F.col("part").alias("p"), "group", "queue", F.coalesce("base", F.lit(0)).cast("long").alias("base"))
    starts = unless_large(written(starts, "packing-starts"), BROADCAST_ROWS)
    placed = rows.join(starts, (rows.part == starts.p) & rows.source.eqNullSafe(starts.s)).select("doc_id", "source", "group", "queue", (F.col("base") + F.col("place")).alias("place"), "doc_tokens", "ids")
    if chains is None:
        placed = placed.withColumn("chain", F.lit(None).cast("array<struct<id long, totals array<long>, targets array<double>, queue int>>"))
    else:
        held = chains.withColumnRenamed("group", "g")
        held = F.broadcast(held) if held.count() <= BROADCAST_ROWS // FANOUT else held
        placed = placed.join(held, placed.group == held.g, "left")
    placed = placed.select("doc_id", "source", "queue", "place", "doc_tokens", "ids", "chain")

    def cut(batches):
        levels = Levels(top)
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            get = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
            doc, start, length, sequence, offset = levels.pieces(get("queue"), get("place"), get("doc_tokens"), batch.column("chain").to_pylist())
            raw = [memoryview(np.frombuffer(x.as_buffer(), "<u2").astype("<u4")).cast("B") for x in batch.column("ids")]
            crc = [zlib.crc32(raw[d][4 * a : 4 * (a + n)]) for d, a, n in zip(doc.tolist(), start.tolist(), length.tolist())]
            take = pa.array(doc)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(take), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()),
                    "doc_tokens": batch.column("doc_tokens").take(take), "sequence_id": pa.array(sequence), "offset": pa.array(offset), "source": batch.column("source").take(take),
                }
            )

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
