"""A Merkle manifest of a dataset, with leaf coordinates from bitmap ranks.

Every row is a leaf: the SHA-256 of its fields. Leaves of one language stand in order of doc_id, and their places come
without sorting them: tasks set a bit for every doc_id in the compressed bitmap of its language (the words of 64 bits that
aren't zero, merged by OR), popcount directories over 2**16 words, 2**16 of those and so on give the number of ids before
each word, and the rank of an id is that number plus the popcount of the bits below its own. Ids that occur more than once
in a language are ranked in bitmaps of their own, by the leading bits of their leaves, so that equal ids stand in order
of leaf; rows equal in all fields have equal leaves and take places one after another.

A leaf's place says into which array of 4096 slots it goes and where; a task fills an array and reduces four levels of
eight nodes at once. Arrays of their results follow until a language has one node, its subroot, and the subroots are
reduced the same way. Paths come down again: an array's task knows the siblings above it from the array before.

Defined results: a null field is `-`; null doc_ids stand before all others; an array of one node takes part in no hash of
its own unless its level has more nodes; null doc_ids have no decimal form and are not tampered with; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.llm.staging import released, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8  # nodes of one hash
LEVELS = 4  # of one array
SLOTS = FAN**LEVELS
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, part (`-` for a null language, else `=` and the language, so that text order is the order of subroots), leaf, tampered (the leaf of the changed row, or null)."""
    digest = lambda text: F.sha2(F.concat(*[_field(F.col(c)) for c in FIELDS[:-1]], _field(text)).cast("binary"), 256)
    changes = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
    part = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), digest(F.col("text")).alias("leaf"), F.when(changes, digest(F.translate("text", _UPPER, _LOWER))).alias("tampered"))


def directory(entries: DataFrame, group: list[str], digits: list[str]) -> DataFrame:
    """entries(*group, *digits, rows), one row for each -> with before (the group's rows in smaller entries) and total (the group's rows).

    Digits go from the highest to the lowest. A digit's counts are summed up from those of the next one, and what stands
    before an entry is what stands before its parent and before itself under it, so no window holds more than the values of
    one digit.
    """
    levels = [entries]
    for k in range(len(digits) - 1, 0, -1):
        levels.append(levels[-1].groupBy(*group, *digits[:k]).agg(F.sum("rows").alias("rows")))
    known = None
    for k, level in enumerate(reversed(levels), 1):
        parent = [*group, *digits[: k - 1]]
        own = level.withColumn("own", F.sum("rows").over(Window.partitionBy(*parent).orderBy(digits[k - 1])) - F.col("rows"))
        if known is None:
            known = own.withColumn("total", F.sum("rows").over(Window.partitionBy(*group))).withColumnRenamed("own", "before")
        else:
            known = own.join(known.select(*parent, F.col("before").alias("above"), "total"), parent).withColumn("before", F.col("own") + F.col("above")).drop("own", "above")
    return known


def _word_digits(word: Column) -> list[Column]:
    return [F.shiftrightunsigned(word, 16 * k).bitwiseAND(F.lit(0xFFFF)).cast("int").alias(f"w{k}") for k in (3, 2, 1, 0)]


def places(leaf: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """leaves() -> part, doc_id, leaf, tampered, copies, place (of the first copy), n (leaves of the part); and staged tables to release."""
    key = F.coalesce("doc_id", F.lit(0).cast("long")).bitwiseXOR(F.lit(-(2**63)))  # unsigned order of these is the order of ids
    one = leaf.groupBy("part", "doc_id", "leaf", "tampered").agg(F.count("*").alias("copies"))
    one = one.withColumn("known", F.col("doc_id").isNotNull().cast("int")).withColumn("word", F.shiftrightunsigned(key, 6)).withColumn("low", key.bitwiseAND(F.lit(63)).cast("int"))
    one = written(one, "merkle-leaves")
    shifted = lambda x, c: F.call_function("shiftleft", F.lit(x).cast("long"), F.col(c))
    of = ["part", "known", "word"]
    words = written(one.groupBy(*of).agg(F.bit_or(shifted(1, "low")).alias("bits"), F.sum("copies").alias("rows")), "merkle-words")
    counted = directory(words.select(*of, *_word_digits(F.col("word")), "rows"), ["part"], ["known", "w3", "w2", "w1", "w0"])
    index = words.withColumn("single", F.col("rows") == F.bit_count("bits")).join(counted.select(*of, "before", F.col("total").alias("n")), of)
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(shifted(-1, "low"))))
    keyed = written(one.join(index, of).select(*of, "low", "doc_id", "leaf", "tampered", "copies", "n", "single", "before", below.alias("below")), "merkle-ranked")
    columns = ["part", "doc_id", "leaf", "tampered", "copies", "n"]
    alone = keyed.where("single").select(*columns, (F.col("before") + F.col("below")).alias("place"))
    # words with repeated ids: places within the word by id and by the leading digits of the leaf, then by the rest of it
    lead = [f"l{k}" for k in range(4)]
    tied = keyed.where("not single").drop("below").select("*", *[F.conv(F.substring("leaf", 4 * k + 1, 4), 16, 10).cast("int").alias(lead[k]) for k in range(4)])
    entries = tied.groupBy(*of, "low", *lead).agg(F.sum("copies").alias("rows"))
    inside = directory(entries, of, ["low", *lead]).select(*of, "low", *lead, F.col("before").alias("inside"))
    rest = F.sum("copies").over(Window.partitionBy(*of, "low", *lead).orderBy("leaf")) - F.col("copies")
    tied = tied.join(inside, [*of, "low", *lead]).select(*columns, (F.col("before") + F.col("inside") + rest).alias("place"))
    return alone.unionByName(tied), [one, words, keyed]


def each_copy(placed: DataFrame) -> DataFrame:
    """A row for each copy, at its own place; many copies of one row are dealt to tasks in runs of SLOTS."""
    last = F.col("copies") - 1
    few = placed.where(F.col("copies") <= SLOTS).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    runs = placed.where(F.col("copies") > SLOTS).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / SLOTS)))).repartition("part", "place", "run")
    many = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * SLOTS, F.least(last, F.col("run") * SLOTS + SLOTS - 1)))).drop("run")
    return few.unionByName(many).withColumn("place", F.col("place") + F.col("copy")).drop("copy", "copies")


def height(n: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _joined(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def reduced(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of an array and those of each level above them."""
    out = [nodes]
    for _ in range(levels):
        nodes = [_joined(nodes[k : k + FAN]) for k in range(0, len(nodes), FAN)]
        out.append(nodes)
    return out


def siblings(levels: list[list[bytes]], slot: int) -> list[tuple[int, list[bytes]]]:
    """For each level but the last: a node's place in its run and the run's others."""
    out = []
    for nodes in levels[:-1]:
        run = nodes[slot - slot % FAN : slot - slot % FAN + FAN]
        at = slot % FAN
        out.append((at, run[:at] + run[at + 1 :]))
        slot //= FAN
    return out


def packed(path: list[tuple[int, list[bytes]]]) -> bytes:
    """A path as text: per level the place, then the others' digests."""
    return b";".join(b"%d" % at + b"".join(others) for at, others in path)


def unpacked(path: bytes) -> list[tuple[int, list[bytes]]]:
    return [(int(x[:1]), [x[k : k + 64] for k in range(1, len(x), 64)]) for x in path.split(b";")] if path else []


def folded(node: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    for at, others in path:
        node = _joined([*others[:at], node, *others[at:]])
    return node


def _slots(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """An array's nodes by slot."""
    slot = table.column("slot").to_numpy()
    nodes: list[bytes] = [b""] * len(slot)
    for at, node in zip(slot.tolist(), table.column("node").to_pylist()):
        nodes[at] = node.encode()
    return nodes, slot


def _up(table: pa.Table) -> pa.Table:
    """An array of nodes -> the node it comes to."""
    nodes, _ = _slots(table)
    levels = min(LEVELS, height(table.column("n")[0].as_py()))
    return pa.table({"part": table.column("part")[:1], "place": table.column("array")[:1], "node": pa.array([reduced(nodes, levels)[-1][0].decode()]), "n": pa.array([-(-table.column("n")[0].as_py() // SLOTS)], pa.int64())})


def _arrays(nodes: DataFrame) -> DataFrame:
    """part, place, node, n with the array and the slot of each node."""
    return nodes.withColumn("array", F.shiftrightunsigned("place", 3 * LEVELS)).withColumn("slot", F.col("place").bitwiseAND(F.lit(SLOTS - 1)).cast("int"))


NODES = "part string, place long, node string, n long"


def tree(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """nodes(part, place, node, n) -> (part, node) of each part's root, and the nodes of each step, arrays of arrays: the first is the input."""
    steps = [nodes]
    while True:
        now = steps[-1]
        above = written(_arrays(now.where("n > 1")).groupBy("part", "array").applyInArrow(_up, NODES), "merkle-nodes")
        steps.append(above)
        if not above.where("n > 1").limit(1).count():
            break
    roots = steps[0].where("n = 1")
    for k in range(1, len(steps)):
        roots = roots.unionByName(steps[k].where("n = 1"))
    return roots.select("part", "node"), steps


def _down(table: pa.Table) -> pa.Table:
    """An array's nodes with the siblings from each up to the root; the row of kind 1 has the path above the array."""
    kind = table.column("kind").to_numpy()
    own, head = table.filter(pa.array(kind == 0)), table.filter(pa.array(kind == 1))
    above = head.column("path")[0].as_py().encode()
    nodes, slot = _slots(own)
    levels = reduced(nodes, min(LEVELS, height(own.column("n")[0].as_py())))
    found = [b";".join(x for x in (packed(siblings(levels, s)), above) if x).decode() for s in slot.tolist()]
    return pa.table({"part": own.column("part"), "place": own.column("place"), "path": pa.array(found, pa.string())})


def _node_paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """nodes, and part, place, path of the arrays that they make -> part, place, path of the nodes."""
    rows = _arrays(nodes).select("part", "array", "slot", "place", "node", "n", F.lit("").alias("path"), F.lit(0).alias("kind"))
    heads = above.select("part", F.col("place").alias("array"), F.lit(0).alias("slot"), F.lit(0).cast("long").alias("place"), F.lit("").alias("node"), F.lit(0).cast("long").alias("n"), "path", F.lit(1).alias("kind"))
    return rows.unionByName(heads).groupBy("part", "array").applyInArrow(_down, "part string, place long, path string")


def paths(steps: list[DataFrame], top: DataFrame) -> DataFrame:
    """From the last step down: part, place, path of the arrays of the first step. top(part, path) has what stands above a part's root."""
    at_root = lambda nodes: nodes.where("n = 1").select("part", "place").join(top, "part")
    known = at_root(steps[-1])  # nothing else is left there
    for nodes in steps[-2:0:-1]:
        known = _node_paths(nodes.where("n > 1"), known).unionByName(at_root(nodes))
    return known.unionByName(at_root(steps[0]))  # a lone node is its array


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(table: pa.Table) -> pa.Table:
    """An array of leaves, its path and its roots -> a row for each leaf."""
    kind = table.column("kind").to_numpy()
    own, head = table.filter(pa.array(kind == 0)), table.filter(pa.array(kind == 1))
    above_text = head.column("path")[0].as_py().encode()
    subroot, root = head.column("subroot")[0].as_py(), head.column("root")[0].as_py()
    nodes, slot = _slots(own)
    levels = reduced(nodes, min(LEVELS, height(own.column("n")[0].as_py())))
    above = unpacked(above_text)
    high = b"".join(x for _, others in above for x in others)
    ends: dict[bytes, bytes] = {}  # most leaves of an array fold to one node of it, and that to one root
    proofs, folds = [], []
    for s, changed in zip(slot.tolist(), own.column("tampered").to_pylist()):
        path = siblings(levels, s)
        proof = hashlib.sha256(b"".join([x for _, others in path for x in others]))
        proof.update(high)
        proofs.append(proof.hexdigest())
        node = folded(changed.encode() if changed else nodes[s], path)
        if node not in ends:
            end = folded(node, above)
            if len(ends) < 2:
                ends[node] = end
            folds.append(end.decode())
        else:
            folds.append(ends[node].decode())
    m = len(slot)
    return pa.table({"doc_id": own.column("doc_id"), "leaf": own.column("node"), "subroot": pa.array([subroot] * m), "root": pa.array([root] * m), "proof_sha256": pa.array(proofs), "folded_root": pa.array(folds), "verified": pa.array([f == root for f in folds])})


def _numbered(parts: DataFrame) -> DataFrame:
    """part, place of the distinct parts in text order: places within range partitions plus what lies before them."""
    ordered = written(parts.repartitionByRange("part").sortWithinPartitions("part").withColumn("slice", F.spark_partition_id()), "merkle-parts")
    sizes = ordered.groupBy("slice").agg(F.count("*").alias("m"))
    before = sizes.withColumn("before", F.sum("m").over(Window.orderBy("slice")) - F.col("m")).select("slice", "before")  # a row for each partition of the sort
    place = F.row_number().over(Window.partitionBy("slice").orderBy("part")) - 1 + F.col("before")
    return ordered.join(before, "slice").select("part", place.cast("long").alias("place"))


def manifest(docs: DataFrame) -> DataFrame:
    """docs -> per row doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    placed, spare = places(leaves(docs))
    rows = written(each_copy(placed).select("part", "place", F.col("leaf").alias("node"), "n", "doc_id", "tampered"), "merkle-places")
    released(*spare)
    subroots, steps = tree(rows.select("part", "place", "node", "n"))
    subroots = written(subroots, "merkle-subroots")
    langs = written(subroots.join(_numbered(subroots.select("part")), "part").select(F.col("part").alias("lang"), "place", "node"), "merkle-langs")
    upper = langs.select(F.lit("").alias("part"), "place", "node", F.lit(langs.count()).cast("long").alias("n"))
    root, high = tree(upper)
    root = root.first()  # one node, none of an empty table
    start = docs.sparkSession.range(1).select(F.lit("").alias("part"), F.lit("").alias("path"))
    top = written(_node_paths(upper, paths(high, start)).join(langs, "place").select(F.col("lang").alias("part"), "path"), "merkle-tops")
    above = paths(steps, top).join(subroots.withColumnRenamed("node", "subroot"), "part")
    held = _arrays(rows).select("part", "array", "slot", "node", "n", "doc_id", "tampered", F.lit(0).alias("kind"), *[F.lit(None).cast("string").alias(c) for c in ("path", "subroot", "root")])
    heads = above.select("part", F.col("place").alias("array"), F.lit(0).alias("slot"), F.lit("").alias("node"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("tampered"), F.lit(1).alias("kind"), "path", "subroot", F.lit(root and root.node).cast("string").alias("root"))
    out = written(held.unionByName(heads).groupBy("part", "array").applyInArrow(_proofs, PROOFS), "merkle-manifest")
    released(rows, subroots, langs, top, *steps[1:], *high[1:])
    return out
