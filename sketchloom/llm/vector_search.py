"""Exact top-k search by inner product: branch and bound over a ball tree per shard.

Vectors become integers floor(scale * x). Rows are dealt to shards by a hash of their id, at most about SHARD_ROWS rows and
SHARD_CELLS components a shard. A shard holds each distinct vector once with the k + 1 smallest ids that have it, which is all that any query can
return, and builds a ball tree over them. For a query q a node with centre c and radius r can't hold a score above
q.c + |q| r; a query visits leaves in descending order of this bound and stops below its kth score so far.

First each query searches its home shard; its kth score there is shared with all other shards, which start from it and
return only what reaches it. Queries are sent to shards as rows and searched in blocks of QUERY_BLOCK, so a task holds
one shard and one block.

Rows with a null id, a null vector, or null or non-finite components, or components beyond 64 bits after scaling, take no
part. Vectors of different lengths are never compared. Ties go to the smaller id. Rows with the query's id are never its
neighbours; each other row counts, repeated or not. A query id that occurs in several rows is one query, of the vector with
the least (length, bytes). A score beyond 64 bits raises OverflowError. Extra columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.llm.staging import written

SHARD_ROWS = 1 << 16
SHARD_CELLS = 1 << 22
MIN_SHARDS = 24
LEAF_ROWS = 64
QUERY_BLOCK = 1024
NONE = np.iinfo(np.int64).min


class BallTree:
    """Nodes in arrays; leaves cover runs of the reordered vectors."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.arange(len(vectors))
        points = vectors.astype(np.float64)
        self.children: list[tuple[int, int]] = []
        self.span: list[tuple[int, int]] = []
        centers, radii = [], []
        todo = [(0, len(vectors), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node = len(self.span)
            if parent >= 0:
                pair = list(self.children[parent])
                pair[side] = node
                self.children[parent] = tuple(pair)
            x = points[self.order[a:b]]
            center = x.mean(axis=0)
            centers.append(center)
            radii.append(np.sqrt(((x - center) ** 2).sum(axis=1).max()))
            self.span.append((a, b))
            self.children.append((-1, -1))
            if b - a > LEAF_ROWS:
                far = x[((x - center) ** 2).sum(axis=1).argmax()]
                other = x[((x - far) ** 2).sum(axis=1).argmax()]
                along = x @ (far - other)
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(along, middle)]
                todo += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        self.centers, self.radii = np.array(centers), np.array(radii)

    def leaf_bounds(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, bound) of the leaves that may reach the queries' least scores, found from the root down."""
        norm = np.sqrt((queries**2).sum(axis=1))
        slack = 1e-9 * (1 + norm * (np.sqrt((self.centers**2).sum(axis=1)) + self.radii).max())
        out, who, node = [], np.arange(len(queries)), np.zeros(len(queries), np.int64)
        children = np.array(self.children)
        while len(who):
            bound = np.einsum("ij,ij->i", queries[who], self.centers[node]) + norm[who] * self.radii[node] + slack[who]
            live = bound >= least[who]
            who, node, bound = who[live], node[live], bound[live]
            leaf = children[node, 0] < 0
            out.append((who[leaf], node[leaf], bound[leaf]))
            inner = children[node[~leaf]]
            who, node = np.repeat(who[~leaf], 2), inner.reshape(-1)
        return tuple(np.concatenate(x) for x in zip(*out))


class Shard:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        rank = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[rank], vectors[rank]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        place = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
        kept = place <= k  # an id may be the query's own, which takes one place
        self.k, self.ids = k, ids[kept]
        owner = np.cumsum(new)[kept] - 1
        self.at = np.searchsorted(owner, np.arange(len(first) + 1))
        self.vectors = vectors[first]
        self.tree = BallTree(self.vectors)
        self.largest = int(np.abs(self.vectors).max(initial=0))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, score) of up to k rows per query that reach its least score, best first."""
        most = self.largest * int(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
        kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
        q, v = queries.astype(kind), self.vectors.astype(kind)
        kth = least.copy()
        who, leaf, bound = self.tree.leaf_bounds(queries.astype(np.float64), kth.astype(np.float64))
        rank = np.lexsort((-bound, who))
        who, leaf, bound = who[rank], leaf[rank], bound[rank]
        begin = np.searchsorted(who, np.arange(len(queries) + 1))
        turn = np.arange(len(who)) - begin[who]
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        low, step = 0, 1
        while True:
            now = (turn >= low) & (turn < low + step) & (bound >= kth[who])
            if not now.any():
                if not ((turn >= low + step) & (bound >= kth[who])).any():
                    break
                low, step = low + step, step * 2
                continue
            found = [best]
            order = np.flatnonzero(now)[np.argsort(leaf[now], kind="stable")]
            cuts = np.flatnonzero(np.diff(leaf[order], prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows = who[order[a:b]]
                lo, hi = self.tree.span[leaf[order[a]]]
                members = self.tree.order[lo:hi]
                scores = (q[rows] @ v[members].T).astype(np.int64)
                i, j = np.nonzero(scores >= kth[rows][:, None])
                score, i, j = scores[i, j], rows[i], members[j]
                many = self.at[j + 1] - self.at[j]
                pick = np.repeat(self.at[j], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                i, score, ids = np.repeat(i, many), np.repeat(score, many), self.ids[pick]
                other = ids != query_ids[i]
                found.append((i[other], ids[other], score[other]))
            i, ids, score = (np.concatenate(x) for x in zip(*found))
            rank = np.lexsort((ids, -score, i))
            i, ids, score = i[rank], ids[rank], score[rank]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            keep = place < self.k
            best = (i[keep], ids[keep], score[keep])
            full = place == self.k - 1
            kth[i[full]] = np.maximum(kth[i[full]], score[full])
            low, step = low + step, step * 2
        return best


def _integers(scale: int):
    def run(batches):
        for batch in batches:
            vectors = batch.column("vector").cast(pa.list_(pa.float64()))
            ends, values = vectors.offsets.to_numpy(), vectors.values
            with np.errstate(over="ignore", invalid="ignore"):
                y = np.floor(values.to_numpy(zero_copy_only=False) * scale)  # nulls become nan
                bad = ~np.isfinite(y) | (np.abs(y) >= 2.0**63)
            bad[values.is_null().to_numpy(zero_copy_only=False)] = True
            out = np.diff(np.concatenate([[0], np.cumsum(bad)])[ends]) > 0
            keep = batch.column("id").is_valid().to_numpy(zero_copy_only=False) & vectors.is_valid().to_numpy(zero_copy_only=False) & ~out
            y[bad] = 0
            top = np.abs(y).max(initial=0)
            width = 2 if top < 2**15 else 4 if top < 2**31 else 8
            raw = pa.Array.from_buffers(pa.large_binary(), len(keep), [None, pa.py_buffer(ends.astype(np.int64) * width), pa.py_buffer(y.astype(f"<i{width}"))]).cast(pa.binary())
            columns = [batch.column("id"), pa.array(np.diff(ends), pa.int32()), raw]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "dim", "vector"]).filter(pa.array(keep))

    return run


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    if len({len(b) for b in blobs}) == 1 and dim:
        return np.frombuffer(b"".join(blobs), f"<i{len(blobs[0]) // dim}").reshape(len(blobs), dim).astype(np.int64)
    return np.array([np.frombuffer(b, f"<i{len(b) // dim}") if dim else [] for b in blobs], dtype=np.int64).reshape(len(blobs), dim)


def _search(k: int):
    """Rows come sorted by (dim, shard, kind): a shard's vectors, then its queries."""

    def run(batches):
        key, ids, blobs, shard, asked = None, [], [], None, []

        def answer():
            nonlocal shard, ids, blobs, asked
            if not asked:
                return None
            if shard is None:
                if not ids:
                    asked = []
                    return None
                shard = Shard(np.array(ids, np.int64), _matrix(blobs, key[0]), k)
                ids, blobs = [], []
            query_ids, vectors, least = zip(*asked)
            query_ids, asked = np.array(query_ids, np.int64), []
            who, found, score = shard.search(query_ids, _matrix(list(vectors), key[0]), np.array(least, np.int64))
            return pa.RecordBatch.from_pydict({"query_id": pa.array(query_ids[who]), "id": pa.array(found), "score": pa.array(score)})

        for batch in batches:
            for dim, number, kind, i, vector, least in zip(*(batch.column(c).to_pylist() for c in ("dim", "shard", "kind", "id", "vector", "least"))):
                if (dim, number) != key:
                    if (out := answer()) is not None:
                        yield out
                    key, ids, blobs, shard, asked = (dim, number), [], [], None, []
                if kind == 0:
                    ids.append(i)
                    blobs.append(vector)
                else:
                    asked.append((i, vector, NONE if least is None else least))
                    if len(asked) == QUERY_BLOCK and (out := answer()) is not None:
                        yield out
        if (out := answer()) is not None:
            yield out

    return run


def top_k(vectors: DataFrame, id_column: str, vector_column: str, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), id, score of the k best rows for each query; is_query is over the columns id and vector."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    rows = written(rows.mapInArrow(_integers(scale), "id long, dim int, vector binary"), "search-vectors")
    n, cells = rows.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    shards = max(MIN_SHARDS, -(-n // SHARD_ROWS), -(-cells // SHARD_CELLS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    queries = rows.where(is_query).groupBy("id", "shard").agg(F.min(F.struct("dim", "vector")).alias("v")).select("id", "shard", "v.dim", "v.vector")
    shape = "query_id long, id long, score long"

    def searched(asked: DataFrame) -> DataFrame:
        both = rows.select("dim", "shard", F.lit(0).alias("kind"), "id", "vector", F.lit(None).cast("long").alias("least")).unionByName(asked.withColumn("kind", F.lit(1)))
        return both.repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "kind", "id").mapInArrow(_search(k), shape)

    at_home = written(searched(queries.select("dim", "shard", "id", "vector", F.lit(None).cast("long").alias("least"))), "search-home")
    shared = at_home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    others = queries.join(shared, queries.id == shared.query_id, "left").select("dim", "id", "vector", "least", F.col("shard").alias("home"))
    others = others.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home").drop("home")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return at_home.union(searched(others)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
