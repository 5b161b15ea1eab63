"""Exact top-k search (operator 3): tiled matrix products, a partial selection in each tile, and a tree of merges.

Queries of up to GROUP_BYTES are broadcast as one matrix, and every partition of vectors is a run of shards. More queries
are dealt to tiles of about that size and the vectors to runs, and each pair of a tile and a run is a task, which holds
the tile and streams the run; nothing passes the driver. A shard meets each QUERY_TILE queries in one matrix product. A task
keeps one top list a query, so it emits at most k rows a query. Lists of up to FAN tasks are merged at a time,
level by level, so that no task ever holds more than FAN * k rows of a query.

Products are exact: tiles whose products stay under 2**24 use float32, under 2**52 float64, and beyond that
Python integers. Equal scores go to the smaller id.

Defined results: vectors that are null, or hold null or non-finite components, and rows with a null id take no
part; vectors of another length than the query's are no candidates; a repeated query row has a list of its own;
repeated candidate rows count each; a query never meets rows of its own id; scores beyond a long are clipped to
it; no vectors, no rows. Only the id, vector and query columns are read, so other columns cannot clash. Vectors of any
length are handled; a tile holds at least one query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP_BYTES = 32 << 20
QUERY_TILE, SHARD = 512, 8192
FAN = 16


def _floored(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(vectors.astype(np.float64) * scale)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """q @ c.T exactly, as float64 where all sums are under 2**52 and else as integers of any size."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if bound < 1 << 24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    if bound < 1 << 52:
        return q @ c.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return whole(q) @ whole(c).T


def tile_top(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of c (ids ascending) for each of q: scores and ids, best first, and the number that count."""
    s, n = _products(q, c), len(c_ids)
    lo, hi = np.searchsorted(c_ids, q_ids, "left"), np.searchsorted(c_ids, q_ids, "right")
    count = np.minimum(k, n - (hi - lo))
    k = min(k, n)
    if s.dtype == object or np.abs(s).max(initial=0) * n >= 1 << 52:
        top = np.zeros((len(q), k), dtype=np.int64)
        limit = (1 << 63) - 1
        best = np.zeros((len(q), k), dtype=np.int64)
        for i, row in enumerate(s):
            order = [j for j in sorted(range(n), key=lambda j: (-row[j], j)) if not lo[i] <= j < hi[i]][:k]
            top[i, : len(order)] = order
            best[i, : len(order)] = [max(-limit - 1, min(limit, int(row[j]))) for j in order]
        return best, c_ids[top], count
    key = s * n + np.arange(n - 1, -1, -1)
    for i in np.flatnonzero(hi > lo):
        key[i, lo[i] : hi[i]] = -np.inf
    if k < n:
        key = np.partition(key, n - k, axis=1)[:, n - k :]
    key = -np.sort(-key, axis=1)
    key = np.where(np.isinf(key), 0, key).astype(np.int64)
    return key // n, c_ids[n - 1 - key % n], count


def _merge(a: tuple, b: tuple, k: int) -> tuple:
    scores, ids = np.concatenate([a[0], b[0]], axis=1), np.concatenate([a[1], b[1]], axis=1)
    used = np.concatenate([np.arange(x[0].shape[1]) < x[2][:, None] for x in (a, b)], axis=1)
    order = np.lexsort((ids, -scores, ~used), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1), np.minimum(k, a[2] + b[2])


class _Search:
    """Queries (numbers, ids, vectors) by length, and the top lists of the vectors that they have met."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, vectors: pa.Array, scale: float):
        self.scale, self.lists, self.groups = scale, {}, []
        sizes, flat, ends = _flat(vectors)
        for dim in map(int, np.unique(sizes)):
            own = np.flatnonzero(sizes == dim)
            self.groups.append((dim, numbers[own], ids[own], _floored(flat[(ends[own] - dim)[:, None] + np.arange(dim)], scale)))

    def meet(self, ids: np.ndarray, vectors: pa.Array, k: int) -> None:
        sizes, flat, ends = _flat(vectors)
        for g, (dim, _, q_ids, q) in enumerate(self.groups):
            own = np.flatnonzero(sizes == dim)
            if not len(own):
                continue
            own = own[np.argsort(ids[own], kind="stable")]
            c = _floored(flat[(ends[own] - dim)[:, None] + np.arange(dim)], self.scale)
            for t in range(0, len(q_ids), QUERY_TILE):
                new = tile_top(q[t : t + QUERY_TILE], q_ids[t : t + QUERY_TILE], c, ids[own], k)
                self.lists[g, t] = _merge(self.lists[g, t], new, k) if (g, t) in self.lists else new

    def rows(self, task: int) -> Iterator[pa.RecordBatch]:
        for (g, t), (scores, found, count) in self.lists.items():
            _, numbers, q_ids, _ = self.groups[g]
            used = np.arange(scores.shape[1]) < count[:, None]
            rows = np.nonzero(used)[0] + t
            cols = [numbers[rows], q_ids[rows], found[used], scores[used], np.full(len(rows), task, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, dtype=np.int64)) for x in cols], names=["number", "query_id", "vec_id", "score", "task"])
        self.lists = {}


def _flat(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.asarray(vectors.value_lengths())
    return sizes, np.asarray(vectors.flatten()), np.cumsum(sizes)


def _searcher(shared, k: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, vectors = shared.value
        search, part = _Search(numbers, ids, vectors, scale), 0
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                shard = batch.slice(at, SHARD)
                part = shard.column("part")[0].as_py()
                search.meet(np.asarray(shard.column("id")), shard.column("vector"), k)
        yield from search.rows(part)

    return run


def _block_searcher(k: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One block, or several in turn: the queries of a tile (number not null), then the vectors of a run."""
        block, queries, search = None, [], None
        for batch in batches:
            blocks, asks = np.asarray(batch.column("block")), np.asarray(batch.column("number").is_valid())
            cuts = np.concatenate([[0], np.flatnonzero((blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1, [batch.num_rows]]) if batch.num_rows else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if blocks[a] != block:
                    if search:
                        yield from search.rows(block)
                    block, queries, search = int(blocks[a]), [], None
                if asks[a]:
                    queries.append(batch.slice(a, b - a))
                    continue
                if search is None:
                    held = pa.Table.from_batches(queries).combine_chunks() if queries else None
                    columns = [held.column(c).chunk(0) for c in ("number", "id", "vector")] if queries else None
                    search = _Search(np.asarray(columns[0]), np.asarray(columns[1]), columns[2], scale) if queries else _Search(np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.list_(pa.float64())), scale)
                for at in range(a, b, SHARD):
                    part = batch.slice(at, min(SHARD, b - at))
                    search.meet(np.asarray(part.column("id")), part.column("vector"), k)
        if search:
            yield from search.rows(block)

    return run


_FOUND = "number long, query_id long, vec_id long, score long, task long"


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id: str = "vec_id", vector: str = "embedding", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row where is_query holds, its k best other rows."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    good = good.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite))
    queries = good.where("is_query").select("id", "vector")
    size = lambda df: F.coalesce(F.sum(8 * F.size(df["vector"]) + 16), F.lit(0))
    asked = queries.agg(size(queries)).first()[0]
    if asked <= group_bytes:
        rows = queries.toArrow()
        ids, lists = np.asarray(rows.column("id")), pa.chunked_array(rows.column("vector").chunks, pa.list_(pa.float64())).combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.array([], pa.list_(pa.float64()))
        shared = vectors.sparkSession.sparkContext.broadcast((np.arange(len(ids)), ids, lists))
        shards = good.select("id", "vector", F.spark_partition_id().cast("long").alias("part"))
        found, tasks = shards.mapInArrow(_searcher(shared, k, scale), _FOUND), shards.rdd.getNumPartitions()
    else:
        tiles = math.ceil(1.2 * asked / group_bytes)
        # a run is about four tiles, unless that would leave cores idle
        runs = max(1, math.ceil(good.agg(size(good)).first()[0] / (4 * group_bytes)), math.ceil(vectors.sparkSession.sparkContext.defaultParallelism / tiles))
        dealt = lambda df, n: F.pmod(F.xxhash64(df["id"], F.spark_partition_id()), F.lit(n))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = queries.withColumn("number", F.monotonically_increasing_id()).withColumn("tile", dealt(queries, tiles)).withColumn("run", every(runs))
        right = good.select("id", "vector", F.lit(None).cast("long").alias("number")).withColumn("run", dealt(good, runs)).withColumn("tile", every(tiles))
        block = (F.col("tile") * runs + F.col("run")).cast("int").alias("block")
        both = left.select(block, "number", "id", "vector").unionAll(right.select(block, "number", "id", "vector"))
        both = both.repartitionById(tiles * runs, F.col("block")).sortWithinPartitions("block", F.desc_nulls_last("number"))
        found = both.mapInArrow(_block_searcher(k, scale), _FOUND).withColumn("task", F.pmod("task", F.lit(runs)))
        tasks = runs
    best = [F.desc("score"), F.asc("vec_id")]
    while tasks > FAN:
        found = found.withColumn("task", F.floor(F.col("task") / FAN))
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("number", "task").orderBy(*best))).where(F.col("r") <= k).drop("r")
        tasks = math.ceil(tasks / FAN)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*best))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
