"""Exact top-k search by no-random-access aggregation of sorted lists.

Each dimension of a block of candidates is one list, sorted once, when the block
is written.  A query reads the list of dimension d from its top when its own
component is positive and from its end when it is negative, so what it reads
contributes less and less.  After each page a place has a lower bound (what was
read of it, and the least each unread list can still give) and an upper bound
(what was read, and the last value read of each other list).  A place whose
upper bound is under the k-th best lower bound, or under the k-th best score of
the blocks a task has searched before, is out; bounds are taken only of places
that are still in for some query.  Reading stops for a query once few places are
left; their scores are then resolved.

Candidates stay in the partitions they were written in.  Queries are sent to
them in portions of bounded size, each a pass over the candidates, and a task
hands on its k best for each query.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sweeplens.llm.shared import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK, QUERIES = 4096, 512  # rows of a candidate block and of a query block
PAGES = (0.06, 0.12, 0.2, 0.3, 0.45, 0.65)  # shares of the lists read after each page
FEW = 0.01  # a query stops reading when this share of a block is left
PORTION = 16 << 20  # bytes of query vectors that are sent to the tasks at a time
EXACT = float(2**53)

_BLOCK_SCHEMA = "dim int, ids binary, data binary, lists binary"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, factor: int = 256) -> DataFrame:
    """``id`` and ``v = floor(factor * x)`` as bigints; unusable vectors are left out.

    Unusable: a null id, a null or empty vector, or one that holds null or
    non-finite components.  A finite component beyond 2**62 fails the job.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double") * factor)
    finite = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
                      & (F.abs(c.cast("double")) != float("inf")))
    fits = F.forall(x, lambda c: F.abs(c) < float(2**62))
    x = F.when(fits, x).otherwise(F.raise_error(F.lit("a component is too large for a 64-bit integer")).cast("array<double>"))
    usable = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()
                           & F.coalesce(finite, F.lit(False)) & (F.size(vector_col) > 0))
    return usable.select(F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(c)).alias("v"))


def _pack(rows: int):
    """Blocks of vectors of one length: ids, vectors, and the order of each dimension's list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dim", "ids", "data", "lists"]
        held: dict[int, list] = {}

        def block(dim: int):
            ids = np.concatenate([i for i, _ in held[dim]])
            data = np.concatenate([m for _, m in held[dim]])
            for at in range(0, len(ids), rows):
                part, vectors = ids[at: at + rows], data[at: at + rows]
                order = np.argsort(vectors, axis=0, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (
                        part.astype("<i8"), vectors.astype("<i8"), order.astype("<i4")))], names=names)

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = pa.compute.list_value_length(lists).to_numpy()
            flat = lists.flatten().to_numpy()
            first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                held.setdefault(int(dim), []).append((ids[own], flat[first[own][:, None] + np.arange(dim)]))
                if sum(len(i) for i, _ in held[int(dim)]) >= rows:
                    yield from block(int(dim))
                    held[int(dim)] = []
        for dim, parts in held.items():
            if parts:
                yield from block(dim)

    return run


class Lists:
    """A block's sorted lists: the vectors, each list in ascending order, and each place's rank in each list."""

    def __init__(self, vectors: np.ndarray, order: np.ndarray):
        self.vectors = vectors
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.broadcast_to(np.arange(len(order), dtype=order.dtype)[:, None], order.shape), axis=0)
        self.ascending = np.take_along_axis(vectors, order, axis=0)


def nra(queries: np.ndarray, lists: Lists, k: int, own: np.ndarray | None = None, floor: np.ndarray | None = None,
        pages: tuple[float, ...] = PAGES) -> tuple[list[np.ndarray], int]:
    """Per query: places of the block that can be among its ``k`` best, and how many places of each list were read.

    ``own[q, i]`` marks pairs that take no part; ``floor`` has scores that a place
    must reach to matter.  Every place is returned whose score reaches both the
    floor and the k-th best of the block.
    """
    block = lists.vectors
    n = len(block)
    floor = np.full(len(queries), -np.inf) if floor is None else floor
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    result: list[np.ndarray] = [np.arange(n)] * len(queries)
    left, live = np.arange(len(queries)), np.arange(n)
    alive = np.ones((len(queries), n), dtype=bool) if own is None else ~own
    read = 0
    for depth in [0, *(max(1, int(n * share)) for share in pages)]:
        if depth >= n or not left.size:
            break
        read = depth
        top, low = lists.ascending[n - max(depth, 1)], lists.ascending[max(depth, 1) - 1]
        here, rank = block[live], lists.rank[live]
        high_seen, low_seen = rank >= n - depth, rank < depth
        upper = up[left] @ np.where(high_seen, here, top).T + down[left] @ np.where(low_seen, here, low).T
        best = floor[left]
        if depth and live.size >= k:
            lower = up[left] @ np.where(high_seen, here, lists.ascending[0]).T + down[left] @ np.where(low_seen, here, lists.ascending[-1]).T
            lower[~alive] = -np.inf
            best = np.maximum(best, np.partition(lower, live.size - k, axis=1)[:, live.size - k])
        alive &= upper >= best[:, None]
        done = alive.sum(axis=1) <= max(2 * k, FEW * n)
        for at in np.flatnonzero(done):
            result[left[at]] = live[alive[at]]
        left, alive = left[~done], alive[~done]
        some = alive.any(axis=0)
        live, alive = live[some], alive[:, some]
    for at, query in enumerate(left):
        result[query] = live[alive[at]]
    return result, read


def _merge(best: tuple, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of two lists of (ids, scores), ties to the smaller id."""
    ids, scores = np.concatenate((best[0], ids)), np.concatenate((best[1], scores))
    keep = np.lexsort((ids, -scores))[:k]
    return ids[keep], scores[keep]


def _search(portion, k: int):
    """The ``k`` best of a task's candidates for each query of a portion."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = {dim: (np.frombuffer(i, "<i8"), np.frombuffer(v, "<i8").reshape(-1, dim)) for dim, i, v in portion.value}
        none = np.empty(0, np.int64)
        best = {dim: [(none, none)] * len(i) for dim, (i, _) in queries.items()}
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                if dim not in queries:
                    continue
                ci, c = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["data"], "<i8").reshape(-1, dim)
                order = np.frombuffer(row["lists"], "<i4").reshape(-1, dim)
                real = Lists(c.astype(float), order)
                for at in range(0, len(queries[dim][0]), QUERIES):
                    _search_block(best[dim], at, *(x[at: at + QUERIES] for x in queries[dim]), ci, c, real, k)
        for dim, (qi, _) in queries.items():
            sizes = [len(i) for i, _ in best[dim]]
            if sum(sizes):
                columns = np.repeat(qi, sizes), *(np.concatenate([b[i] for b in best[dim]]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])

    return run


def _search_block(best: list, first: int, qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray, lists: Lists, k: int) -> None:
    """Put what a block adds into ``best`` (from ``first`` on)."""
    most = float((np.abs(q.astype(float)) @ np.abs(lists.vectors).max(axis=0)).max())
    if most >= 2.0**63:
        raise OverflowError("inner products can leave 64 bits")
    own = qi[:, None] == ci[None, :]
    if most < EXACT:
        floor = np.array([float(s[-1]) if s.size == k else -np.inf for _, s in best[first: first + len(qi)]])
        found, _ = nra(q.astype(float), lists, k, own, floor)
    else:  # products may pass what doubles hold exactly: every place is resolved in integers
        found = [np.flatnonzero(~o) for o in own]
    for at, places in enumerate(found):
        places = places[~own[at, places]]
        best[first + at] = _merge(best[first + at], ci[places], c[places] @ q[at], k)


def _portions(queries: DataFrame, rows: int) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Blocks of query vectors, some bytes at a time, one dimension's together."""
    held: dict[int, list] = {}
    size = 0
    packed = written(queries.select("id", "v").mapInArrow(_pack(rows), _BLOCK_SCHEMA), "queries")
    for row in packed.select("dim", "ids", "data").toLocalIterator():
        held.setdefault(row["dim"], []).append(row)
        size += len(row["data"])
        if size >= PORTION:
            yield [(dim, b"".join(r["ids"] for r in some), b"".join(r["data"] for r in some)) for dim, some in held.items()]
            held, size = {}, 0
    if held:
        yield [(dim, b"".join(r["ids"] for r in some), b"".join(r["data"] for r in some)) for dim, some in held.items()]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK,
          query_block: int = QUERIES) -> DataFrame:
    """The ``k`` candidates with the largest integer inner product for each query.

    Both tables hold ``id`` and ``v`` (array of bigint); a candidate with the
    query's own id takes no part.  Only vectors of equal length are compared.
    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id, a
    query with fewer candidates has fewer rows and one with none has no row.
    Scores are exact; vectors whose products could leave 64 bits fail the job.
    Rows with an id that occurs more than once are separate candidates; different
    query vectors of one id are all searched, and the best of what they find count.
    """
    spark = candidates.sparkSession
    c = written(candidates.select("id", "v").mapInArrow(_pack(block), _BLOCK_SCHEMA), "vectors")
    schema = "query_id bigint, vec_id bigint, score bigint"
    found = [spark.createDataFrame([], schema)]
    for portion in _portions(queries.dropDuplicates(["id", "v"]), query_block):
        shared = spark.sparkContext.broadcast(portion)
        part = c.mapInArrow(_search(shared, k), schema)
        # what a portion finds is written, as its queries leave the tasks then
        found.append(written(part, "found"))
        shared.unpersist()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = functools.reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
