"""Exact top-k by inner product: no-random-access aggregation over sorted lists.

Vectors become whole numbers. A task gathers its rows to groups of bounded size and cuts them into shards. Of a shard each
dimension is a list of its entries in order, read from the top by queries whose entry there is positive, from the
bottom by the others. All lists are read to one depth, round after round. What a list has given counts as it is; of what it hasn't,
the entry last read is the upper bound and the list's far end the lower one. So a round gives each candidate of each query both bounds,
a block of queries at once. A query stops when, but for a short rest, no candidate's upper bound reaches the k-th best lower
bound, or the k-th best score that the task has found; the rest get their final scores. Candidates aren't shuffled; each group
gives its best few for each query, and the best of these are the answer.

Queries are written once to the shared folder, and tasks read them from there block by block.

Defined results: vectors that are null, empty, or hold a null, infinite or not-a-number entry take no part; entries beyond 2^61 / scale
are held there, a score beyond long at long's ends; only vectors of the query's length are candidates; of rows that share a query's id
and vector one is its own and left out, others are candidates, and each of them is a query; a row without an id can be a candidate, behind others of its
score; equal vectors count one by one, ties go to the smaller id; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, staged, tidied
from .vectors import by_length, floored, whole

SCALE = 256
EVERY = 50
K = 5
#: Entries of a group of rows that a task holds, rows of a shard, queries read at once, and queries whose bounds are held at once.
GROUP, SHARD, READ, BLOCK = 8_000_000, 8192, 2048, 256
#: Parts of the lists read by the end of each round, and candidates that may be left when a query stops.
DEPTHS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 1)
REST = 256

_NAMES = ["q", "query_id", "vec_id", "score", "own"]


class Lists:
    """The sorted lists of a shard, read from both ends to a common depth."""

    def __init__(self, x: np.ndarray, kind: type) -> None:
        self.order, self.m, self.d, self.depth = np.argsort(x, axis=0, kind="stable"), *x.shape, 0
        self.values = np.take_along_axis(x, self.order, 0).astype(kind)
        # Lower bounds: what is read, else the worst entry of the list. Lists of falling entries first, then those of rising ones.
        self.low = np.hstack([np.broadcast_to(self.values[0], x.shape), np.broadcast_to(self.values[-1], x.shape)])
        self.read = np.zeros(self.low.shape, bool)

    def go_on(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Reads on to ``depth`` entries of each list; lower and upper bounds of every entry."""
        down, up = slice(self.m - depth, self.m - self.depth), slice(self.depth, depth)
        for part, first in ((down, 0), (up, self.d)):
            columns = np.broadcast_to(first + np.arange(self.d), (part.stop - part.start, self.d))
            self.low[self.order[part], columns] = self.values[part]
            self.read[self.order[part], columns] = True
        self.depth = depth
        frontier = np.concatenate([self.values[self.m - depth], self.values[depth - 1]])
        return self.low, np.where(self.read, self.low, frontier)


def _best(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of rows ``q, score, id, no id, own`` the best k of each q, in order."""
    q, score, ids, none, _ = found
    order = np.lexsort((ids, none, -score, q))
    q = q[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return [c[order[rank < k]] for c in found]


def _scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of rows; Python's whole numbers where a long might not do."""
    if exact:
        return np.einsum("ij,ij->i", a, b)
    return (a.astype(object) * b.astype(object)).sum(1) if len(a) else np.zeros(0, object)


def search_shard(q: np.ndarray, x: np.ndarray, kth: np.ndarray, k: int, rest: int = REST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``query, candidate, score`` of all pairs that may be among the best ``k``; ``kth`` is each query's k-th best score so far.

    Bounds are whole numbers in single or double precision where that is exact; beyond, they give way by a rounding error.
    """
    most = float((np.abs(q).max(0).astype(float) * np.abs(x).max(0).astype(float)).sum())
    kind, exact = (np.float32 if most < 1 << 24 else np.float64), most < 1 << 62
    slack = 0.0 if most < 1 << 53 else most * x.shape[1] * 2.0**-48
    lists, signed = Lists(x, kind), np.hstack([np.maximum(q, 0), np.minimum(q, 0)]).astype(kind)
    open_ = np.arange(len(q))
    for part in DEPTHS:
        depth = max(1, int(np.ceil(part * len(x))))
        low, high = lists.go_on(depth)
        left = []
        for at in range(0, len(open_), BLOCK):
            own = open_[at : at + BLOCK]
            lower = signed[own] @ low.T
            bar = kth[own]
            if len(x) >= k:
                bar = np.maximum(bar, np.partition(lower, len(x) - k, axis=1)[:, len(x) - k] - slack)
            can = signed[own] @ high.T >= (bar - slack)[:, None]
            stops = (can.sum(1) <= rest) | (depth == len(x))
            for some in np.array_split(np.flatnonzero(stops), 1 + int(can[stops].sum()) // (64 * SHARD)):
                i, c = np.nonzero(can[some])
                yield own[some][i], c, _scores(q[own[some][i]], x[c], exact)
            left.append(own[~stops])
        open_ = np.concatenate(left) if left else open_
        if not len(open_):
            return


def _distinct(x: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the best: of equal vectors the k smallest ids, as ties go to them."""
    rows = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    _, which = np.unique(rows, return_inverse=True)
    zero = np.zeros(len(x), np.int64)
    return np.sort(_best([which, zero, ids, none, np.arange(len(x))], k)[4])


def search_group(x: np.ndarray, ids: np.ndarray, none: np.ndarray, queries: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> list[np.ndarray]:
    """The best k + 1 rows of a group for each query (number, id, vector), its own among them, as ``q, score, id, no id, own``."""
    number, query_id, q = queries
    found = [np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)]
    kth = np.full(len(q), -np.inf)
    for at in range(0, len(x), SHARD):
        own = slice(at, at + SHARD)
        for i, c, score in search_shard(q, x[own], kth, k + 1):
            c = c + at
            mine = (ids[c] == query_id[i]) & ~none[c]
            mine[mine] = (x[c[mine]] == q[i[mine]]).all(1)
            found = [np.concatenate(p) for p in zip(found, (i, score, ids[c], none[c], mine), strict=True)]
        found = _best([found[0], found[1], *found[2:]], k + 1)
        last = np.flatnonzero(np.r_[found[0][1:] != found[0][:-1], True][: len(found[0])])
        full = last[np.bincount(found[0], minlength=len(q))[found[0][last]] == k + 1]
        kth[found[0][full]] = found[1][full].astype(float)
    return [number[found[0]], query_id[found[0]], *found[1:]]


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    v = F.col(vector_col)
    return df.where(whole(v) & (F.size(v) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), floored(v, scale).alias("x"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each of ``queries`` the k best of ``rows``, but one row of its own id and vector.

    Both have ``vec_id`` and ``x``, an array of long without nulls.
    """
    numbered = queries.select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("query_id"), "x")
    path = staged(numbered.hint("rebalance"), "topk-queries").scratch_path

    def blocks() -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(path)
        files = pads.dataset(folder, filesystem=store, format="parquet", schema=pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("x", pa.list_(pa.int64()))]))
        return files.to_batches(columns=["q", "query_id", "x"], batch_size=READ, batch_readahead=1, fragment_readahead=1, use_threads=False)

    def searched(d: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        x, ids, none = (np.concatenate(p) for p in zip(*parts, strict=True))
        keep = _distinct(x, ids, none, k + 1)
        x, ids, none = x[keep], ids[keep], none[keep]
        for b in blocks():
            for length, own, q in by_length(b.column(2)):
                if length == d:
                    number, query_id, score, vec, null, mine = search_group(x, ids, none, (b.column(0).to_numpy()[own], b.column(1).to_numpy()[own], q), k)
                    score = np.clip(score, -(1 << 63), (1 << 63) - 1).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(query_id), pa.array(vec, mask=null), pa.array(score), pa.array(mine)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            none = b.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(0).to_numpy()
            for d, own, x in by_length(b.column(1)):
                held.setdefault(d, []).append((x.copy(), ids[own], none[own]))
                if sum(p[0].size for p in held[d]) >= GROUP:
                    yield from searched(d, held.pop(d))
        for d, parts in held.items():
            yield from searched(d, parts)

    found = rows.select("vec_id", "x").mapInArrow(tidied(run), "q long, query_id long, vec_id long, score long, own boolean")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("own").desc())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    before = F.sum(F.col("own").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    best = best.withColumn("own_rank", before).where(~F.col("own") | (F.col("own_rank") > 1))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def search(df: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`top_k` of all rows for those whose id ``every`` divides, over whole numbers of ``scale`` times the entries."""
    rows = whole_vectors(df, id_col, vector_col, scale)
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k)
