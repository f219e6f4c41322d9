"""Exact top-k inner-product search by aggregation without random access.

Vectors are cut into blocks of bounded size and queries into blocks of their own; every query block meets
every vector block in one task. Inside a task each dimension gives one list of the block's values, sorted once
for all queries. A query reads the lists in sequence, from the end that its weight prefers, deeper each round:
an item's lower bound takes the last value of the lists in which it was not yet seen, its upper bound their
frontier. Reading stops once few items outside those with final scores can reach the k-th best lower bound
or the k-th best final score of earlier vectors; the final scores of these few are then resolved and
the best k kept. The local results of all blocks are merged by rank.

Defined results: a null vector, one that holds a null or a component that is not finite, and a row
without id take no part; a shorter vector counts as padded with zeros; empty vectors score 0; ties go to
the smaller id; rows that share the query's id are its own and no candidates, other repeated rows count
one by one; fewer than k others give fewer rows; an empty table gives none. Components are floor(256 x);
sums must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a vector block, of the part of it whose lists are read together, of a query block.
VECTOR_ROWS, SCAN_ROWS, QUERY_ROWS = 8192, 4096, 2048


def quantized(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v array<long>, the vectors that take part."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return vectors.where(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & fine).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 256)).cast("array<long>").alias("v")
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width), np.int64)
    if len(flat):
        row = np.repeat(np.arange(len(size)), size)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class Lists:
    """One list per dimension of a block of vectors, sorted once and read from either end, never by item."""

    def __init__(self, v: np.ndarray):
        self.items = np.ascontiguousarray(np.argsort(v, axis=0, kind="stable").T)
        self.values = np.take_along_axis(np.ascontiguousarray(v.T), self.items, 1).astype(np.float64)
        self.read = 0


class Reading:
    """What one query has read of the lists, and the bounds that follow.

    A positive weight reads its list from the largest value down, a negative one from the smallest up. For the
    lists in which an item was not seen, the upper bound takes their frontier and the lower bound their last value.
    """

    def __init__(self, lists: Lists, q: np.ndarray):
        self.lists, self.depth, self.n = lists, 0, lists.items.shape[1]
        self.up, self.down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        self.weight = np.concatenate([q[self.up], q[self.down]]).astype(np.float64)
        self.last = self.weight * self._values(self.n - 1)
        self.lower = np.full(self.n, self.last.sum())
        self.seen: list[tuple[np.ndarray, int]] = []

    def _values(self, place: int) -> np.ndarray:
        return np.concatenate([self.lists.values[self.up, self.n - 1 - place], self.lists.values[self.down, place]])

    def to(self, depth: int) -> None:
        """Read every list on, as far as `depth` entries."""
        top, low = slice(self.n - depth, self.n - self.depth), slice(self.depth, depth)
        at = np.concatenate([self.lists.items[self.up, top], self.lists.items[self.down, low]]).ravel()
        value = np.concatenate([self.lists.values[self.up, top], self.lists.values[self.down, low]])
        self.lower += np.bincount(at, (value * self.weight[:, None] - self.last[:, None]).ravel(), self.n)
        self.seen.append((at, depth - self.depth))
        self.lists.read += len(at)
        self.depth = depth

    def upper(self) -> np.ndarray:
        gap = self.weight * self._values(self.depth - 1) - self.last
        out = self.lower + gap.sum()
        for at, step in self.seen:
            out -= np.bincount(at, np.repeat(gap, step), self.n)
        return out


def top_k(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int, count: list[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its row number, the ids of its k best vectors and their scores. `count` gets the list entries read for each block."""
    order = np.argsort(v_ids, kind="stable")
    v, v_ids = v[order], v_ids[order]
    most = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0))
    slack = 0.0 if most < 2**50 else most * 1e-13 * max(1, q.shape[1])  # doubles hold smaller sums exactly
    low = -(2**62)
    best = np.full((len(q), k), low, np.int64)
    best_ids = np.zeros((len(q), k), np.int64)

    def resolve(i: int, part: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        """Take the final scores of the vectors at these places of a block."""
        scores, names = np.r_[best[i], part[at] @ q[i]], np.r_[best_ids[i], ids[at]]
        top = np.lexsort((names, -scores))[:k]
        best[i], best_ids[i] = scores[top], names[top]

    for s in range(0, len(v), SCAN_ROWS):
        part, ids = v[s : s + SCAN_ROWS], v_ids[s : s + SCAN_ROWS]
        n = len(part)
        lists = Lists(part)
        for i in range(len(q)):
            mine = ids == q_ids[i]
            reading, open_items = Reading(lists, q[i]), ~mine
            for eighths in (1, 3, 5, 6, 7, 8):
                depth = max(1, n * eighths // 8)
                if depth > reading.depth:
                    reading.to(depth)
                upper, lower = reading.upper() + slack, np.where(mine, -np.inf, reading.lower - slack)
                if eighths == 1:  # the most promising ones set the bar
                    first = np.argpartition(-lower, min(k, n - 1))[: k + 1]
                    first = first[open_items[first]]
                    resolve(i, part, ids, first)
                    open_items[first] = False
                bar = float(best[i, k - 1]) if best[i, k - 1] > low else -np.inf
                if n > k:
                    bar = max(bar, np.partition(lower, n - k)[n - k])
                rivals = np.flatnonzero(open_items & (upper >= bar))
                if len(rivals) <= max(8 * k, n // 4) or depth == n:
                    resolve(i, part, ids, rivals)
                    break
        if count is not None:
            count.append(lists.read)
    for i in range(len(q)):
        real = best[i] > low
        yield i, best_ids[i][real], best[i][real]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of `vectors` for each row of `queries`.

    Both have vec_id and v as `quantized` gives them.
    """
    schema = "query_id long, vec_id long, score long"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(left) and len(right):
            width = max(1, *(max((len(x) for x in t["v"]), default=0) for t in (left, right)))
            q_ids, v_ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            for i, ids, scores in top_k(_matrix(left["v"], width), q_ids, _matrix(right["v"], width), v_ids, k):
                out[0].append(np.full(len(ids), q_ids[i]))
                out[1].append(ids)
                out[2].append(scores)
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in out], ["query_id", "vec_id", "score"])

    v_blocks = max(1, -(-vectors.count() // VECTOR_ROWS))
    q_blocks = max(1, -(-queries.count() // QUERY_ROWS))
    block = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = block(queries, q_blocks, "qb").withColumn("vb", every(v_blocks)).select("qb", "vb", "vec_id", "v")
    right = block(vectors, v_blocks, "vb").withColumn("qb", every(q_blocks)).select("qb", "vb", "vec_id", "v")
    local = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
