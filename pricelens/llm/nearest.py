"""Nearest listing vectors by cosine: an exact block join with int8 product tiles.

Query blocks meet candidate blocks; a tile is one task's work and holds at most a block of either. Vectors are scaled to
length one and rounded to int8 with one scale each. The product of the rounded vectors differs from the cosine by at most
``|e_q| |x'| + |q| |e_x|`` (e: what rounding took away, x': the rounded vector), so a tile knows an upper and a lower bound
of every cosine. Only pairs whose upper bound reaches the k-th lower bound of their query are computed again, in double
precision on the original vectors. The best k of each tile are merged by heaps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import runs

#: Rows of a block of candidates and of queries.
CANDIDATES, QUERIES = 8192, 512


def usable(items: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, dim): rows with a key and a vector that is not null, not empty, not zero, without null or non-finite parts."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    return (items.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
            .withColumn("dim", F.size("v")))


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers as such; keys of other types as Python objects, so that equal means equal."""
    return np.array(column.to_pylist(), dtype=None if pa.types.is_integer(column.type) else object)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    largest = np.abs(values).max(axis=1, keepdims=True)
    odd = (largest > 1e100) | (largest < 1e-100)  # squares would leave the range of doubles; the cosine does not change
    return np.where(odd, values / largest, values)


def _rounded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scales, the lengths of the rounded vectors and of what rounding took away."""
    scale = np.abs(unit).max(axis=1) / 127
    whole = np.rint(unit / scale[:, None]).astype(np.int8)
    back = whole * scale[:, None]
    return whole, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def _dot(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of row i of a and row j of b, added up from the first component to the last."""
    total = np.zeros(len(i))
    for d in range(a.shape[1]):
        total += a[i, d] * b[j, d]
    return total


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, id, cosine): the k nearest of each query in one tile, by larger cosine, then smaller id."""
    every_q, every_x = np.arange(len(queries)), np.arange(len(vectors))
    norm_q, norm_x = np.sqrt(_dot(queries, every_q, queries, every_q)), np.sqrt(_dot(vectors, every_x, vectors, every_x))
    q8, scale_q, size_q, lost_q = _rounded(queries / norm_q[:, None])
    x8, scale_x, size_x, lost_x = _rounded(vectors / norm_x[:, None])
    exact = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of int8 products stay whole numbers
    columns = np.ascontiguousarray(x8.T.astype(exact))
    for at in range(0, len(queries), 64):
        rows = slice(at, at + 64)
        about = (q8[rows].astype(exact) @ columns) * scale_q[rows, None] * scale_x[None, :]
        error = lost_q[rows, None] * size_x[None, :] + lost_x[None, :] + 1e-9
        own = query_ids[rows, None] == ids[None, :]
        lower = np.where(own, -np.inf, about - error)
        floor = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] > k else np.full(len(lower), -np.inf)
        q, x = np.nonzero((about + error >= floor[:, None]) & ~own)
        scores = _dot(queries, q + at, vectors, x) / (norm_q[q + at] * norm_x[x])
        bounds = np.searchsorted(q, np.arange(len(lower) + 1))
        for row in range(len(lower)):
            part = slice(bounds[row], bounds[row + 1])
            for score, i in heapq.nsmallest(k, zip((-scores[part]).tolist(), ids[x[part]].tolist())):
                yield query_ids[at + row], i, -score


def nearest(items: DataFrame, queries: DataFrame, key: str = "obs_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, key, score): the k rows of ``items`` with the largest cosine to each row of ``queries``.

    Rows with the query's own key are left out; equal cosines go by the smaller key; ranks start at 1; fewer candidates
    give fewer ranks. Null, empty and zero vectors and vectors with null or non-finite components take no part, nor do null
    keys. Vectors of different length never meet. A key that occurs several times is as many candidates; as a query it is
    one, nearest by any of its vectors. Keys may be numbers or texts, which are compared by code points. Empty tables give an empty result. Other columns are ignored.
    """
    every, asked = usable(items, key, vector), usable(queries, key, vector)
    kind = every.schema["id"].dataType.simpleString()
    blocks = max(1, -(-every.count() // CANDIDATES))
    query_blocks = max(1, -(-asked.count() // QUERIES))
    deal = lambda df, mine, n, other, m: df.select(
        "id", "v", "dim", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(mine),
        F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))
    left = deal(asked, "i", query_blocks, "j", blocks).groupBy("dim", "i", "j")
    right = deal(every, "j", blocks, "i", query_blocks).groupBy("dim", "i", "j")

    def meet(group: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if a.num_rows and b.num_rows:
            dim = group[0].as_py()
            found = list(tile(_keys(a["id"]), _matrix(a["v"], dim), _keys(b["id"]), _matrix(b["v"], dim), k))
        return _rows(found, a.schema.field("id").type)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "query"):
            kind_ = part.schema.field("id").type
            best: list[tuple] = []
            heap: list[tuple] = []
            now = None
            for query, i, score in [*zip(*(part[c].to_pylist() for c in ("query", "id", "score"))), (None, None, 0.0)]:
                if query != now:
                    best += [(now, other, -minus) for minus, other in heapq.nsmallest(k, heap)]
                    now, heap = query, []
                heap.append((-score, i))
            ranks = [n for n, _ in _ranked(best)]
            out = _rows(best, kind_).append_column("rank", pa.array(ranks, pa.int32()))
            yield from out.select(["query", "rank", "id", "score"]).to_batches()

    found = left.cogroup(right).applyInArrow(meet, f"query {kind}, id {kind}, score double")
    return (found.repartition("query").sortWithinPartitions("query")
            .mapInArrow(merge, f"query {kind}, rank int, id {kind}, score double")
            .select(F.col("query").alias("query_id"), "rank", F.col("id").alias(key), "score"))


def _rows(found: list[tuple], kind: pa.DataType) -> pa.Table:
    q, i, s = zip(*found) if found else ((), (), ())
    return pa.table({"query": pa.array(q, kind), "id": pa.array(i, kind), "score": pa.array(s, pa.float64())})


def _ranked(best: list[tuple]) -> Iterator[tuple[int, tuple]]:
    rank, last = 0, object()
    for row in best:
        rank = rank + 1 if row[0] == last else 1
        last = row[0]
        yield rank, row
