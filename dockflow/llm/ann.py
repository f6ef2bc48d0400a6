"""Exact nearest neighbours by a block matrix join: int8 tiles bound every product, survivors are recomputed.

Vectors are cut into blocks of queries and of candidates by a hash of the id; each pair of blocks meets once, as one row
of the join, so no task holds more than one block of either side and its running heaps. A vector v is kept as scale * q
with q in int8, and the norms of scale * q and of the rest. For two vectors the product of the int8 parts is exact, and
|u.v - scales * (q_u.q_v)| <= |u - rest_u| |rest_v| + |rest_u| |v|. A candidate whose upper bound is below the K-th
largest lower bound of the query so far cannot be among its K nearest; all others are recomputed in double precision on
the original vectors, merged into the tile's heaps, and the heaps of a query's tiles are merged by a window that keeps K
rows for each query before the shuffle.

Cost is queries times candidates, as the task fixes the query set; each side is shuffled once for each block of the
other.

Defined results: vectors that are NULL, empty, zero or hold NULL, NaN or infinity take no part. Vectors are compared
with those of equal length only. Ties go to the smaller id. With repeated ids each row is a candidate of its own; the
query's id is never its own candidate. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
TILE = 1024
#: Partial sums of int8 products stay exact in single precision up to this many dimensions.
EXACT_DIMS = 1024


def usable(vector) -> F.Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 parts, their scales, the norms of the int8 part and of what it leaves out."""
    scale = np.abs(v).max(axis=1) / 127
    scale = np.where(scale > 0, scale, 1.0)
    q = np.rint(v / scale[:, None])
    part = q * scale[:, None]
    up = 1 + 1e-9  # rounding of the norms themselves
    return q.astype(np.int8), scale, np.linalg.norm(part, axis=1) * up, np.linalg.norm(v - part, axis=1) * up


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows; single precision holds them for each run of dimensions."""
    total = np.zeros((len(a), len(b)), np.float64)
    for at in range(0, a.shape[1], EXACT_DIMS):
        total += a[:, at : at + EXACT_DIMS].astype(np.float32) @ b[:, at : at + EXACT_DIMS].astype(np.float32).T
    return total


class Heaps:
    """The K best (score, -id) of each query."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n)]

    def add(self, row: int, ids: np.ndarray, scores: np.ndarray) -> None:
        heap = self.heaps[row]
        for item in zip(scores.tolist(), (-ids).tolist()):
            if len(heap) < self.k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)

    def floor(self, row: int) -> float:
        return self.heaps[row][0][0] if len(self.heaps[row]) == self.k else -np.inf


def tile_search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Heaps:
    """Nearest candidates of each query in one pair of blocks."""
    heaps = Heaps(len(q), k)
    a, a_scale, a_part, a_rest = quantise(q)
    for at in range(0, len(c), TILE):
        ids, v = c_ids[at : at + TILE], c[at : at + TILE]
        b, b_scale, b_part, b_rest = quantise(v)
        mid = int8_products(a, b) * a_scale[:, None] * b_scale
        slack = a_part[:, None] * b_rest + a_rest[:, None] * (b_part + b_rest)
        slack += 1e-12 * (np.abs(mid) + slack)  # rounding of the bounds
        own = q_ids[:, None] == ids
        low, high = np.where(own, -np.inf, mid - slack), np.where(own, -np.inf, mid + slack)
        floor = np.array([heaps.floor(i) for i in range(len(q))])
        if len(ids) >= k:
            floor = np.maximum(floor, -np.partition(-low, k - 1, axis=1)[:, k - 1])
        for i in range(len(q)):
            left = np.flatnonzero((high[i] >= floor[i]) & ~own[i])
            if len(left):
                # Summed from the first dimension on, so that equal vectors score alike in every block and engine.
                heaps.add(i, ids[left], (q[i] * v[left]).cumsum(axis=1)[:, -1])
    return heaps


def _searched(k: int):
    def matrix(cell, dims: int) -> tuple[np.ndarray, np.ndarray]:
        ids = cell.field("id").to_numpy(zero_copy_only=False)
        return ids, cell.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dims = batch.column("dims")[r].as_py()
                q_ids, q = matrix(batch.column("queries")[r].values, dims)
                c_ids, c = matrix(batch.column("candidates")[r].values, dims)
                heaps = tile_search(q_ids, q, c_ids, c, k).heaps
                rows = [(int(i), -n, s) for i, heap in zip(q_ids, heaps) for s, n in heap]
                if rows:
                    ids, near, scores = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(near, pa.int64()), pa.array(scores, pa.float64())],
                        ["query_id", "vec_id", "score"],
                    )

    return run


def nearest(
    vectors: DataFrame, is_query: F.Column, k: int = 20, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the K rows with the largest inner product for each query row."""
    v = F.col(vector)
    rows = vectors.where(F.col(key).isNotNull() & usable(v)).select(
        F.col(key).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dims"), is_query.alias("asked")
    )
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asked").alias("q")).first()
    n_c, n_q = -(-max(counts["n"], 1) // CANDIDATE_BLOCK), -(-max(counts["q"], 1) // QUERY_BLOCK)
    cell = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    packed = F.collect_list(F.struct("id", "v"))
    candidates = rows.groupBy("dims", cell(n_c).alias("c")).agg(packed.alias("candidates"))
    queries = rows.where("asked").groupBy("dims", cell(n_q).alias("q")).agg(packed.alias("queries"))
    # Every block of queries meets every block of candidates once.
    tiles = queries.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    cells = tiles.join(candidates, ["dims", "c"]).repartition(n_c * n_q, "c", "q")
    found = cells.select("dims", "queries", "candidates").mapInArrow(_searched(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
