"""Nearest neighbours by a block matrix join.

Candidates and queries are packed into blocks of rows. Every query block meets every candidate
block in one tile: an int8 product of the quantised blocks gives all distances of the tile with
a bound on the quantisation error. A pair survives if its least possible distance is not above
the k-th smallest of the query's largest possible ones; survivors are computed again in double
precision from the original vectors. Each task keeps a heap of k per query over its tiles, and
the heaps of all tasks are merged. No pair of rows leaves a task but the k best of a query.

Candidate blocks are dealt to groups of a fixed number of blocks, and each group gets its own
copy of the query blocks, so tasks stay alike in size whatever the number of rows, and equal
vectors, however many, spread with their blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import stored

ROWS_PER_BLOCK = 1024
BLOCKS_PER_GROUP = 8
LEVELS = 127


def usable(vector: str) -> Column:
    """Neither null nor zero, and all components finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _pack(batches: Iterator[pa.RecordBatch], rows_per_block: int, dtype: str) -> Iterator[pa.RecordBatch]:
    """row, id, vector -> blocks of equal dimension: block number within the task, rows, ids, vectors as bytes."""
    waiting: dict[int, list[tuple[int, int, bytes]]] = {}
    made = 0

    def block(dim: int) -> pa.RecordBatch:
        nonlocal made
        rows, ids, vectors = zip(*waiting.pop(dim))
        made += 1
        return pa.RecordBatch.from_pydict(
            {
                "dim": pa.array([dim], pa.int32()), "first_row": pa.array([rows[0]], pa.int64()),
                "rows": pa.array([np.array(rows, "<i8").tobytes()], pa.binary()),
                "ids": pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                "vectors": pa.array([b"".join(vectors)], pa.binary()),
            }
        )

    for batch in batches:
        for row, key, vector in zip(*[c.to_pylist() for c in batch.columns]):
            held = waiting.setdefault(len(vector), [])
            held.append((row, key, np.array(vector, dtype).tobytes()))
            if len(held) == rows_per_block:
                yield block(len(vector))
    for dim in list(waiting):
        yield block(dim)


PACKED = "dim int, first_row long, rows binary, ids binary, vectors binary"


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """int8 values, their step, and each vector's exact distance from its quantised form."""
    step = float(np.abs(vectors).max()) / LEVELS or 1.0
    values = np.rint(vectors / step).astype(np.int8)
    return values, step, np.linalg.norm(vectors - step * values, axis=1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows; float arithmetic holds them exactly in this range."""
    exact = np.float32 if a.shape[1] * LEVELS * LEVELS < 2**24 else np.float64
    return (a.astype(exact) @ b.astype(exact).T).astype(np.float64)


def tile(
    queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate position, exact distance) of all pairs that can be among the k best."""
    q, q_step, q_error = quantised(queries)
    c, c_step, c_error = quantised(candidates)
    squares = lambda x: np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64))
    near = (q_step**2 * squares(q))[:, None] + (c_step**2 * squares(c))[None, :] - 2 * q_step * c_step * _products(q, c)
    near = np.sqrt(np.maximum(near, 0.0))
    slack = q_error[:, None] + c_error[None, :]
    slack += 1e-6 * (near + slack) + 1e-7 * (q_step + c_step)  # rounding of the bounds themselves
    upper = near + slack
    upper[query_ids[:, None] == ids[None, :]] = np.inf
    kth = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(q), np.inf)
    at_q, at_c = np.nonzero((near - slack <= kth[:, None]) & np.isfinite(upper))
    total = np.zeros(len(at_q))
    for j in range(queries.shape[1]):  # in the order of components, as a plain sum would
        gap = queries[at_q, j].astype(np.float64) - candidates[at_c, j].astype(np.float64)
        total += gap * gap
    return at_q, at_c, np.sqrt(total)


def _search(batches: Iterator[pa.RecordBatch], k: int, dtype: str) -> Iterator[pa.RecordBatch]:
    heaps: dict[tuple[int, int], list[tuple[float, int]]] = {}
    for batch in batches:
        for dim, q_rows, q_ids, q_vectors, ids, vectors in zip(*[c.to_pylist() for c in batch.columns]):
            q_rows, q_ids, ids = (np.frombuffer(x, "<i8") for x in (q_rows, q_ids, ids))
            queries = np.frombuffer(q_vectors, dtype).reshape(-1, dim).astype(np.float64)
            candidates = np.frombuffer(vectors, dtype).reshape(-1, dim).astype(np.float64)
            at_q, at_c, far = tile(queries, q_ids, candidates, ids, k)
            order = np.lexsort((ids[at_c], far, at_q))
            at_q, found, far = at_q[order], ids[at_c][order], far[order]
            starts = np.searchsorted(at_q, np.arange(len(q_ids) + 1))
            for i in range(len(q_ids)):
                heap = heaps.setdefault((int(q_rows[i]), int(q_ids[i])), [])
                for j in range(starts[i], min(starts[i + 1], starts[i] + k)):
                    item = (-far[j], -int(found[j]))  # the largest of the k is on top
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
                    else:
                        break
    rows = [(r, q, -v, -d) for (r, q), heap in heaps.items() for d, v in heap]
    for at in range(0, len(rows), 10_000):
        part = list(zip(*rows[at : at + 10_000]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64()), pa.array(part[3], pa.float64())],
            ["query_row", "query_id", "vec_id", "score"],
        )


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
    rows_per_block: int = ROWS_PER_BLOCK, blocks_per_group: int = BLOCKS_PER_GROUP,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows nearest to every query row, nearest first.

    The result is exact. Ties go to the smaller identifier. Fewer than k candidates are all
    returned. Vectors that are null, zero, or hold a null or non-finite component take no part,
    nor do rows without identifier. Rows with the query's own identifier are not its candidates;
    query rows that repeat an identifier are each answered. Vectors of different length never
    meet. An empty table gives an empty result. Other columns are not read.
    """
    kind = vectors.schema[vector].dataType
    dtype = "<f4" if isinstance(kind.elementType, T.FloatType) else "<f8"
    rows = vectors.where(usable(vector) & F.col(key).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("key"), F.col(vector).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    rows = stored(rows, "nearest-rows")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    groups = -(-counts["n"] // (rows_per_block * blocks_per_group)) or 1
    asking = -(-counts["q"] // rows_per_block) or 1
    pack = lambda df: df.select("row", "key", "v").mapInArrow(lambda b: _pack(b, rows_per_block, dtype), PACKED)
    # Full blocks: rows are dealt evenly first, queries by their block.
    candidates = pack(rows.repartition(groups)).withColumn("group", F.pmod(F.xxhash64("first_row"), F.lit(groups).cast("bigint")))
    candidates = candidates.withColumn("block", F.explode(F.expr(f"sequence(0L, {asking - 1}L)")))
    queries = pack(rows.where("asks").repartition(asking, "row"))
    queries = stored(queries.withColumn("block", F.pmod(F.xxhash64("first_row"), F.lit(asking).cast("bigint"))), "nearest-queries")
    queries = queries.withColumn("group", F.explode(F.expr(f"sequence(0L, {groups - 1}L)")))
    q = queries.select(
        "dim", "group", "block", F.col("rows").alias("q_rows"),
        F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"),
    )
    tiles = candidates.drop("rows", "first_row").join(q, ["dim", "group", "block"])
    found = tiles.select("dim", "q_rows", "q_ids", "q_vectors", "ids", "vectors").mapInArrow(
        lambda b: _search(b, k, dtype), "query_row long, query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
