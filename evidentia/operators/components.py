"""Principal components of wide rows without a covariance matrix.

A pass multiplies the centred rows with a narrow block of directions and back; what a task sends on has
the size columns x directions and is added up a bounded number at a time. The driver holds a small
basis of such blocks, finds the best directions within it, and asks for the next block
until every wanted direction is an eigenvector up to a relative residual.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.session import checkpoint_root

MEET = 16  # partial sums added by one task
SPARE = 8  # directions beyond the wanted ones
HELD = 4  # blocks of the basis before it is cut back to two
TOLERANCE = 1e-9  # residual relative to the largest eigenvalue
PASSES = 100


@dataclass
class Components:
    """Directions as columns, the variances along them (divisor n - 1) and the variance of all columns."""

    mean: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    residuals: np.ndarray
    total_variance: float
    rows: int


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _added(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum over all rows of ``of`` (an array of fixed size a batch): one array a task, then MEET at a time."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column("v")))
                held = part if held is None else held + part
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["k", "held"])

    def again(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("k").to_numpy())
        total = np.sum([np.frombuffer(b) for b in table.column("held").take(pa.array(order)).to_pylist()], axis=0)
        return pa.table({"k": pa.array([key[0].as_py()], pa.int64()), "held": pa.array([total.tobytes()], pa.binary())})

    schema = "k long, held binary"
    parts, left = rows.mapInArrow(first, schema), rows.rdd.getNumPartitions()
    while left > MEET:
        parts = parts.withColumn("g", F.floor(F.col("k") / MEET)).groupBy("g").applyInArrow(again, schema)
        left = -(-left // MEET)
    held = [np.frombuffer(r["held"]) for r in parts.orderBy("k").collect()]  # at most MEET
    return np.sum(held, axis=0) if held else None


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what of ``block`` lies outside ``against``; none for what rounding leaves."""
    for _ in range(2):
        block = block - against @ (against.T @ block)
    q, r = np.linalg.qr(block)
    q = q[:, np.abs(np.diag(r)) > 1e-12 * max(1.0, np.abs(r).max(initial=0))]
    for _ in range(2):
        q = q - against @ (against.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def fit_components(df: DataFrame, values: str, k: int, seed: int = 0) -> Components | None:
    """The ``k`` directions of largest variance of the rows of ``values`` (arrays of one length, without nulls).

    None for an empty table. Fewer directions come back if there are fewer columns. Raises if the passes do not
    converge.
    """
    checkpoint_root(df.sparkSession)
    rows = df.select(F.col(values).alias("v")).checkpoint()
    first = _added(rows, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]))
    if first is None:
        return None
    n, mean = int(first[0]), first[1:] / first[0]
    total = float(_added(rows, lambda x: np.array([((x - mean) ** 2).sum()]))[0])
    columns = len(mean)
    k = min(k, columns)
    width = min(columns, k + SPARE)
    basis = image = np.zeros((columns, 0))
    block = _orthonormal(np.random.default_rng(seed).standard_normal((columns, width)), basis)
    for _ in range(PASSES):
        shared = df.sparkSession.sparkContext.broadcast((mean, block))  # columns x width

        def product(x: np.ndarray, shared=shared) -> np.ndarray:
            middle, directions = shared.value
            centred = x - middle
            return (centred.T @ (centred @ directions)).ravel()

        basis = np.concatenate([basis, block], axis=1)
        image = np.concatenate([image, _added(rows, product).reshape(columns, -1)], axis=1)
        shared.unpersist()
        small = basis.T @ image
        values_, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values_)[::-1]
        values_, turn = values_[order], turn[:, order]
        found, moved = basis @ turn, image @ turn
        gap = moved - found * values_
        size = np.linalg.norm(gap, axis=0)
        scale = max(values_[0], np.finfo(float).tiny)
        if (size[:k] <= TOLERANCE * scale).all() or basis.shape[1] >= columns:
            share = max(n - 1, 1)
            return Components(mean, found[:, :k], np.maximum(values_[:k], 0.0) / share, size[:k] / share, total / share, n)
        if basis.shape[1] + width > HELD * width:
            keep = 2 * width
            basis, image = found[:, :keep], moved[:, :keep]
        block = _orthonormal(gap[:, :width], basis)
        block = block[:, : columns - basis.shape[1]]
        if not block.shape[1]:
            block = _orthonormal(np.random.default_rng(seed + 1).standard_normal((columns, width)), basis)[:, : columns - basis.shape[1]]
    raise ArithmeticError(f"directions did not converge in {PASSES} passes")


def with_scores(df: DataFrame, values: str, fitted: Components, name: str = "pc") -> DataFrame:
    """``df`` with ``name``: the centred row along every direction, as an array."""
    shared = df.sparkSession.sparkContext.broadcast((fitted.mean, fitted.directions))  # columns x directions
    columns = list(df.columns)
    at = columns.index(values)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, directions = shared.value
        for batch in batches:
            out = (_matrix(batch.column(at)) - mean) @ directions if batch.num_rows else np.zeros((0, directions.shape[1]))
            offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(out).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*columns, name])

    return df.mapInArrow(scored, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))
