"""Whitening of embeddings by a blockwise QR factorisation and a bidiagonal qd solver.

Entries become whole numbers, so sums over all rows are exact. Each task factorises its centred
rows block by block and keeps one triangular factor; factors are stacked and factorised again, a
bounded number at a time, until one is left. Its singular values and directions come from
``bidiagonal``. The covariance of the rows is never formed; its eigenvalues are the
squares of the singular values over the number of rows.

What reaches the driver has the size of the dimensions: one sum a dimension, one triangular factor and
the moments of the whitened components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import bidiagonal
from evidentia.llm.common import single_threaded, stored

COMPONENTS = 8
SCALE, OFFSET = 1024.0, 100_000
LARGEST = 2.0**62  # whole numbers from here on do not fit
MEET = 16  # factors or moments merged by one task
BLOCK_BYTES = 1 << 24


@dataclass(frozen=True)
class Whitening:
    """The fit: rows, exact sums, directions as columns, eigenvalues and their shares, and how far off the result is."""

    rows: int
    sums: tuple[int, ...]
    directions: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float | None

    @property
    def weights(self) -> np.ndarray:
        """Directions over the roots of their eigenvalues; zero where there is no variance."""
        root = np.sqrt(self.eigenvalues)
        return self.directions / np.where(root > 0, root, np.inf)


def whole(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the usable rows of a batch, for each length that occurs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        flat = np.floor(flat * SCALE)
        wrong = ~(np.abs(flat) < LARGEST)
    ends = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(wrong)])
    usable = (size > 0) & (bad[ends] == bad[ends - size])
    for length in np.unique(size[usable]):
        places = np.flatnonzero(usable & (size == length))
        step = max(1, BLOCK_BYTES // (8 * int(length)))
        for low in range(0, len(places), step):
            part = places[low : low + step]
            at = (ends[part] - length)[:, None] + np.arange(length)
            yield part, flat[at].astype(np.int64) + OFFSET


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for places, x in whole(batch.column("v")):
            safe = float(np.abs(x).max()) * len(x) < 2.0**62
            total = x.sum(axis=0) if safe else x.astype(object).sum(axis=0)
            d = x.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d, d)), pa.array(np.full(d, len(places))), pa.array(np.arange(d)),
                 pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))],
                names=["size", "n", "at", "total"],
            )


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``x - S/n``: the whole part of the mean leaves exactly, the rest is below one."""
    whole_part = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n / n for s in sums])
    return (x - whole_part).astype(float) - rest


def _factor(rows: np.ndarray) -> np.ndarray:
    """The square triangular factor of some rows."""
    d = rows.shape[1]
    if len(rows) < d:
        rows = np.vstack([rows, np.zeros((d - len(rows), d))])
    return np.linalg.qr(rows, mode="r")


def _pooled(left: np.ndarray | None, right: np.ndarray) -> np.ndarray:
    """Merge (rows, means, centred products) of two sets of rows, kept as one square array.

    Row 0 holds the count and the means, the rest the products.
    """
    if left is None:
        return right
    n, m = left[0, 0], right[0, 0]
    gap = right[0, 1:] - left[0, 1:]
    out = left + right
    out[0, 1:] = left[0, 1:] + gap * (m / (n + m))
    out[1:, 1:] += np.outer(gap, gap) * (n * m / (n + m))
    return out


def _moments(w: np.ndarray) -> np.ndarray:
    k = w.shape[1]
    out = np.zeros((k + 1, k + 1))
    mean = w.mean(axis=0)
    out[0, 0], out[0, 1:] = len(w), mean
    out[1:, 1:] = (w - mean).T @ (w - mean)
    return out


def _reduced(
    df: DataFrame, of: Callable[[np.ndarray], np.ndarray], merge: Callable[[np.ndarray | None, np.ndarray], np.ndarray], size: int
) -> np.ndarray | None:
    """One square array for all vectors of length ``size``: one a task first, then merged MEET at a time."""

    def packed(key: int, held: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["key", "held"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        single_threaded()
        held = None
        for batch in batches:
            for _, x in whole(batch.column("v")):
                if x.shape[1] == size:
                    held = merge(held, of(x))
        yield from packed(TaskContext.get().partitionId(), held)

    def again(rows: pa.Table) -> pa.Table:
        single_threaded()
        held = None
        order = np.argsort(rows.column("key").to_numpy())
        for raw in rows.column("held").take(pa.array(order)).to_pylist():
            one = np.frombuffer(raw)
            held = merge(held, one.reshape(int(len(one) ** 0.5), -1))
        return pa.Table.from_batches(packed(rows.column("key")[int(order[0])].as_py() // MEET, held))

    parts = stored(df.select("v").mapInArrow(first, "key long, held binary"), "whitening-parts")
    while parts.count() > MEET:
        by = F.floor(F.col("key") / MEET)
        parts = stored(parts.groupBy(by.alias("g")).applyInArrow(again, "key long, held binary"), "whitening-parts")
    held = None
    for row in parts.orderBy("key").collect():  # at most MEET
        one = np.frombuffer(row["held"])
        held = merge(held, one.reshape(int(len(one) ** 0.5), -1))
    return held


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fit on all usable rows; None if there is none.

    The dimension is the length that most usable rows have (of equals the longest). Of a variance that
    is zero to rounding there is no direction; its weights are zero.
    """
    rows = df.select(F.col(vector).alias("v"))
    counted = stored(
        rows.mapInArrow(_sums, "size long, n long, at long, total decimal(38,0)").groupBy("size", "at").agg(
            F.sum("n").alias("n"), F.sum("total").alias("total")
        ), "whitening-sums",
    )
    most = counted.where("at = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return None
    n, size = most["n"], most["size"]
    sums = tuple(int(r["total"]) for r in counted.where(F.col("size") == size).orderBy("at").collect())

    def stacked(held: np.ndarray | None, r: np.ndarray) -> np.ndarray:
        return r if held is None else _factor(np.vstack([held, r]))

    r = _reduced(rows, lambda x: _factor(_centred(x, n, sums)), stacked, size)
    values, directions = bidiagonal.leading(r, components)
    eigenvalues, trace = values**2 / n, float((values**2).sum()) / n
    known = np.linalg.norm(directions, axis=0) > 0
    chosen = np.where(known, eigenvalues[: len(known)], 0.0)
    explained = eigenvalues[: len(known)] / trace if trace > 0 else np.zeros(len(known))
    found = Whitening(n, sums, directions, chosen, explained, None)
    weights = found.weights
    moments = _reduced(rows, lambda x: _moments(_centred(x, n, sums) @ weights), _pooled, size)
    covariance = (moments[1:, 1:] / n)[np.ix_(known, known)]
    error = float(np.abs(covariance - np.eye(len(covariance))).max()) if known.any() else None
    return Whitening(n, sums, directions, chosen, explained, error)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[Decimal | None]:
    """Sum over dimensions of ``(n x - S)²``, exact; null beyond 38 digits."""
    if n < 1 << 40 and float(np.abs(x).max()) * n < 2.0**62 and max(map(abs, sums)) < 1 << 62:
        gap = x * n - np.array(sums, dtype=np.int64)
        if float(np.abs(gap).max()) ** 2 * x.shape[1] < 2.0**62:
            return [Decimal(int(t)) for t in (gap * gap).sum(axis=1)]
    gap = x.astype(object) * n - np.array(sums, dtype=object)
    return [Decimal(int(t)) if t < 10**38 else None for t in (gap * gap).sum(axis=1)]


def apply(df: DataFrame, fitted: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, deviation, whitened) per usable row: an array of components, null where there is no variance."""
    n, sums, weights, d = fitted.rows, fitted.sums, fitted.weights, len(fitted.sums)
    known = fitted.eigenvalues > 0

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        for batch in batches:
            for places, x in whole(batch.column("v")):
                if x.shape[1] != d:
                    continue
                w = _centred(x, n, sums) @ weights
                nothing = np.broadcast_to(~known, w.shape).ravel()
                flat = pa.array(w.ravel(), pa.float64(), mask=nothing.copy())
                offsets = pa.array(np.arange(len(places) + 1, dtype=np.int32) * w.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k").take(pa.array(places)), pa.array(_deviations(x, n, sums), pa.decimal128(38, 0)),
                     pa.ListArray.from_arrays(offsets, flat)], names=["k", "deviation", "whitened"],
                )

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInArrow(
        whitened, f"k {kind}, deviation decimal(38,0), whitened array<double>"
    )
    return out.withColumnRenamed("k", key)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) per usable row and component.

    Rows whose vector is null, empty or holds a null, non-finite or too large entry (1024 c from 2^62 on)
    take no part, nor do vectors of another length than most have. Null and repeated keys keep
    their rows; repeated rows count each time. A component without variance (fewer rows than
    dimensions, constant entries) is explained as 0 to rounding and has null for ``whitened``;
    ``identity_error`` is over the others, null if there are none. A deviation of more than 38 digits is null.
    Equal eigenvalues share a space, in which any basis serves. An empty table gives an empty
    result. Other columns are not read.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fitted = fit(df, vector, components)
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema)
    shares = F.array(*[F.lit(float(s)) for s in fitted.explained])
    rows = apply(df, fitted, key, vector).select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        key, (F.col("at") + 1).cast("int").alias("component"), F.lit(fitted.rows).cast("bigint").alias("n"), "deviation",
        "whitened", shares[F.col("at")].alias("explained"), F.lit(fitted.identity_error).cast("double").alias("identity_error"),
    )
