"""Whitening against a dense eigendecomposition, and the bidiagonal solver on hard matrices."""

import math

import numpy as np
import pytest

from evidentia.llm import bidiagonal, whitening
from tests.llm.queries_data import SF, has_tables

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string, k int, v string"


def frame(spark, vectors, keys=None):
    rows = [(i if keys is None else keys[i], v, 0, "clash", "clash", 1, "clash") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors):
    """Rows that count, exact deviations, eigenvalues and eigenvectors of the covariance."""
    usable = [i for i, v in enumerate(vectors) if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in vectors[i]] for i in usable]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    return usable, deviation, centred, values[::-1], directions[:, ::-1]


def check(spark, vectors, rank=None):
    usable, deviation, centred, values, directions = brute(vectors)
    rows = whitening.whiten(frame(spark, vectors)).collect()
    d = centred.shape[1]
    assert len(rows) == len(usable) * min(d, 8)
    rank = min(8, d if rank is None else rank)
    for j in range(min(d, 8)):
        part = {r["vec_id"]: r for r in rows if r["component"] == j + 1}
        assert sorted(part) == usable
        assert [int(part[i]["deviation"]) for i in usable] == deviation
        assert {r["n"] for r in part.values()} == {len(usable)}
        got = [part[i]["whitened"] for i in usable]
        if j >= rank:
            assert set(got) == {None}
            continue
        assert part[usable[0]]["explained"] == pytest.approx(values[j] / values.sum(), rel=1e-9)
        assert part[usable[0]]["identity_error"] < 1e-9
        want = centred @ directions[:, j] / np.sqrt(values[j])
        if np.dot(want, got) < 0:
            want = -want
        assert np.allclose(got, want, rtol=0, atol=1e-7)
    return rows


def vectors_of(seed, n, d):
    rng = np.random.default_rng(seed)
    spread = 1.5 ** -np.arange(d)
    return (rng.standard_normal((n, d)) * spread @ np.linalg.qr(rng.standard_normal((d, d)))[0]).astype(np.float32).tolist()


def test_equals_dense_eigenvectors(spark):
    check(spark, vectors_of(1, 400, 12))


def test_awkward_vectors(spark):
    vectors = vectors_of(2, 120, 5)
    vectors[3], vectors[4], vectors[5], vectors[6] = None, [], [1.0, None, 0.0, 0.0, 0.0], [1.0, float("nan"), 0.0, 0.0, 0.0]
    vectors[7] = [float("inf"), 0.0, 0.0, 0.0, 0.0]
    vectors[9] = vectors[8]
    vectors[10] = [0.0] * 5
    check(spark, vectors)


def test_fewer_rows_than_dimensions_and_constant_entries(spark):
    check(spark, vectors_of(3, 4, 6), rank=3)
    check(spark, [[1.0, 2.0]] * 5, rank=0)
    check(spark, [[0.5, -2.0]], rank=0)


def test_large_entries_stay_exact(spark):
    big = vectors_of(4, 50, 3)
    big[0] = [5e13, -3e13, 1e13]
    rows = whitening.whiten(frame(spark, big)).where("component = 1").collect()
    assert {r["vec_id"]: int(r["deviation"]) for r in rows} == dict(zip(*brute(big)[:2]))
    big[0] = [3e15, -2e15, 1e15]  # squares of more than 38 digits
    rows = whitening.whiten(frame(spark, big)).where("component = 1").collect()
    assert {r["vec_id"] for r in rows if r["deviation"] is None} == {0}


def test_other_lengths_and_too_large_entries_take_no_part(spark):
    vectors = [*vectors_of(5, 30, 4), [1.0, 2.0], [1e30, 0.0, 0.0, 0.0]]
    rows = whitening.whiten(frame(spark, vectors)).collect()
    assert {r["vec_id"] for r in rows} == set(range(30)) and {r["n"] for r in rows} == {30}


def test_null_and_repeated_keys_and_empty_table(spark):
    vectors = vectors_of(6, 20, 3)
    rows = whitening.whiten(frame(spark, vectors, [None, 1, 1, *range(3, 20)])).collect()
    assert len(rows) == 60 and sum(r["vec_id"] is None for r in rows) == 3 and sum(r["vec_id"] == 1 for r in rows) == 6
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [None, []])).collect() == []


def test_many_factors_meet_in_rounds(spark):
    vectors = vectors_of(8, 700, 4)
    one = whitening.fit(frame(spark, vectors).coalesce(1))
    many = whitening.fit(frame(spark, vectors).repartition(40))
    assert np.allclose(one.eigenvalues, many.eigenvalues, rtol=1e-12) and many.identity_error < 1e-9


HARD = {
    "random": np.random.default_rng(0).standard_normal((40, 40)),
    "identity": np.eye(12),
    "zero": np.zeros((4, 4)),
    "one": np.array([[3.0]]),
    "pairs": np.diag(np.repeat(np.arange(8, 0, -1.0), 2)) @ np.linalg.qr(np.random.default_rng(1).standard_normal((16, 16)))[0],
    "close": np.diag(1 + 1e-9 * np.arange(20)) @ np.linalg.qr(np.random.default_rng(2).standard_normal((20, 20)))[0],
    "graded": np.diag(10.0 ** -np.arange(25)) @ np.linalg.qr(np.random.default_rng(3).standard_normal((25, 25)))[0],
    "wilkinson": np.diag(np.abs(np.arange(-10, 11)).astype(float)) + np.eye(21, k=1) + np.eye(21, k=-1),
}


@pytest.mark.parametrize("name", HARD)
def test_bidiagonal_solver(name):
    r = np.linalg.qr(HARD[name], mode="r")
    values, vectors = bidiagonal.leading(r, 8)
    top = max(values[0], 1e-300)
    assert np.abs(values - np.linalg.svd(r, compute_uv=False)).max() <= 1e-14 * top
    known = np.linalg.norm(vectors, axis=0) > 0
    assert known.sum() == min(8, np.linalg.matrix_rank(r))
    used, squares = vectors[:, known], values[: vectors.shape[1]][known] ** 2
    assert np.abs(r.T @ r @ used - used * squares).max(initial=0) <= 1e-13 * top**2
    assert np.abs(used.T @ used - np.eye(used.shape[1])).max(initial=0) <= 1e-11


@pytest.mark.skipif(not has_tables(), reason="no test tables here")
def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("embedding").collect()
    vectors = [r[0] for r in rows]
    _, _, _, values, _ = brute(vectors)
    fitted = whitening.fit(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert np.allclose(fitted.eigenvalues, values[:8], rtol=1e-10) and fitted.identity_error < 1e-9
