"""Singular values and right singular vectors of a small triangular factor.

Householder reflections take the factor to an upper bidiagonal form; differential quotient-difference
sweeps with shifts (dqds) find its singular values to high relative accuracy; twisted
factorisations of ``BᵀB - λ`` give the vector of each. Values too close for their vectors to come out
orthogonal are refined together by inverse iteration. Everything here has the size of the number of
dimensions, never of the number of rows.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
TINY = np.finfo(float).tiny
CLOSE = 1e-3  # relative gap below which vectors are made orthogonal to their neighbours
SWEEPS = 60  # sweeps a value; shifts that fail count, so this is far beyond need


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, beta, alpha) with ``(I - beta v vᵀ) x = alpha e1``."""
    norm = float(np.linalg.norm(x))
    if norm == 0.0:
        return np.zeros_like(x), 0.0, 0.0
    v = x.copy()
    alpha = -norm if x[0] >= 0 else norm
    v[0] -= alpha
    return v, 2.0 / float(v @ v), alpha


def bidiagonalised(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, P) with ``r = U B Pᵀ`` for a square ``r``; U is not kept."""
    a = r.astype(float).copy()
    d = a.shape[0]
    p = np.eye(d)
    for k in range(d):
        v, beta, alpha = _reflector(a[k:, k])
        if beta:
            a[k:, k:] -= np.outer(beta * v, v @ a[k:, k:])
        a[k, k], a[k + 1 :, k] = alpha, 0.0
        if k < d - 2:
            v, beta, alpha = _reflector(a[k, k + 1 :])
            if beta:
                a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, beta * v)
                p[:, k + 1 :] -= np.outer(p[:, k + 1 :] @ v, beta * v)
            a[k, k + 1], a[k, k + 2 :] = alpha, 0.0
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _sweep(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, int]:
    """One dqds sweep; the last item is where a pivot turned negative, or -1."""
    m = len(q)
    out_q, out_e = np.empty(m), np.empty(m - 1)
    d = q[0] - shift
    for i in range(m - 1):
        if d < 0.0:
            return out_q, out_e, i
        out_q[i] = d + e[i]
        ratio = q[i + 1] / out_q[i] if out_q[i] > 0.0 else 0.0
        out_e[i] = e[i] * ratio
        d = d * ratio - shift if out_q[i] > 0.0 else q[i + 1] - shift
    out_q[m - 1] = d
    return out_q, out_e, -1 if d >= 0.0 else m - 1


def _values(q: np.ndarray, e: np.ndarray) -> list[float]:
    """Squared singular values of the bidiagonal matrix of squares ``q`` (diagonal) and ``e``."""
    found: list[float] = []
    waiting = [(q, e, 0.0)]
    budget = SWEEPS * max(len(q), 1)
    while waiting:
        q, e, base = waiting.pop()
        while len(q) > 1:
            # Couplings that change nothing split the matrix or set its last value free.
            small = e <= EPS * EPS * (base + np.minimum(q[:-1], q[1:]))
            small |= e <= TINY
            if small.any():
                at = int(np.flatnonzero(small)[-1])
                waiting.append((q[: at + 1], e[:at], base))
                q, e = q[at + 1 :], e[at + 1 :]
                continue
            if q[0] < q[-1]:  # small values leave at the end
                q, e = q[::-1].copy(), e[::-1].copy()
            # The last pivot of an unshifted sweep bounds the least value from above; a shift that fails only
            # there is corrected by the failing pivot, any other is dropped.
            plain_q, plain_e, _ = _sweep(q, e, 0.0)
            shift = float(plain_q[-1]) * (1.0 - 2.0 * EPS)
            done = False
            for _ in range(3):
                if shift <= 0.0 or base + shift == base:
                    break
                next_q, next_e, failed = _sweep(q, e, shift)
                if failed < 0:
                    q, e, base, done = next_q, next_e, base + shift, True
                    break
                shift = shift + float(next_q[-1]) if failed == len(q) - 1 else shift / 4.0
            if not done:
                q, e = plain_q, plain_e
            budget -= 1
            if budget < 0:
                raise ArithmeticError("singular values did not converge")
        found.append(base + float(q[0]) if len(q) else base)
    return found


def singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Singular values of the bidiagonal matrix with diagonal ``a`` and superdiagonal ``b``, falling."""
    scale = max(float(np.abs(a).max(initial=0.0)), float(np.abs(b).max(initial=0.0)))
    if scale == 0.0:
        return np.zeros(len(a))
    squares = _values((a / scale) ** 2, (b / scale) ** 2)
    return scale * np.sqrt(np.sort(np.maximum(squares, 0.0))[::-1])


def _twisted(a: np.ndarray, b: np.ndarray, square: float) -> np.ndarray:
    """The unit vector of ``BᵀB - square``, from its factorisations met at the smallest pivot."""
    d = len(a)
    least = EPS * EPS * max(square, TINY)
    held = lambda x: x if abs(x) > least else -least
    down, up = np.empty(d), np.empty(d)  # differences of the pivots from those of BᵀB
    lower, upper = np.zeros(d), np.zeros(d)
    down[0] = -square
    for i in range(d - 1):
        pivot = held(down[i] + a[i] * a[i])
        lower[i] = a[i] * b[i] / pivot
        down[i + 1] = down[i] / pivot * (b[i] * b[i]) - square
    up[d - 1] = a[d - 1] * a[d - 1] - square
    gamma = np.empty(d)
    gamma[d - 1] = down[d - 1] + a[d - 1] * a[d - 1]
    for i in range(d - 2, -1, -1):
        pivot = held(b[i] * b[i] + up[i + 1])
        upper[i] = a[i] * b[i] / pivot
        ratio = up[i + 1] / pivot * (a[i] * a[i])
        up[i] = ratio - square
        gamma[i] = down[i] + ratio
    twist = int(np.abs(gamma).argmin())
    z = np.zeros(d)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(twist, d - 1):
        z[i + 1] = -upper[i] * z[i]
    return z / np.linalg.norm(z)


def _apart(a: np.ndarray, b: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Orthonormal vectors of close ``squares``: inverse iteration, each orthogonal to those before it."""
    d = len(a)
    t = np.diag(a * a + np.concatenate([[0.0], b * b]))
    t[np.arange(d - 1), np.arange(1, d)] = t[np.arange(1, d), np.arange(d - 1)] = a[:-1] * b
    rng = np.random.default_rng(7)
    out = np.zeros((d, 0))
    for j, square in enumerate(squares):
        # Moved off the value by a few roundings, so that equal values stay solvable.
        shifted = t - (square + (j + 2) * 4.0 * EPS * max(squares[0], TINY)) * np.eye(d)
        z = rng.standard_normal(d)
        for _ in range(5):
            for _ in range(2):
                z -= out @ (out.T @ z)
            z = np.linalg.solve(shifted, z / np.linalg.norm(z))
            z /= np.linalg.norm(z)
        for _ in range(2):
            z -= out @ (out.T @ z)
        out = np.column_stack([out, z / np.linalg.norm(z)])
    return out


def leading(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All singular values of ``r``, falling, and the right singular vectors of the first ``k`` as columns.

    A value that is zero to rounding has no vector of its own; its column is zero.
    """
    a, b, p = bidiagonalised(r)
    values = singular_values(a, b)
    scale = float(values[0]) if len(values) else 0.0
    vectors = np.zeros((len(a), min(k, len(a))))
    if scale == 0.0:
        return values, vectors
    a, b, squares = a / scale, b / scale, (values / scale) ** 2
    rank = int((values > 8 * len(a) * EPS * scale).sum())
    at = 0
    while at < min(k, rank):
        end = at + 1
        while end < rank and squares[end - 1] - squares[end] <= CLOSE * squares[end - 1]:
            end += 1
        group = _twisted(a, b, squares[at])[:, None] if end == at + 1 else _apart(a, b, squares[at:end])
        width = min(end, vectors.shape[1]) - at
        vectors[:, at : at + width] = group[:, :width]
        at = end
    full = p @ vectors
    return values, full / np.maximum(np.linalg.norm(full, axis=0), TINY)
