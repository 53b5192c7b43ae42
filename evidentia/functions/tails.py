"""Tail probabilities Spark has no function for.

They run on result tables (one row per test), never on raw rows, as Arrow
batches. Every loop is a series that stops at double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_CHUNK = 4096


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lg = np.frompyfunc(math.lgamma, 1, 1)
    return (lg(a) + lg(b) - lg(a + b)).astype(float)


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    x, a, b = (np.asarray(v, dtype=float) for v in (x, a, b))
    swap = x > (a + 1.0) / (a + b + 2.0)
    xs, p, q = np.where(swap, 1.0 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    tiny = 1e-300
    c = np.ones_like(xs)
    d = 1.0 - (p + q) * xs / (p + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 10_000):
        even = m * (q - m) * xs / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * xs / ((p + 2 * m) * (p + 2 * m + 1))
        step = np.ones_like(h)
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if not np.any(np.abs(step - 1.0) >= 1e-15):
            break
    else:
        if np.any(np.abs(step - 1.0) >= 1e-12):
            raise ArithmeticError("the continued fraction did not converge")
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(xs) + q * np.log1p(-xs) - log_beta(p, q)) / p
    value = front * h
    value = np.where(xs <= 0.0, 0.0, value)
    return np.where(swap, 1.0 - value, value)


@F.pandas_udf(DoubleType())
def student_t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    """P(|T| >= |t|); missing in, missing out."""
    tv, dv = t.to_numpy(dtype=float), dof.to_numpy(dtype=float)
    out = np.full(len(tv), np.nan)
    ok = np.isfinite(tv) & np.isfinite(dv) & (dv > 0)
    if ok.any():
        out[ok] = incomplete_beta(dv[ok] / (dv[ok] + tv[ok] ** 2), dv[ok] / 2.0, np.full(ok.sum(), 0.5))
    out[np.isinf(tv) & (dv > 0)] = 0.0
    result = pd.Series(out, dtype=object)
    result[np.isnan(out)] = None
    return result


class _Margins:
    """Hypergeometric probabilities of the upper-left cell with fixed margins."""

    def __init__(self, a: int, b: int, c: int, d: int):
        self.row, self.col, self.n = a + b, a + c, a + b + c + d
        self.lo, self.hi = max(0, self.row + self.col - self.n), min(self.row, self.col)
        lg = math.lgamma
        self._const = (
            lg(self.row + 1) + lg(self.n - self.row + 1)
            + lg(self.col + 1) + lg(self.n - self.col + 1) - lg(self.n + 1)
        )

    def log_pmf(self, k: int) -> float:
        lg = math.lgamma
        return self._const - (
            lg(k + 1) + lg(self.row - k + 1) + lg(self.col - k + 1)
            + lg(self.n - self.row - self.col + k + 1)
        )

    def mode(self) -> int:
        k = (self.row + 1) * (self.col + 1) // (self.n + 2)
        return min(max(k, self.lo), self.hi)

    def outward(self, start: int, step: int) -> float:
        """Sum of the probabilities from ``start`` away in one direction."""
        end = self.hi if step > 0 else self.lo
        if (end - start) * step < 0:
            return 0.0
        level, total, k = self.log_pmf(start), 0.0, start
        while True:
            count = min(_CHUNK, abs(end - k))
            at = k + step * np.arange(count, dtype=float)
            rest = self.n - self.row - self.col
            if step > 0:
                odds = (self.row - at) * (self.col - at) / ((at + 1) * (rest + at + 1))
            else:
                odds = at * (rest + at) / ((self.row - at + 1) * (self.col - at + 1))
            logs = level + np.concatenate([[0.0], np.cumsum(np.log(odds))])
            terms = np.exp(logs)
            total += float(terms[:-1].sum()) if count else 0.0
            k += step * count
            level = float(logs[-1])
            past_peak = (k - self.mode()) * step >= 0
            if k == end or (past_peak and terms[-1] <= total * 1e-18):
                return total + float(terms[-1])

    def greater(self, a: int) -> float:
        if a <= self.lo:
            return 1.0
        if a <= self.mode():
            return 1.0 - self.outward(a - 1, -1)
        return min(1.0, self.outward(a, 1))

    def two_sided(self, a: int) -> float:
        """Sum over all outcomes no likelier than the observed one."""
        cut = self.log_pmf(a) + math.log1p(1e-7)
        peak = self.mode()
        if self.log_pmf(peak) <= cut:
            return 1.0
        # First outcome at or below the cut on each side; the law falls from the peak.
        right, left = self._crossing(peak, self.hi, cut), self._crossing(peak, self.lo, cut)
        total = 0.0
        if right is not None:
            total += self.outward(right, 1)
        if left is not None:
            total += self.outward(left, -1)
        return min(1.0, total)

    def _crossing(self, peak: int, end: int, cut: float) -> int | None:
        if self.log_pmf(end) > cut:
            return None
        above, below = peak, end
        while abs(below - above) > 1:
            mid = (above + below) // 2
            if self.log_pmf(mid) > cut:
                above = mid
            else:
                below = mid
        return below


def fisher_p(a: int, b: int, c: int, d: int, alternative: str = "greater") -> float:
    cells = _Margins(a, b, c, d)
    return cells.greater(a) if alternative == "greater" else cells.two_sided(a)


def fisher_udf(alternative: str):
    """Exact 2x2 test as a column function of the four cell counts."""
    if alternative not in ("greater", "two-sided"):
        raise ValueError("alternative must be 'greater' or 'two-sided'")

    @F.pandas_udf(DoubleType())
    def exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if pd.isna(w) or pd.isna(x) or pd.isna(y) or pd.isna(z)
                else fisher_p(int(w), int(x), int(y), int(z), alternative)
                for w, x, y, z in zip(a, b, c, d)
            ],
            dtype=object,
        )

    return exact


def rank_sum_counts(m: int, n: int, top: int) -> np.ndarray:
    """Share of arrangements of m among m + n with statistic 0..top (top <= m*n/2).

    The counts are the coefficients of the Gaussian binomial, built one member at a time.
    """
    ways = np.zeros(top + 1)
    ways[0] = 1.0
    for i in range(1, m + 1):
        if n + i <= top:
            ways[n + i:] -= ways[:top + 1 - n - i].copy()
        for r in range(min(i, top + 1)):
            ways[r::i] = np.cumsum(ways[r::i])
    return ways / math.comb(m + n, m)


def rank_sum_exact_p(u: float, n1: int, n0: int) -> float:
    """P(U >= u) without ties."""
    m, n = sorted((n1, n0))
    rest = m * n - int(u)  # by symmetry P(U >= u) = P(U <= m*n - u)
    if 2 * rest <= m * n:
        return float(rank_sum_counts(m, n, rest).sum()) if rest >= 0 else 0.0
    below = int(u) - 1
    return 1.0 - (float(rank_sum_counts(m, n, below).sum()) if below >= 0 else 0.0)


# Fixed value: up to this smaller group, and without ties, the exact law is used.
RANK_SUM_EXACT = 8


@F.pandas_udf(DoubleType())
def rank_sum_p(u: pd.Series, z: pd.Series, n1: pd.Series, n0: pd.Series, ties: pd.Series) -> pd.Series:
    """One-sided p of the rank-sum test: exact for small samples without ties, else normal."""
    out = []
    for uu, zz, a, b, t in zip(u, z, n1, n0, ties):
        if pd.isna(uu) or pd.isna(a) or pd.isna(b) or min(a, b) == 0:
            out.append(None)
        elif t == 0 and min(a, b) <= RANK_SUM_EXACT:
            out.append(rank_sum_exact_p(uu, int(a), int(b)))
        else:
            out.append(None if pd.isna(zz) else 0.5 * math.erfc(zz / math.sqrt(2.0)))
    return pd.Series(out, dtype=object)
