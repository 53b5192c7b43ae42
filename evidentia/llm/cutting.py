"""Cutting stock by column generation: patterns of item classes that fill a capacity.

Works on counts per class only, so its size is the number of classes whatever the number of
items. The linear program's dual prices go into an unbounded knapsack solved by dynamic
programming; the best pattern enters until none improves the bound. Patterns are then rounded
down and the few items left over are filled in greedily.
"""

from __future__ import annotations

import numpy as np

GAP = 1e-4
EPS = 1e-9


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of largest total price within the capacity (unbounded knapsack)."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    ordered, worth = sizes[order], prices[order]
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        fit = np.searchsorted(ordered, room, side="right")
        if fit:
            total = value[room - ordered[:fit]] + worth[:fit]
            k = int(np.argmax(total))
            if total[k] > value[room] + EPS:
                value[room], choice[room] = total[k], order[k]
    pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(value[capacity]), pattern


def relaxed(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(patterns, amounts, lower bound) of the linear program: fewest patterns that meet demand.

    Revised simplex over a basis of one pattern (or surplus column) per class. It ends when the
    knapsack's best value proves the amount to be within ``GAP`` of the least possible one.
    """
    n = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    cost = np.ones(n)
    inverse = np.diag(1.0 / np.diag(columns))
    amounts = inverse @ demand
    bound = 0.0
    while True:
        prices = cost @ inverse
        low = int(np.argmin(prices))
        if prices[low] < -1e-7:  # producing more than asked pays off: a surplus column enters
            entering, entering_cost = np.zeros(n), 0.0
            entering[low] = -1.0
        else:
            value, pattern = best_pattern(np.maximum(prices, 0.0), sizes, capacity)
            bound = max(bound, float(prices @ demand) / max(value, 1.0))
            if value <= 1.0 + 1e-7 or cost @ amounts <= bound * (1.0 + GAP) + EPS:
                return columns[:, cost > 0].T.astype(np.int64), amounts[cost > 0], bound
            entering, entering_cost = pattern.astype(float), 1.0
        step = inverse @ entering
        ratio = np.full(n, np.inf)
        np.divide(amounts, step, out=ratio, where=step > EPS)
        # Ties go to the smallest step index with the largest pivot: steady progress without cycling in practice.
        out = int(np.lexsort((-step, ratio))[0])
        moved = ratio[out]
        amounts = np.maximum(amounts - moved * step, 0.0)
        amounts[out] = moved
        columns[:, out], cost[out] = entering, entering_cost
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(items per class, how often)] holding at least ``counts[size]`` items of every size."""
    counts = {int(s): int(c) for s, c in counts.items() if c > 0}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("item sizes must lie between 1 and the capacity")
    sizes = np.array(sorted(counts))
    demand = np.array([counts[s] for s in sizes], dtype=float)
    columns, amounts, _ = relaxed(sizes, demand, capacity)
    whole = np.floor(amounts + 1e-6).astype(np.int64)
    out = [(c, int(k)) for c, k in zip(columns, whole) if k > 0]
    left = np.maximum(demand.astype(np.int64) - sum((c * k for c, k in out), np.zeros(len(sizes), dtype=np.int64)), 0)
    while left.any():  # at most one pattern per class was cut off, so this is short
        filled, room = np.zeros(len(sizes), dtype=np.int64), capacity
        for i in range(len(sizes) - 1, -1, -1):
            filled[i] = min(left[i], room // sizes[i])
            room -= filled[i] * sizes[i]
        times = int(np.min(left[filled > 0] // filled[filled > 0]))
        out.append((filled, times))
        left -= filled * times
    merged: dict[tuple[int, ...], int] = {}
    for c, k in out:
        merged[tuple(int(x) for x in c)] = merged.get(tuple(int(x) for x in c), 0) + k
    return [({int(s): a for s, a in zip(sizes, c) if a}, k) for c, k in sorted(merged.items())]
