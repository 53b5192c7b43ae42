"""Hashes of words and word shingles for whole Arrow batches, in numpy.

Word hashes are differences of one running polynomial over all bytes of a block of texts, so
no Python object is made per word. Arithmetic wraps at 64 bits; every hash is mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
BLOCK_BYTES = 2 << 20
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 5)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_LETTERS = np.random.default_rng(20240601).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_PLACES = np.random.default_rng(20240602).integers(0, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        size = max(n, BLOCK_BYTES + 1)
        held = np.full(size, base, dtype=np.uint64)
        held[0] = U(1)
        np.multiply.accumulate(held, out=held)
        if size <= 4 * BLOCK_BYTES:
            _powers[name] = held
    return held[:n]


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the base, to hash sequences by place."""
    return _power("base", _BASE, n)


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets) of runs of texts of at most BLOCK_BYTES, or of one longer text."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, index of each text's first word, byte place of every word)."""
    n = len(data)
    gap = np.ones(n + 2, dtype=bool)
    gap[1:-1] = _SPACE[data]
    begins = ~gap[1:-1] & gap[:-2]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begins[inner] |= ~gap[1:-1][inner]
    ends = ~gap[1:-1] & gap[2:]
    last = inner - 1
    ends[last] |= ~gap[1:-1][last]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_LETTERS[data] * _power("base", _BASE, n), out=total[1:])
    value = (total[stop] - total[start]) * _power("inverse", _INVERSE, n)[start] if n else np.zeros(0, np.uint64)
    value = mixed(value + (stop - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))
    return value, np.searchsorted(start, offsets), start


def shingles(word: np.ndarray, first: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle, index of each text's first shingle).

    A text of fewer than ``width`` words is one shingle of the words it has, an empty text one
    shingle of none.
    """
    n = np.diff(first)
    counts = np.maximum(n - width + 1, 1)
    start = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(len(n)), counts)
    at = first[:-1][text] + np.arange(start[-1]) - start[:-1][text]
    end = first[1:][text]
    out = np.zeros(len(at), dtype=np.uint64)
    padded = np.concatenate([word, np.zeros(width, dtype=np.uint64)])
    for j in range(width):
        inside = at + j < end
        out += np.where(inside, padded[np.minimum(at + j, len(word))] * _PLACES[j] + U(j + 1), U(0))
    return mixed(out), start


def counted(shingle: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The shingles as a bag: the c-th occurrence of a shingle in a text becomes an element of its own.

    Elements of a text come sorted by shingle, so equal bags give equal arrays of elements.
    """
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((shingle, text))
    s, t = shingle[order], text[order]
    fresh = np.ones(len(s), dtype=bool)
    fresh[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    place = np.arange(len(s)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(s) else np.zeros(0, np.int64)
    return mixed(s + place.astype(np.uint64) * U(0xA24BAED4963EE407))
