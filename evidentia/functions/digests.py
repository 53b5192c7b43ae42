"""MD5 of many short texts at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

LANES = 1 << 14  # digests that advance together: few calls, and their state stays in the processor's cache
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_TERMS = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def leading_md5(heads: Sequence[bytes], tails: np.ndarray) -> np.ndarray:
    """Heads x tails: the first eight bytes, as a number, of the MD5 of every head followed by every tail.

    Heads have one length and so have tails, the rows of an array of bytes. Numbers are ordered as the digests are.
    """
    before, n, m = len(heads[0]), len(tails), len(heads)
    size = before + tails.shape[1]
    blocks = (size + 8) // 64 + 1
    head, tail = np.zeros((m, 64 * blocks), np.uint8), np.zeros((n, 64 * blocks), np.uint8)
    head[:, :before] = np.frombuffer(b"".join(heads), np.uint8).reshape(m, before)
    tail[:, before:size], tail[:, size] = tails, 0x80
    tail[:, -8:] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
    head, tail = head.view("<u4"), np.ascontiguousarray(tail.view("<u4").T)
    out = np.empty((m, n), np.uint64)
    wide = max(1, LANES // max(min(n, LANES), 1))
    for s in range(0, n, LANES):
        for t in range(0, m, wide):
            part = tail[:, s:s + LANES]
            words = [_word(i, head[t:t + wide], part, before, size) for i in range(16 * blocks)]
            out[t:t + wide, s:s + LANES] = _leading(words, (len(head[t:t + wide]), part.shape[1]))
    return out


def _word(i: int, head: np.ndarray, tail: np.ndarray, before: int, size: int) -> np.ndarray:
    """Word ``i`` of the padded texts, no larger than what it depends on."""
    if 4 * i + 4 <= before:
        return head[:, i, None]
    if 4 * i > size:
        return tail[None, i, :1]
    return tail[None, i] if 4 * i >= before else head[:, i, None] | tail[None, i]


def _leading(words: Sequence[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    state = [np.full(shape, s, np.uint32) for s in _START]
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for block in range(0, len(words), 16):
        a, b, c, d = (s.copy() for s in state)
        for i in range(64):
            kind = i // 16
            if kind == 0:  # d ^ (b & (c ^ d))
                np.bitwise_xor(np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f), d, out=f)
                at = i
            elif kind == 1:  # c ^ (d & (b ^ c))
                np.bitwise_xor(np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f), c, out=f)
                at = (5 * i + 1) % 16
            elif kind == 2:
                np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
                at = (3 * i + 5) % 16
            else:  # c ^ (b | ~d)
                np.bitwise_xor(np.bitwise_or(np.invert(d, out=f), b, out=f), c, out=f)
                at = (7 * i) % 16
            np.add(f, a, out=f)
            np.add(f, words[block + at] + _TERMS[i], out=f)
            turn = _TURNS[kind][i % 4]
            np.left_shift(f, turn, out=g)
            np.right_shift(f, 32 - turn, out=f)
            np.bitwise_or(f, g, out=f)
            a, b, c, d = d, np.add(f, b, out=a), b, c
        state = [np.add(s, x, out=x) for s, x in zip(state, (a, b, c, d))]
    return (state[0].byteswap().astype(np.uint64) << np.uint64(32)) | state[1].byteswap()
