"""Seeded hashes of whole arrays, the numbers that ``ordered.seeded_hash`` gives row by row."""

from __future__ import annotations

import math

import numpy as np

_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_WORDS = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_heads(block: np.ndarray, length: int) -> np.ndarray:
    """The first 60 bits of the md5 of each row's first ``length`` bytes, at most 55; the rest of a row is zero and overwritten."""
    n = len(block)
    block[:, length] = 0x80
    told: list = [*np.ascontiguousarray(block.view("<u4").T), *[None] * 16][:16]
    told[14] = np.uint32(length * 8)
    a, b, c, d = (np.full(n, x, dtype=np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            f = d ^ (b & (c ^ d))
        elif i < 32:
            f = c ^ (d & (b ^ c))
        elif i < 48:
            f = b ^ c ^ d
        else:
            f = c ^ (b | ~d)
        f += a
        f += _SINES[i]
        if told[_WORDS[i]] is not None:  # words of zeros add nothing
            f += told[_WORDS[i]]
        left = f << np.uint32(_SHIFTS[i])
        f >>= np.uint32(32 - _SHIFTS[i])
        left |= f
        left += b
        a, d, c, b = d, c, b, left
    high, low = (a + np.uint32(_START[0])).byteswap().astype(np.int64), (b + np.uint32(_START[1])).byteswap().astype(np.int64)
    return (high << 28) | (low >> 4)


def _by_width(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and decimal digits, as bytes, of the numbers (0 or more) of each length."""
    widths = np.array([len(str(v)) for v in values.tolist()])
    out = []
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        out.append((at, (values[at][:, None] // 10 ** np.arange(w - 1, -1, -1) % 10 + 48).astype(np.uint8)))
    return out


def seeded_hashes(seed: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """``seeded_hash(seed, first, second)`` of all pairs of two lists of numbers, a row per ``first``."""
    out = np.empty((len(first), len(second)), dtype=np.int64)
    head = np.frombuffer(f"{int(seed)}:".encode(), np.uint8)
    for rows, x in _by_width(first.astype(np.int64)):
        for cols, y in _by_width(second.astype(np.int64)):
            shape, ends = (len(rows), len(cols)), np.cumsum([len(head), x.shape[1], 1, y.shape[1]])
            if ends[-1] > 55:
                raise ValueError("a seed and its numbers have at most 55 bytes")
            block = np.zeros((*shape, int(ends[-1]) // 4 * 4 + 4), dtype=np.uint8)
            block[..., : ends[0]] = head
            block[..., ends[0] : ends[1]] = x[:, None]
            block[..., ends[1]] = ord(":")
            block[..., ends[2] : ends[3]] = y[None]
            out[np.ix_(rows, cols)] = _md5_heads(block.reshape(-1, block.shape[2]), int(ends[-1])).reshape(shape)
    return out
