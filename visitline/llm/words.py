"""Whole-text word arrays without a Python object per word.

A word is a maximal run of characters other than ``\\x20 \\x09-\\x0D``, with ``A-Z`` in lower case. UTF-8
never uses those bytes inside a longer character, so words are found and hashed on the text bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20  # text bytes handled at a time; a longer single text is handled alone
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        table = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return table[:n]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` text bytes, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    start, done = 0, 0
    while start < len(lengths):
        stop = max(int(np.searchsorted(ends, done + limit, side="right")), start + 1)
        yield batch.slice(start, stop - start)
        done, start = int(ends[stop - 1]), stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the ``n + 1`` offsets of the texts in them; null is empty."""
    texts = pa.concat_arrays([pc.fill_null(texts, "")])  # own buffers, without the slice's offset
    if pa.types.is_large_string(texts.type):
        width = np.int64
    else:
        width = np.int32
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]] if len(offsets) else data[:0]
    return data, offsets - (offsets[0] if len(offsets) else 0)


@dataclass
class Words:
    data: np.ndarray  # lower-cased bytes
    begin: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    bounds: np.ndarray  # n + 1 positions: words of text i are bounds[i]:bounds[i + 1]

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return hash_runs(self.data, self.begin, self.end)

    def strings(self, which: np.ndarray) -> list[str]:
        raw = self.data.tobytes()
        return [raw[b:e].decode() for b, e in zip(self.begin[which].tolist(), self.end[which].tolist())]

    def string_array(self, which: np.ndarray) -> pa.StringArray:
        """The words at ``which``, copied without a Python object for each."""
        begin, sizes = self.begin[which], self.end[which] - self.begin[which]
        ends = np.cumsum(sizes)
        data = self.data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + sizes, sizes)]
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data))


def hash_runs(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs: differences of prefix sums of a polynomial, shifted back and mixed."""
    n = len(data)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n), out=sums[1:])
    back = _power_table(_BASE_INVERSE, n + 1)
    return mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64) * _STEP)


def find_words(texts: pa.Array) -> Words:
    data, offsets = text_bytes(texts)
    data = _LOWER[data]
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, begin, end, np.searchsorted(begin, offsets))


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words inside a text, and the bounds of the texts in that list.

    A text with 1 to k-1 words has one shingle, its whole sequence; one without words has none.
    """
    counts = np.diff(bounds)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    full = len(hashes) - k + 1
    rolled = np.zeros(max(full, 0), dtype=np.uint64)
    for j in range(k):
        rolled = mix(rolled + np.uint64(((j + 1) * int(_STEP)) & (2**64 - 1))) + hashes[j : j + len(rolled)] if len(rolled) else rolled
    rolled = mix(rolled)
    starts = np.repeat(bounds[:-1] - out_bounds[:-1], n) + np.arange(out_bounds[-1])
    out = np.zeros(len(starts), dtype=np.uint64)
    short = np.repeat(counts < k, n)
    out[~short] = rolled[starts[~short]]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        h = counts[i : i + 1].astype(np.uint64)
        for j in range(bounds[i], bounds[i + 1]):
            h = mix(h * _STEP + hashes[j : j + 1])
        out[out_bounds[i]] = h[0]
    return out, out_bounds


def list_column(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))
