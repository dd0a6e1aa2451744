"""Whole-column text work on the bytes of an Arrow batch: words, hashes, windows.

A batch is cut into blocks of some megabytes, so that the working arrays stay small whatever the
batch size; a text longer than a block is a block of its own. Words are maximal runs of the bytes that
a 256-entry table marks; every byte of a multi-byte character is above 0x7F, so tables over bytes
give the same words as patterns over characters. Words, windows and lines are compared by 64-bit
hashes (polynomial over the bytes, then mixed).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 500_000
U = np.uint64
BASE = 0x9E6C63D0876A9A4B  # odd
STEP = U(0xD6E8FEB86659FD93)


def _table(word: str) -> np.ndarray:
    out = np.ones(256, bool)
    if word == "blank":  # [^\x20\x09-\x0D]+
        out[[0x20, *range(0x09, 0x0E)]] = False
    else:  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
        out[:0x80] = False
        out[0x30:0x3A] = out[0x61:0x7B] = True
    return out


BLANK, ALNUM = _table("blank"), _table("alnum")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        z = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
        return z ^ (z >> U(31))


class _Powers:
    """BASE**i and its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                    x = np.full(n, U(base))
                    x[0] = 1
                    setattr(self, name, np.cumprod(x))
        return self.up, self.down


POWERS = _Powers()


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each run; runs are ordered and do not overlap."""
    out = np.empty(len(start), U)
    at = 0
    while at < len(start):
        base = start[at]
        stop = max(at + 1, int(np.searchsorted(end, base + BLOCK_BYTES, "right")))
        s, e = start[at:stop] - base, end[at:stop] - base
        n = int(e[-1])
        up, down = POWERS.get(n + 1)
        total = np.zeros(n + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum((data[base:base + n].astype(U) + U(1)) * up[:n], out=total[1:])
            out[at:stop] = (total[e] - total[s]) * down[s] + (e - s).astype(U) * STEP
        at = stop
    return mix(out)


class Block:
    """Rows [first, last) of a string column: their bytes and row bounds, from 0."""

    def __init__(self, first: int, last: int, data: np.ndarray, bounds: np.ndarray) -> None:
        self.first, self.last, self.data, self.bounds = first, last, data, bounds
        self.rows = last - first

    def words(self, table: np.ndarray, lower: bool) -> "Words":
        data = LOWER[self.data] if lower else self.data
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = table[data]
        begins = inside[1:] & ~inside[:-1]
        ends = ~inside[1:] & inside[:-1]
        cut = self.bounds[(self.bounds > 0) & (self.bounds < len(data))]
        joined = cut[inside[cut] & inside[cut + 1]]  # a word does not cross from row to row
        begins[joined] = ends[joined] = True
        start, end = np.flatnonzero(begins), np.flatnonzero(ends)
        return Words(data, start, end, np.searchsorted(start, self.bounds))


class Words:
    """Words of a block: byte spans, and for each row r the word range bounds[r]:bounds[r + 1]."""

    def __init__(self, data, start, end, bounds) -> None:
        self.data, self.start, self.end, self.bounds = data, start, end, bounds
        self.count = np.diff(bounds)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_runs(self.data, self.start, self.end)
        return self._hash

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def text(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every k consecutive words of a row."""
        n, h = len(self.start), self.hash
        if n < k:
            return np.empty(0, np.int64), np.empty(0, U)
        left = np.repeat(self.bounds[1:], self.count) - np.arange(n)
        at = np.flatnonzero(left >= k)
        return at, gram_hash([h[at + j] for j in range(k)])


def gram_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of word sequences, given the words' hashes place by place."""
    with np.errstate(over="ignore"):
        g = np.full(len(parts[0]), U(len(parts)))
        for p in parts:
            g = g * STEP + p
    return mix(g, 1)


def text_array(column) -> pa.Array:
    """A string column of a batch with nulls as empty texts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.fill_null("").cast(pa.large_string())


def blocks(column, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The rows of a string column in blocks of about ``limit`` bytes."""
    array = text_array(column)
    if not len(array):
        return
    _, offsets, values = array.buffers()
    bounds = np.frombuffer(offsets, np.int64)[array.offset:array.offset + len(array) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(array):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        lo, hi = bounds[first], bounds[last]
        yield Block(first, last, data[lo:hi], (bounds[first:last + 1] - lo).astype(np.int64))
        first = last


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each row's range."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
