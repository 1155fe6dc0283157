"""Whole texts as one UTF-8 buffer: word bounds and hashes for all rows of an Arrow batch at once.

Words are runs of bytes other than 0x20 and 0x09-0x0D. In UTF-8 those bytes are never part of a
longer character, so the bounds equal those found on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LONG_SPAN = 512  # bytes from which on a span is hashed by itself
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_WORD_BASE = U(0xD6E8FEB86659FD93)
_WORD_BACK = U(pow(int(_WORD_BASE), -1, 1 << 64))  # so a window's hash does not depend on its place
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, U)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 1 << 23:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the n + 1 bounds. Null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def parts(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, and one row at least: memory follows
    the longest text, not the number of rows in a batch."""
    if not batch.num_rows:
        return
    _, at = texts(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = min(max(int(np.searchsorted(at, at[first] + most, "right")) - 1, first + 1), first + 50_000)
        yield batch.slice(first, last - first)
        first = last


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


class Words:
    """Words of a block: ``start`` and ``end`` byte positions, ``row`` and a 64-bit ``hash`` of each;
    ``first[i]`` to ``first[i + 1]`` are those of row i."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, hashed: bool = True):
        self.raw, self.at = raw, at
        inside = np.zeros(len(raw) + 1, bool)
        inside[:-1] = ~SEPARATOR[raw]
        before = np.zeros(len(raw) + 1, bool)
        before[1:] = inside[:-1]
        before[at] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(raw) + 1, bool)
        after[:-1] = inside[1:]
        after[at[at > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, at)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        if hashed:
            self.hash = span_hash(raw, self.start, self.end)

    def windows(self, k: int) -> np.ndarray:
        """Index of the first word of each window of k words of one row."""
        if len(self.row) < k:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.row[: len(self.row) - k + 1] == self.row[k - 1 :])

    def window_hash(self, at: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each window of k words that starts at ``at``. Those of seed 1 are built on a second hash of the
        words, all others on their first."""
        codes, n = mix(span_hash(self.raw, self.start, self.end, 1) if seed == 1 else self.hash, seed), len(self.hash)
        pw = powers(_WORD_BASE, n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(codes * pw[:n], out=total[1:])
        return mix((total[at + k] - total[at]) * powers(_WORD_BACK, n + 1)[at], seed)


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span: its pieces of eight bytes go one after the other through the mixer, long spans
    through XXH64. Hashes of two seeds have no common structure, so what must not collide uses both."""
    size = end - start
    h = mix(size.astype(U), seed)
    view = np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))  # eight bytes from each place on
    long = size > LONG_SPAN
    at = np.flatnonzero((size > 0) & ~long)
    first = 0
    while len(at):
        rest = size[at] - first
        piece = view[start[at] + first] & _FIRST_BYTES[np.minimum(rest, 8)]
        h[at] = mix(h[at] ^ piece, seed)
        at = at[rest > 8]
        first += 8
    for i in np.flatnonzero(long).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]].tobytes(), seed + 1)
    return h


_BYTE_CODES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE_BASE = U(0x9E3779B97F4A7C15)
_BYTE_BACK = U(pow(int(_BYTE_BASE), -1, 1 << 64))


def quick_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A cheaper 64-bit hash of each span, a polynomial modulo 2**64: for lookups that compare the bytes afterwards."""
    n = len(raw)
    pw = powers(_BYTE_BASE, n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(_BYTE_CODES[raw] * pw[:n], out=total[1:])
    return mix((total[end] - total[start]) * powers(_BYTE_BACK, n + 1)[start] + (end - start).astype(U))
