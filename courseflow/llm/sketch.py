"""A count-min sketch that is built in partitions, merged by blocks of cells, and asked one question:
may this hash occur twice or more? It overestimates, so a hash that does occur twice is never denied.

Each row of the sketch has 2**width cells, at most 2**MOST_WIDTH; what is broadcast is one bit a cell,
so ``rows * 2**MOST_WIDTH / 8`` bytes at most, whatever the input. Wider inputs only let more hashes
through to the exact pass. Tasks send the cells they touched as sorted gaps, a byte or so each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from courseflow.llm import textblock as tb

BLOCK_BITS, LEAST_WIDTH, MOST_WIDTH = 20, 20, 28
FLUSH = 2_000_000
MANY = 255  # touches of a cell in a flush from which on they are sent as a whole number


def width_for(count: int) -> int:
    """Cells for about half a hash each, within the fixed bounds."""
    return min(max(math.ceil(math.log2(max(2 * count, 2))), LEAST_WIDTH), MOST_WIDTH)


def cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return (tb.mix(hashes, 40 + row) >> np.uint64(64 - width)).astype(np.uint32)


def _pack(gaps: np.ndarray, counts: np.ndarray) -> bytes:
    """Their number, byte planes of 32-bit gaps, a byte for each count, and whole counts where a byte is not enough: the upper
    planes and the counts are nearly constant and compress away."""
    most = counts >= MANY
    planes = [gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel(), np.where(most, MANY, counts).astype(np.uint8), counts[most].astype("<u8").view(np.uint8)]
    return len(gaps).to_bytes(4, "little") + np.concatenate(planes).tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    planes, more = np.frombuffer(raw, np.uint8, 5 * n, 4).reshape(5, n), np.frombuffer(raw, "<u8", -1, 4 + 5 * n)
    counts = planes[4].astype(np.int64)
    counts[counts == MANY] = more
    return np.ascontiguousarray(planes[:4].T).view("<u4").ravel(), counts


def _partials(touched: list[list[np.ndarray]], width: int) -> Iterator[pa.RecordBatch]:
    for r, arrays in enumerate(touched):
        found = np.concatenate(arrays)
        arrays.clear()
        found.sort()
        first = np.concatenate([[True], found[1:] != found[:-1]])
        at = np.flatnonzero(first)
        unique, times = found[at], np.diff(np.append(at, len(found)))
        cut = np.searchsorted(unique, np.arange(1, 1 << (width - BLOCK_BITS), dtype=np.uint64) << np.uint64(BLOCK_BITS))
        block, payload = [], []
        for b, (u, t) in enumerate(zip(np.split(unique, cut), np.split(times, cut))):
            if len(u):
                inner = u - np.uint32(b << BLOCK_BITS)
                block.append(b)
                payload.append(_pack(np.diff(inner, prepend=np.uint32(0)), t))
        yield pa.RecordBatch.from_arrays([pa.array([r] * len(block), pa.int32()), pa.array(block, pa.int32()), pa.array(payload, pa.binary())], ["row", "block", "payload"])


def repeated(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], rows: int, width: int, hot: int = 0) -> np.ndarray:
    """Bits of the cells that were touched twice or more: an array (rows, 2**width / 8) of bytes. With
    ``hot`` a last row tells which cells of the first row were touched so often or more."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        touched, n = [[] for _ in range(rows)], 0
        for batch in batches:
            for h in hashes(batch):
                for r in range(rows):
                    touched[r].append(cells(h, r, width))
                n += len(h)
                if n >= FLUSH:
                    yield from _partials(touched, width)
                    n = 0
        if n:
            yield from _partials(touched, width)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, count = None, np.zeros(1 << BLOCK_BITS, np.int64)

        def done():
            out = [(at[0], at[1], np.packbits(count > 1).tobytes())]
            if hot and at[0] == 0 and count.max() >= hot:
                out.append((rows, at[1], np.packbits(count >= hot).tobytes()))
            r, b, p = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(b, pa.int32()), pa.array(p, pa.binary())], ["row", "block", "payload"])

        for batch in batches:
            for r, b, raw in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if at != (r, b):
                    if at is not None:
                        yield done()
                    at = (r, b)
                    count[:] = 0
                gaps, times = _unpack(raw)
                count[np.cumsum(gaps)] += times
        if at is not None:
            yield done()

    schema = "row int, block int, payload binary"
    merged = df.mapInArrow(build, schema).repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(merge, schema)
    bits = np.zeros((rows + bool(hot), 1 << (width - 3)), np.uint8)
    step = 1 << (BLOCK_BITS - 3)
    for r in merged.toLocalIterator():  # at most rows * 2**(MOST_WIDTH - BLOCK_BITS) blocks of 128 KB
        bits[r["row"], r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["payload"], np.uint8)
    return bits


def members(df: DataFrame, ids: Callable[[pa.RecordBatch], np.ndarray], count: int) -> np.ndarray:
    """Bits by which ``may_repeat`` passes every id of ``df`` and few others."""
    return repeated(df, lambda batch: iter([np.repeat(ids(batch), 2)]), 2, width_for(4 * count))  # each id counts twice


def width_of(bits: np.ndarray) -> int:
    return (bits.shape[-1] * 8).bit_length() - 1


def bit(bits: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (bits[c >> np.uint32(3)] >> (np.uint8(7) - (c & np.uint32(7)).astype(np.uint8))) & 1 == 1


def may_repeat(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each hash is estimated to occur twice or more."""
    width = width_of(bits)
    keep = np.ones(len(hashes), bool)
    for r in range(len(bits)):
        at = np.flatnonzero(keep)
        keep[at] = bit(bits[r], cells(hashes[at], r, width))
    return keep


def may_be_hot(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each hash is estimated to occur as often as ``hot`` says; ``bits`` is the last row of a sketch."""
    return bit(bits, cells(hashes, 0, width_of(bits)))
