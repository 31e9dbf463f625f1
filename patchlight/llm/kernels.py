"""Array code over the bytes of many texts at once: words, shingles, windows.

A batch of texts is one byte array and its offsets. Everything is linear in the bytes; wide temporaries exist for one block of
bytes at a time, so a very long text needs no more than its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 19
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, made where they are needed."""
    held = _POWERS.get(0)
    if held is None or len(held[0]) < n:
        size = 1 << max(int(BLOCK + 1).bit_length(), int(n).bit_length())
        tables = []
        for base in (_P, _PINV):
            table = np.full(size, base, U64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        held = _POWERS[0] = tuple(tables)
    return held


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes each; a longer text is a range of its own."""
    at = 0
    while at < len(offsets) - 1:
        to = max(int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1, at + 1)
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run of bytes that are not white space (tab to carriage return, space)."""
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = offsets[:-1][np.diff(offsets) > 0]
    first[cut] = solid[cut]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cut = cut[1:] - 1
    last[cut] = solid[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece; pieces are in order and do not overlap."""
    out = np.zeros(len(starts), U64)
    power, inverse = powers(BLOCK + 1)
    for base in range(0, len(data), BLOCK):
        block = data[base : base + BLOCK]
        i, j = np.searchsorted(ends, base, "right"), np.searchsorted(starts, base + len(block), "left")
        if i >= j:
            continue
        sums = np.zeros(len(block) + 1, U64)
        np.cumsum((block.astype(U64) + U64(1)) * power[: len(block)], out=sums[1:])
        s, e = np.maximum(starts[i:j] - base, 0), np.minimum(ends[i:j] - base, len(block))
        part = (sums[e] - sums[s]) * inverse[s]
        if starts[i] < base:
            part[:1] *= U64(pow(_P, int(base - starts[i]), 1 << 64))
        out[i:j] += part
    return mix(out ^ ((ends - starts).astype(U64) << U64(40)))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n numbers in a row (one for each start that has n)."""
    if len(h) < n:
        return np.zeros(0, U64)
    out, done, power, size = None, 0, h, 1
    m = 0xD6E8FEB86659FD93
    while True:
        if n & size:
            part = power[done : done + len(h) - n + 1]
            out = part.copy() if out is None else out * U64(pow(m, size, 1 << 64)) + part
            done += size
        if done == n:
            return mix(out)
        power = power[:-size] * U64(pow(m, size, 1 << 64)) + power[size:]
        size *= 2


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
