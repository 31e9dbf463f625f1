"""Arrays as compressed cells, so that a shuffle moves a few large rows instead of one row per number."""

from __future__ import annotations

import numpy as np
import zstandard

from patchlight.llm.kernels import U64

_LEVEL = 1


def squeeze(a: np.ndarray) -> bytes:
    """Bytes of equal weight stand together, which is what makes sorted or small numbers shrink."""
    raw = np.ascontiguousarray(a)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T
    return zstandard.ZstdCompressor(level=_LEVEL).compress(np.ascontiguousarray(planes).tobytes())


def spread(cell: bytes, dtype) -> np.ndarray:
    kind = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def squeeze_sorted(a: np.ndarray) -> bytes:
    return squeeze(np.diff(a, prepend=U64(0)))


def spread_sorted(cell: bytes) -> np.ndarray:
    return np.cumsum(spread(cell, U64), dtype=U64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by the leading bits, so that numbers sorted by value are sorted by bucket."""
    return ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)


def bucket_parts(sorted_hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the filled buckets of sorted numbers."""
    b = bucket_of(sorted_hashes, buckets)
    at = np.flatnonzero(np.diff(b, prepend=-1))
    return [(int(b[i]), int(i), int(j)) for i, j in zip(at, np.append(at[1:], len(b)), strict=True)]
