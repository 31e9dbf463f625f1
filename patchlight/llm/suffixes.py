"""Suffix arrays by induced sorting and permuted common prefixes, as array code.

Induced sorting goes bucket by bucket (first symbol), and within a bucket in rounds over what the last round added, so every step is one array
operation on many suffixes; the number of steps depends on the alphabet and the longest run of one symbol, not on the text's length.
"""

from __future__ import annotations

import numpy as np

from patchlight.llm.kernels import U64, mix

#: The reduced string is sorted by the same routine while it has at most so many names; with more, buckets are too small to be worth an
#: array step each, and its suffixes are ranked by doubling.
NAMES = 512


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last suffix is."""
    step = np.sign(np.diff(t.astype(np.int32)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, 1)[at] > 0, True)


def _ranked(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by symbol, the sorted symbols' distinct values and counts, and each one's rank among equals."""
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    head = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    count = np.diff(np.append(head, len(s)))
    return order, s[head], count, np.arange(len(s)) - np.repeat(head, count)


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All suffixes from the leftmost-smaller ones in the given order (in the order of their first symbols at least)."""
    sa = np.full(len(t), -1, np.int64)
    head, tail = first.copy(), end.copy()
    _, value, count, rank = _ranked(t[lms])
    lms_at = end.copy()
    lms_at[value] -= count
    sa[np.repeat(lms_at[value], count) + rank] = lms

    def push(batch: np.ndarray, larger: bool) -> None:
        before = batch[batch > 0] - 1
        before = before[small[before] != larger]
        if not len(before):
            return
        order, value, count, rank = _ranked(t[before])
        if larger:
            sa[np.repeat(head[value], count) + rank] = before[order]
            head[value] += count
        else:
            sa[np.repeat(tail[value], count) - 1 - rank] = before[order]
            tail[value] -= count

    filled = np.flatnonzero(end > first)
    for c in filled:
        done = first[c]
        while done < head[c]:
            batch, done = sa[done : head[c]], head[c]
            push(batch, True)
        if lms_at[c] < end[c]:
            push(sa[lms_at[c] : end[c]], True)
    tail[0] -= 1
    sa[tail[0]] = len(t) - 1
    for c in filled[::-1]:
        done = end[c]
        while tail[c] < done:
            batch, done = sa[tail[c] : done][::-1], tail[c]
            push(batch, False)
        if first[c] < head[c]:
            push(sa[first[c] : head[c]][::-1], False)
    return sa


def _doubled(r: np.ndarray, depth: int | None) -> np.ndarray:
    """Order of the suffixes of a string by their first `depth` symbols at least (all, if None)."""
    rank, size, n = r.astype(np.int64), 1, len(r)
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - size] = rank[size:] + 1
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(False, k[1:] != k[:-1]))
        rank, size = new, size * 2
        if rank[order[-1]] == n - 1 or size >= n or depth is not None and size >= depth:
            return order


def suffix_array(t: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes of t in order; t ends with its only 0. With depth, suffixes equal in so many symbols may stand in any order."""
    n = len(t)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    size = np.bincount(t)
    end = np.cumsum(size)
    first = end - size
    small = _types(t)
    is_lms = np.append(False, small[1:] & ~small[:-1])
    lms = np.flatnonzero(is_lms)
    sa = _induce(t, small, lms[np.argsort(t[lms], kind="stable")], first, end)
    by_substring = sa[is_lms[sa]]
    # Names of the substrings from each leftmost-smaller position to the next, equal for equal ones.
    nxt = np.append(lms[1:], n - 1)
    sums = np.zeros(n + 1, U64)
    weight = mix(np.arange(1, int((nxt - lms).max()) + 2, dtype=U64))
    place = np.repeat(np.arange(len(lms)), np.diff(np.append(lms, n)))
    body = np.arange(lms[0], n) - lms[place]
    sums[lms[0] + 1 :] = np.cumsum(mix(t[lms[0] :].astype(U64) + U64(1)) * weight[np.minimum(body, len(weight) - 1)], dtype=U64)
    sums[: lms[0] + 1] = 0
    length = nxt - lms
    hashed = mix(sums[nxt] - sums[lms] + mix(t[nxt].astype(U64) + U64(77)) + mix(length.astype(U64) << U64(32)))
    number = np.empty(n, np.int64)
    number[lms] = np.arange(len(lms))
    order = number[by_substring]
    h = hashed[order]
    names = np.empty(len(lms), np.int64)
    names[order] = np.cumsum(np.append(False, h[1:] != h[:-1]))
    distinct = int(names[order[-1]]) + 1
    if distinct < len(lms):
        if distinct <= NAMES:
            order = suffix_array(names, depth)
        else:
            order = _doubled(names, depth)
    return _induce(t, small, lms[order], first, end)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position, the suffix before it in the order, and how many symbols they share.

    Where the symbols in front of both agree, the count is one less than that of the position before; only other positions are
    compared, four symbols at a time.
    """
    n = len(t)
    phi = np.full(n, n - 1, np.int64)
    phi[sa[1:]] = sa[:-1]
    padded = np.zeros(n + 8, np.uint16)
    padded[:n] = t
    four = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n + 4, 8), (2, 1))
    start = np.ones(n, bool)
    i = np.arange(1, n)
    p = phi[1:]
    start[1:] = (p == 0) | (t[i - 1] != t[p - 1])
    at = np.flatnonzero(start)
    shared = np.zeros(len(at), np.int64)
    open_ = np.flatnonzero(at != n - 1)
    a, b = at.copy(), phi[at]
    while len(open_):
        x = (np.ascontiguousarray(four[a[open_] + shared[open_]]).view(U64) ^ np.ascontiguousarray(four[b[open_] + shared[open_]]).view(U64)).ravel()
        more = (x & U64(0xFFFF) == 0).astype(np.int64) + (x & U64(0xFFFFFFFF) == 0) + (x & U64(0xFFFFFFFFFFFF) == 0) + (x == 0)
        shared[open_] += more
        open_ = open_[more == 4]
    plcp = np.zeros(n, np.int64)
    run = np.cumsum(start) - 1
    plcp = shared[run] - (np.arange(n) - at[run])
    return phi, np.maximum(plcp, 0)
