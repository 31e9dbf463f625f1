"""Removal of repeated byte strings with suffix arrays of shards.

1. Anchors. Each string of `LENGTH` bytes is represented by the least hash among the `GRAM`-byte strings inside it (the first of equal
   ones), so equal strings have equal anchors wherever they stand. Starts in a row with one anchor make a stretch, about
   170 starts. (anchor, content of the stretch) entries are packed by anchor range and meet in one task: anchors that occur once hold
   nothing repeated; stretches whose whole content recurs are repeated throughout and need no sorting.
2. Shards. What is left are anchors with different contents. The anchors of a range are dealt to shards of SHARD bytes; one stretch of each
   content is cut from its document and sent to its anchor's shard. Equal strings have equal anchors, so they meet in one shard.
3. Each shard's suffix array is built by induced sorting (suffixes.py), permuted common prefixes tell which starts share
   `LENGTH` bytes with a neighbour in the order.
4. Repeated starts go back to their documents, where the bytes they cover are removed.

An anchor with more than `FREQUENT` different contents (a passage in very many different documents) would make its shard grow: each of its
strings is then counted by its hash instead of sorted, combined within each task before the shuffle. Both go by one pass over the documents.

Documents are dealt to groups, anchors to ranges and strings to buckets whose numbers follow the bytes there are (GROUP_BYTES, BUCKET), so that a task's
share stays as it is when the data grow.

Null texts have 0 bytes. Rows with a null id are neither searched nor cut. Repeated rows repeat each other's strings; rows that share an id are taken
for repeats of one text (the bytes to compare come from one of them, what is found to repeat holds for all).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight.llm.common import settled, width
from patchlight.llm.kernels import U64, mix, powers, runs, slices, texts
from patchlight.llm.packed import bucket_of, bucket_parts, spread, spread_sorted, squeeze, squeeze_sorted
from patchlight.llm.phrases import group_of
from patchlight.llm.suffixes import common_prefixes, suffix_array

LENGTH, GRAM = 400, 64
FREQUENT = 1_024
#: A longer text is read in overlapping pieces of so many starts.
PIECE = 2 << 20
#: Stretches that a task packs together.
BLOCK = 200_000
#: Groups of documents for each shuffle partition at least, text bytes of a group at most, and bytes of a shard.
GROUPS, GROUP_BYTES, SHARD = 2, 32 << 20, 1 << 20
#: Strings of frequent anchors in a bucket.
BUCKET = 4_000_000
#: Bytes that one suffix array is built over (about 120 bytes each while it is built), or one anchor's, if these are more.
ARRAY = 1 << 19

def _prefix(data: np.ndarray) -> np.ndarray:
    power, _ = powers(len(data) + 1)
    return np.concatenate((np.zeros(1, U64), np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], dtype=U64)))


def _between(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of data[a:b]."""
    return mix((prefix[b] - prefix[a]) * powers(len(prefix))[1][a] ^ ((b - a).astype(U64) << U64(40)))


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of (text, from, to) ranges of bytes; long texts in pieces that overlap by length - 1."""
    for a, b in slices(offsets, 1 << 20):
        size = int(offsets[b] - offsets[a])
        if b - a > 1 or size <= PIECE + length:
            yield np.arange(a, b), offsets[a:b], offsets[a + 1 : b + 1]
        else:
            for at in range(0, size - length + 1, PIECE):
                lo = offsets[a] + at
                yield np.array([a]), np.array([lo]), np.array([min(lo + PIECE + length - 1, offsets[b])])


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, text, first start and number of starts of every stretch."""
    out = [[], [], [], [], []]
    for of, lo, hi in _pieces(offsets, length):
        part = data[lo[0] : hi[-1]]
        if len(part) < length:
            continue
        base = lo[0]
        prefix = _prefix(part)
        at = np.arange(len(part) - gram + 1)
        h = mix((prefix[gram:] - prefix[:-gram]) * powers(len(prefix))[1][at])
        w = length - gram + 1
        # The least leading bits, then the first place.
        key = (h & U64(0xFFFFFFFFFF000000)) | at.astype(U64)
        pad = np.full((-len(key)) % w, np.iinfo(np.uint64).max, U64)
        grid = np.append(key, pad).reshape(-1, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(key) - w + 1
        anchor = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & U64(0xFFFFFF)).astype(np.int64)
        owner = np.searchsorted(lo - base, np.arange(n), "right") - 1
        valid = np.arange(n) + length <= (hi - base)[owner]
        change = np.append(True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1]))
        first = np.flatnonzero(change)
        count = np.diff(np.append(first, n))
        keep = valid[first]
        first, count = first[keep], count[keep]
        place = anchor[first]
        content = mix(_between(prefix, first, first + count - 1 + length) + (place - first).astype(U64))
        for o, x in zip(out, (h[place], content, of[owner[first]], first + base - offsets[of[owner[first]]], count), strict=True):
            o.append(x)
    kinds = (U64, U64, np.int64, np.int64, np.int64)
    return tuple(np.concatenate([np.zeros(0, k), *o]).astype(k) for o, k in zip(out, kinds, strict=True))


def _pack(buckets: int, length: int, gram: int):
    names = ["bucket", "anchor", "content", "ids", "start", "count"]
    schema = pa.schema([("bucket", pa.int32()), *[(n, pa.binary()) for n in names[1:]]])

    def emit(parts) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        anchor, content, ids, start, count = (c[order] for c in columns)
        rows = [{
            "bucket": bucket, "anchor": squeeze_sorted(anchor[i:j]), "content": squeeze(content[i:j]), "ids": squeeze(ids[i:j]),
            "start": squeeze(start[i:j]), "count": squeeze(count[i:j]),
        } for bucket, i, j in bucket_parts(anchor, buckets)]
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(batches):
        held, total = [], 0
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            anchor, content, of, start, count = stretches(data, offsets, length, gram)
            held.append((anchor, content, ids[of], start, count))
            total += len(anchor)
            if total >= BLOCK:
                yield emit(held)
                held, total = [], 0
        if total:
            yield emit(held)

    return run, "bucket int, anchor binary, content binary, ids binary, start binary, count binary"


_CELLS = ("ids", "start", "count", "anchor", "open", "shard")
_TOLD = pa.schema([("grp", pa.int32()), ("kind", pa.int32()), *[(n, pa.binary()) for n in _CELLS], ("starts", pa.int64())])
_TOLD_SQL = "grp int, kind int, " + ", ".join(f"{n} binary" for n in _CELLS) + ", starts long"
#: Kinds of rows about stretches: repeated throughout; to be sorted in a shard; to be counted string by string.
REPEATED, SORT, COUNT = 0, 1, 2


def _told(kind: np.ndarray, ids, start, count, anchor, open_, groups: int, shard=None) -> pa.Table:
    grp = group_of(ids, groups)
    shard = np.zeros(len(ids), np.int64) if shard is None else shard
    order = np.lexsort((start, ids, kind, grp))
    grp, kind, ids, start, count, anchor, open_, shard = (c[order] for c in (grp, kind, ids, start, count, anchor, open_, shard))
    edge = np.flatnonzero(np.append(True, (grp[1:] != grp[:-1]) | (kind[1:] != kind[:-1]))) if len(grp) else []
    rows = [{
        "grp": int(grp[i]), "kind": int(kind[i]), "ids": squeeze(ids[i:j]), "start": squeeze(start[i:j]), "count": squeeze(count[i:j]),
        "anchor": squeeze(anchor[i:j]), "open": squeeze(open_[i:j].astype(np.uint8)), "shard": squeeze(shard[i:j]), "starts": int(count[i:j].sum()),
    } for i, j in zip(edge, np.append(edge[1:], len(grp)).astype(int), strict=True)] if len(grp) else []
    return pa.Table.from_pylist(rows, _TOLD)


def _repeated(ids: np.ndarray, start: np.ndarray, count: np.ndarray, groups: int) -> pa.Table:
    return _told(np.full(len(ids), REPEATED), ids, start, count, np.zeros(len(ids), U64), np.zeros(len(ids), bool), groups)


def _meet(groups: int, frequent: int, length: int):
    """The stretches of one anchor range: which are repeated throughout, and which must be compared, in which shard."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        anchor = np.concatenate([spread_sorted(r["anchor"]) for r in rows])
        content, ids, start, count = (
            np.concatenate([spread(r[c], k) for r in rows]) for c, k in (("content", U64), ("ids", np.int64), ("start", np.int64), ("count", np.int64))
        )
        order = np.lexsort((start, ids, content, anchor))
        anchor, content, ids, start, count = (c[order] for c in (anchor, content, ids, start, count))
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]))
        head = np.flatnonzero(new)
        copies = np.diff(np.append(head, len(anchor)))
        copied = np.repeat(copies > 1, copies)
        a = anchor[head]
        edge = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        kinds = np.diff(np.append(edge, len(a)))
        contents = np.repeat(kinds, kinds)
        sort = head[contents > 1]
        kind = np.where(contents[contents > 1] > frequent, COUNT, SORT)
        # An anchor's shard by the bytes of the anchors before it in the range.
        size = np.where(kind == SORT, count[sort] - 1 + length, 0)
        first = np.append(True, anchor[sort][1:] != anchor[sort][:-1]) if len(sort) else np.zeros(0, bool)
        before = (np.cumsum(size) - size)[first][np.cumsum(first) - 1] if len(sort) else size
        shard = (rows[0]["bucket"] << 24) + before // SHARD
        pick = np.concatenate((np.flatnonzero(copied), sort))
        none = np.zeros(int(copied.sum()), np.int64)
        return _told(
            np.concatenate((none + REPEATED, kind)), ids[pick], start[pick], count[pick], anchor[pick],
            np.concatenate((none.astype(bool), ~copied[sort])), groups, np.concatenate((none, shard)),
        )

    return run


#: Where rows about strings meet: shards as _meet numbers them, then buckets of hashes, then groups of documents for what needs no more work.
COUNTED, DONE = 1 << 60, 1 << 61
_SENT = pa.schema([("slot", pa.int64()), *[(n, pa.binary()) for n in ("anchor", "ids", "start", "count", "open", "bytes")]])
_SENT_SQL = "slot long, anchor binary, ids binary, start binary, count binary, open binary, bytes binary"


def _strings(data: np.ndarray, stretch: tuple[np.ndarray, ...], length: int, buckets: int) -> Iterator[dict]:
    """Every string of stretches of frequent anchors by its hash. What a task sees twice it reports at once and hands on once,
    so the entries of a string that meet are at most one per task; they are packed by hash range."""

    def emit(parts) -> Iterator[dict]:
        h, ids, start, open_ = map(np.concatenate, zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        h, ids, start, open_ = h[order], ids[order], start[order], open_[order]
        head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        many = np.diff(np.append(head, len(h)))
        seen = np.flatnonzero((np.repeat(many, many) > 1) & (open_ == 1))
        if len(seen):
            one = np.ones(len(seen), np.int64)
            yield {"slot": DONE + int(ids[seen[0]] % 1024), "ids": squeeze(ids[seen]), "start": squeeze(start[seen]), "count": squeeze(one)}
        h, ids, start, open_ = h[head], ids[head], start[head], np.where(many > 1, 0, open_[head]).astype(np.uint8)
        for bucket, i, j in bucket_parts(h, buckets):
            yield {"slot": COUNTED + bucket, "anchor": squeeze_sorted(h[i:j]), "ids": squeeze(ids[i:j]), "start": squeeze(start[i:j]), "open": squeeze(open_[i:j])}

    ids, start, count, open_, begin = stretch
    held, total = [], 0
    for i in range(0, len(ids), 500):
        j = min(i + 500, len(ids))
        size = count[i:j] - 1 + length
        at = np.cumsum(size) - size
        prefix = _prefix(np.concatenate([data[x : x + n] for x, n in zip(begin[i:j].tolist(), size.tolist(), strict=True)]))
        of = np.repeat(np.arange(i, j), count[i:j])
        step = np.arange(len(of)) - np.repeat(np.cumsum(count[i:j]) - count[i:j], count[i:j])
        where = at[of - i] + step
        held.append((_between(prefix, where, where + length), ids[of], start[of] + step, open_[of]))
        total += len(of)
        if total >= 5 * BLOCK:
            yield from emit(held)
            held, total = [], 0
    if total:
        yield from emit(held)


def _cut(length: int, buckets: int):
    """What the stretches asked for send out of a group of documents: contents to the shards, hashes of strings to the buckets."""

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        if not rows or not docs.num_rows:
            return pa.Table.from_pylist([], _SENT)
        ids, start, count, anchor, open_, shard = (
            np.concatenate([spread(r[c], k) for r in rows])
            for c, k in (("ids", np.int64), ("start", np.int64), ("count", np.int64), ("anchor", U64), ("open", np.uint8), ("shard", np.int64))
        )
        kind = np.repeat([r["kind"] for r in rows], [len(spread(r["open"], np.uint8)) for r in rows])
        data, offsets = texts(docs["text"])
        own = docs["doc_id"].to_numpy()
        by_id = np.argsort(own, kind="stable")
        place = by_id[np.minimum(np.searchsorted(own[by_id], ids), len(own) - 1)]
        there = (own[place] == ids) & (offsets[place] + start + count - 1 + length <= offsets[place + 1])
        ids, start, count, anchor, open_, shard, kind, place = (c[there] for c in (ids, start, count, anchor, open_, shard, kind, place))
        begin = offsets[place] + start
        strings = tuple(c[kind == COUNT] for c in (ids, start, count, open_, begin))
        out = list(_strings(data, strings, length, buckets))
        order = np.flatnonzero(kind == SORT)
        order = order[np.lexsort((anchor[order], shard[order]))]
        edge = np.flatnonzero(np.append(True, shard[order][1:] != shard[order][:-1])) if len(order) else []
        for i, j in zip(edge, np.append(edge[1:], len(order)).astype(int), strict=True) if len(order) else []:
            part = order[i:j]
            body = b"".join(data[x : x + c - 1 + length].tobytes() for x, c in zip(begin[part].tolist(), count[part].tolist(), strict=True))
            out.append({
                "slot": int(shard[part[0]]), "anchor": squeeze_sorted(anchor[part]), "ids": squeeze(ids[part]), "start": squeeze(start[part]),
                "count": squeeze(count[part]), "open": squeeze(open_[part]), "bytes": body,
            })
        return pa.Table.from_pylist(out, _SENT)

    return run


def _stretch_rows(rows: list[dict]) -> tuple[np.ndarray, ...]:
    return tuple(
        np.concatenate([spread(r[c], k) for r in rows]) for c, k in (("ids", np.int64), ("start", np.int64), ("count", np.int64), ("open", np.uint8))
    )


def repeated_starts(bodies: list[np.ndarray], length: int) -> np.ndarray:
    """For the bodies laid end to end with one mark between them: starts that share `length` symbols with another start."""
    size = np.array([len(b) for b in bodies])
    t = np.zeros(int(size.sum()) + len(bodies) + 1, np.uint16)
    at = np.cumsum(size + 1) - size - 1
    inside = np.ones(len(t), bool)
    inside[at + size] = False
    inside[-1] = False
    t[inside] = np.concatenate(bodies).astype(np.uint16) + 2
    t[at + size] = 1
    order = suffix_array(t, length)
    before, shared = common_prefixes(t, order)
    full = np.flatnonzero(shared >= length)
    out = np.zeros(len(t), bool)
    out[full] = True
    out[before[full]] = True
    return out


def _sort(rows: list[dict], groups: int, length: int) -> pa.Table:
    """Repeated starts of one shard, as runs. Anchors are independent of each other, so arrays are built for a few anchors at a time."""
    ids, start, count, open_ = _stretch_rows(rows)
    anchor = np.concatenate([spread_sorted(r["anchor"]) for r in rows])
    size = count - 1 + length
    cut = np.cumsum(size)
    data = np.split(np.concatenate([np.frombuffer(r["bytes"], np.uint8) for r in rows]), cut[:-1])
    order = np.argsort(anchor, kind="stable")
    ends = np.flatnonzero(np.append(anchor[order][1:] != anchor[order][:-1], True)) + 1
    found, i = [], 0
    while i < len(order):
        total = np.cumsum(size[order[i:]])
        fits = ends[(ends > i) & (ends <= i + np.searchsorted(total, ARRAY, "right"))]
        j = int(fits[-1]) if len(fits) else int(ends[ends > i][0])
        part = order[i:j]
        hit = repeated_starts([data[k] for k in part], length)
        at = np.cumsum(size[part] + 1) - size[part] - 1
        # Only starts of stretches that are not known to be repeated.
        ask = np.zeros(len(hit) + 1, np.int64)
        wanted = open_[part] == 1
        np.add.at(ask, at[wanted], 1)
        np.add.at(ask, (at + count[part])[wanted], -1)
        a, b = runs(hit & (np.cumsum(ask[:-1]) > 0))
        # A run ends with its stretch: the last bytes and the mark between two stretches are no starts asked for.
        of = np.searchsorted(at, a, "right") - 1
        found.append((ids[part][of], start[part][of] + a - at[of], b - a))
        i = j
    return _repeated(*map(np.concatenate, zip(*found, strict=True)), groups)


def _count(rows: list[dict], groups: int) -> pa.Table:
    """The strings of one hash range that more than one entry holds."""
    h = np.concatenate([spread_sorted(r["anchor"]) for r in rows])
    ids, start, open_ = (np.concatenate([spread(r[c], k) for r in rows]) for c, k in (("ids", np.int64), ("start", np.int64), ("open", np.uint8)))
    order = np.argsort(h, kind="stable")
    h = h[order]
    again = h[1:] == h[:-1]
    hit = order[(np.append(again, False) | np.insert(again, 0, False)) & (open_[order] == 1)]
    return _repeated(ids[hit], start[hit], np.ones(len(hit), np.int64), groups)


def _answer(groups: int, length: int):
    """What meets in a slot: a shard is sorted, a bucket counted, what is done is passed on."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if rows[0]["slot"] >= DONE:
            return _repeated(*(np.concatenate([spread(r[c], np.int64) for r in rows]) for c in ("ids", "start", "count")), groups)
        return _count(rows, groups) if rows[0]["slot"] >= COUNTED else _sort(rows, groups, length)

    return run


def _apply(length: int, digest: bool):
    last = ("kept_sha256", pa.string()) if digest else ("kept", pa.binary())
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), last])

    def show(x: bytes):
        return hashlib.sha256(x).hexdigest() if digest else x

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        data, offsets = texts(docs["text"])
        ids = docs["doc_id"].to_numpy(zero_copy_only=False)
        rows = [r for r in told.to_pylist() if r["kind"] == REPEATED] if told is not None else []
        owner, start, count = (np.concatenate([np.zeros(0, np.int64), *[spread(r[c], np.int64) for r in rows]]) for c in ("ids", "start", "count"))
        order = np.lexsort((start, owner))
        owner, start, count = owner[order], start[order], count[order]
        out = [[], [], []]
        for k in range(len(ids)):
            text = data[offsets[k] : offsets[k + 1]]
            i, j = (np.searchsorted(owner, ids[k], "left"), np.searchsorted(owner, ids[k], "right")) if rows else (0, 0)
            removed, spans = 0, 0
            if i < j:
                depth = np.zeros(len(text) + 1, np.int64)
                np.add.at(depth, np.minimum(start[i:j], len(text)), 1)
                np.add.at(depth, np.minimum(start[i:j] + count[i:j] - 1 + length, len(text)), -1)
                gone = np.cumsum(depth[:-1]) > 0
                spans, removed, text = len(runs(gone)[0]), int(gone.sum()), text[~gone]
            for o, x in zip(out, (removed, spans, show(text.tobytes())), strict=True):
                o.append(x)
        return pa.Table.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], last[1])],
            schema=schema,
        )

    return run, "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary")


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, frequent: int = FREQUENT, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes left) of every row; digest=True: the hash of kept instead."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(width(documents.sparkSession) * GROUPS, -(-size // GROUP_BYTES))
    known = rows.where("doc_id IS NOT NULL")
    pack, pack_sql = _pack(parts, length, gram)

    @F.pandas_udf("int")
    def grp(ids):
        import pandas as pd

        return pd.Series(group_of(np.ascontiguousarray(ids.to_numpy(np.int64)), parts))

    dealt = known.withColumn("grp", grp("doc_id"))
    told = settled(known.mapInArrow(pack, pack_sql).groupBy("bucket").applyInArrow(_meet(parts, frequent, length), _TOLD_SQL))
    strings = told.where(F.col("kind") == COUNT).agg(F.coalesce(F.sum("starts"), F.lit(0))).first()[0]
    asked = told.where(F.col("kind") != REPEATED)
    sent = dealt.groupBy("grp").cogroup(asked.groupBy("grp")).applyInArrow(_cut(length, max(parts, -(-strings // BUCKET))), _SENT_SQL)
    # Sorting is heavy for its bytes, so the number of tasks is said and not left to the sizes.
    found = told.where(F.col("kind") == REPEATED).union(sent.repartition(parts, "slot").groupBy("slot").applyInArrow(_answer(parts, length), _TOLD_SQL))
    apply, result = _apply(length, digest)
    out = dealt.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(apply, result)

    def whole(batches):
        for batch in batches:
            ids = pa.array(np.zeros(batch.num_rows, np.int64))
            for x in apply(pa.table({"doc_id": ids, "text": batch.column("text")}), None).to_batches():
                yield x.set_column(0, "doc_id", pa.nulls(x.num_rows, pa.int64()))

    return out.union(rows.where("doc_id IS NULL").mapInArrow(whole, result))
