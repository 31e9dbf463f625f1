"""Removal of repeated passages with sharded phrase automata.

1. Recurring windows. Every window of `WINDOW` words is hashed; tasks pack (hash, place) entries by hash range, and the windows of
   a range meet in one task. A window that occurs more than once has a first occurrence (least id, then least start) and later ones.
2. Passages. Windows that have their first occurrence side by side in one document make one recurring passage. Its words are
   cut from that document and sent to the groups of documents that hold a later occurrence of one of its windows.
3. Automata. Documents are dealt into groups by id, each about one shuffle partition. A group's passages give one Aho-Corasick
   automaton: phrases of `SEED` words every `STRIDE` words, so that any window of a passage holds a whole phrase. All texts of the group
   stream through it; around each phrase found, the windows of document and passage are compared, so each passage occurrence is
   found from end to end. A window that starts later than the passage's own is removed.

A frequent passage goes once to each group, never all its occurrences to one task. Windows are compared by 64-bit hashes, phrases by
their words. Null and empty texts have no words. Rows with a null id are neither searched nor cut. Rows that share an id are searched each on its
own, and only a strictly smaller (id, start) counts as earlier, so repeated rows stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight.llm.common import width
from patchlight.llm.kernels import U64, grams, hashes, mix, slices, texts, words
from patchlight.llm.packed import bucket_of, bucket_parts, spread, spread_sorted, squeeze, squeeze_sorted

WINDOW, SEED = 20, 5
STRIDE = WINDOW - SEED + 1
BLOCK = 1_000_000


def _windows(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window hashes by start word (0 where a text ends before), the text of each word, the number of the first word of each text."""
    starts, ends, of = words(data, offsets)
    h = np.zeros(len(of), U64)
    if len(of) >= n:
        full = of[n - 1 :] == of[: len(of) - n + 1]
        h[: len(full)][full] = np.maximum(grams(hashes(data, starts, ends), n)[full], U64(1))
    return h, of, np.searchsorted(of, np.arange(len(offsets) - 1))


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    return bucket_of(mix(ids.view(U64) + U64(0x51ED2701)), groups)


def _pack(buckets: int, n: int):
    schema = pa.schema([("bucket", pa.int32()), ("window", pa.binary()), ("at", pa.binary()), ("ids", pa.binary()), ("first", pa.binary())])

    def emit(parts) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(p[0]) for p in parts])
        base = np.cumsum(sizes) - sizes
        h = np.concatenate([p[0] for p in parts])
        first = np.concatenate([p[1] + b for p, b in zip(parts, base, strict=True)])
        ids = np.concatenate([p[2] for p in parts])
        at = np.flatnonzero(h)
        at = at[np.argsort(h[at])]
        h, rows = h[at], []
        doc = np.searchsorted(first, at, "right") - 1
        for bucket, i, j in bucket_parts(h, buckets):
            used = np.unique(doc[i:j])
            rows.append({
                "bucket": bucket, "window": squeeze_sorted(h[i:j]), "at": squeeze(at[i:j].astype(np.uint32)), "ids": squeeze(ids[used]),
                "first": squeeze(first[used].astype(np.uint32)),
            })
        yield pa.RecordBatch.from_pylist(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b in slices(offsets):
                h, of, first = _windows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                some = np.flatnonzero(np.bincount(of, minlength=b - a))
                held.append((h, first[some], ids[a:b][some]))
                count += len(h)
                if count >= BLOCK:
                    yield from emit(held)
                    held, count = [], 0
        if count:
            yield from emit(held)

    return run, "bucket int, window binary, at binary, ids binary, first binary"


def _recurring(groups: int):
    """First occurrences of the recurring windows of one hash range, with the groups that hold later ones; packed by their own group."""
    schema = pa.schema([("grp", pa.int32()), ("ids", pa.binary()), ("start", pa.binary()), ("target", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        window, ids, start = [], [], []
        for row in table.to_pylist():
            at, first = spread(row["at"], np.uint32), spread(row["first"], np.uint32)
            doc = np.searchsorted(first, at, "right") - 1
            window.append(spread_sorted(row["window"]))
            ids.append(spread(row["ids"], np.int64)[doc])
            start.append((at - first[doc]).astype(np.int64))
        window, ids, start = map(np.concatenate, (window, ids, start))
        order = np.argsort(window, kind="stable")
        window = window[order]
        again = window[1:] == window[:-1]
        keep = np.append(again, False) | np.insert(again, 0, False)
        order, window = order[keep], window[keep]
        ids, start = ids[order], start[order]
        order = np.lexsort((start, ids, window))
        window, ids, start = window[order], ids[order], start[order]
        out = []
        if len(window):
            head = np.append(True, window[1:] != window[:-1])
            lead = np.flatnonzero(head)[np.cumsum(head) - 1]
            later = np.flatnonzero((ids != ids[lead]) | (start != start[lead]))
            pair = np.unique(lead[later].astype(np.int64) * groups + group_of(ids[later], groups))
            lead, target = pair // groups, (pair % groups).astype(np.uint32)
            own = group_of(ids[lead], groups)
            order = np.lexsort((start[lead], ids[lead], own))
            lead, target, own = lead[order], target[order], own[order]
            edge = np.flatnonzero(np.diff(own, prepend=-1))
            for i, j in zip(edge, np.append(edge[1:], len(own)), strict=True):
                out.append({
                    "grp": int(own[i]), "ids": squeeze(ids[lead[i:j]]), "start": squeeze(start[lead[i:j]].astype(np.uint32)), "target": squeeze(target[i:j]),
                })
        return pa.Table.from_pylist(out, schema)

    return run, "grp int, ids binary, start binary, target binary"


def _cut(n: int):
    """Words of the passages that begin in a group's documents, for each group that needs them."""
    schema = pa.schema([("grp", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("passage", pa.binary())])

    def run(docs: pa.Table, spec: pa.Table) -> pa.Table:
        out = []
        if spec.num_rows and docs.num_rows:
            rows = spec.to_pylist()
            ids = np.concatenate([spread(r["ids"], np.int64) for r in rows])
            start = np.concatenate([spread(r["start"], np.uint32) for r in rows]).astype(np.int64)
            target = np.concatenate([spread(r["target"], np.uint32) for r in rows]).astype(np.int64)
            order = np.lexsort((start, target, ids))
            ids, start, target = ids[order], start[order], target[order]
            new = np.append(True, (ids[1:] != ids[:-1]) | (target[1:] != target[:-1]) | (start[1:] != start[:-1] + 1))
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(ids)) - 1
            owner = ids[head]
            for doc_id, text in zip(docs["doc_id"].to_pylist(), docs["text"], strict=True):
                i, j = np.searchsorted(owner, (doc_id, doc_id), "left")[0], np.searchsorted(owner, doc_id, "right")
                if i < j and text.is_valid:
                    parts = text.as_py().encode("utf-8", "surrogatepass").split()
                    for k in range(i, j):
                        a, b = int(start[head[k]]), int(start[tail[k]]) + n
                        out.append({"grp": int(target[head[k]]), "doc_id": doc_id, "start": a, "passage": b" ".join(parts[a:b])})
        return pa.Table.from_pylist(out, schema)

    return run, "grp int, doc_id long, start long, passage binary"


class Passages:
    """An automaton over phrases of passages, and the window hashes of the passages."""

    def __init__(self, doc: list[int], start: list[int], passage: list[bytes], n: int):
        import ahocorasick

        data = np.frombuffer(b" ".join(passage), np.uint8)
        size = np.array([len(p) + 1 for p in passage], np.int64)
        self.window, of, first = _windows(data, np.append(0, np.cumsum(size) - (np.arange(len(size)) == len(size) - 1)), n)
        self.doc = np.array(doc, np.int64)[of]
        self.start = np.array(start, np.int64)[of] + np.arange(len(of)) - first[of]
        self.places: list[list[int]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, text in enumerate(passage):
            parts = text.decode("latin-1").split(" ")
            for at in range(0, len(parts) - SEED + 1, STRIDE):
                phrase = " " + " ".join(parts[at : at + SEED]) + " "
                number = self.automaton.get(phrase, -1)
                if number < 0:
                    number = len(self.places)
                    self.places.append([])
                    self.automaton.add_word(phrase, number)
                self.places[number].append(int(first[p]) + at)
        self.automaton.make_automaton()
        self.counts = np.array([len(p) for p in self.places])
        self.flat = np.array([x for p in self.places for x in p], np.int64)
        self.at = np.cumsum(self.counts) - self.counts

    def later(self, line: bytes, ends: np.ndarray, window: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Windows (by start word) that equal a window of a passage and start after it."""
        out = np.zeros(len(window), bool)
        hits = list(self.automaton.iter(line.decode("latin-1")))
        if not hits:
            return out
        hit = np.array(hits, np.int64)
        word = np.searchsorted(ends, hit[:, 0]) - SEED + 1
        many = self.counts[hit[:, 1]]
        base = np.repeat(self.at[hit[:, 1]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        i, j = np.repeat(word, many), self.flat[base]
        for back in range(STRIDE):
            a, b = i - back, j - back
            ok = (a >= 0) & (b >= 0)
            a, b = a[ok], b[ok]
            same = (window[a] == self.window[b]) & (window[a] != 0)
            a, b = a[same], b[same]
            after = (doc[a] > self.doc[b]) | ((doc[a] == self.doc[b]) & (start[a] > self.start[b]))
            out[a[after]] = True
        return out


def _locate(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def run(docs: pa.Table, passages: pa.Table) -> Iterator[pa.RecordBatch]:
        find = Passages(passages["doc_id"].to_pylist(), passages["start"].to_pylist(), passages["passage"].to_pylist(), n) if passages.num_rows else None
        data, offsets = texts(docs["text"])
        ids = docs["doc_id"].to_numpy()
        for a, b in slices(offsets, 1 << 20):
            split = [data[offsets[k] : offsets[k + 1]].tobytes().split() for k in range(a, b)]
            joined = [b" ".join(parts) for parts in split]
            removed = [0] * (b - a)
            if find is not None:
                line = b"".join(b" " + x + b" \n" for x in joined)
                whole = np.frombuffer(line, np.uint8)
                bounds = np.cumsum([0, *(len(x) + 3 for x in joined)])
                window, of, first = _windows(whole, bounds, n)
                ends = np.flatnonzero((whole == 32) & np.append(False, whole[:-1] != 32) & np.append(False, whole[:-1] != 10))
                # A text without words is two spaces: no end of a word.
                gone = find.later(line, ends, window, ids[a:b][of], np.arange(len(of)) - first[of])
                at = np.flatnonzero(gone)
                depth = np.zeros(len(of) + 1, np.int64)
                np.add.at(depth, at, 1)
                np.add.at(depth, at + n, -1)
                cover = np.cumsum(depth[:-1]) > 0
                some = np.bincount(of, cover, b - a).astype(int)
                for k in np.flatnonzero(some):
                    lo, size = int(first[k]), len(split[k])
                    joined[k] = b" ".join(compress(split[k], (~cover[lo : lo + size]).tolist()))
                    removed[k] = int(some[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[a:b]), pa.array([len(p) for p in split], pa.int64()), pa.array(removed, pa.int64()), pa.array(joined, pa.binary())], schema=schema
            )

    return run, schema


def remove_repeats(documents: DataFrame, n: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by spaces) of every row; digest=True: the hash of kept instead."""
    parts = 2 * width(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = rows.where("doc_id IS NOT NULL")
    pack, pack_schema = _pack(parts, n)
    recurring, recurring_schema = _recurring(parts)
    cut, cut_schema = _cut(n)
    locate, located = _locate(n)
    spec = known.mapInArrow(pack, pack_schema).groupBy("bucket").applyInArrow(recurring, recurring_schema)

    @F.pandas_udf("int")
    def grp(ids):
        import pandas as pd

        return pd.Series(group_of(np.ascontiguousarray(ids.to_numpy(np.int64)), parts))

    dealt = known.withColumn("grp", grp("doc_id"))
    passages = dealt.groupBy("grp").cogroup(spec.groupBy("grp")).applyInArrow(cut, cut_schema)

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not digest:
            return batch
        kept = pa.array([hashlib.sha256(x).hexdigest() for x in batch.column("kept").to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns[:3], kept], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        empty = finish(pa.RecordBatch.from_pylist([], located))
        return pa.Table.from_batches([finish(x) for x in locate(docs, found)] or [empty])

    def whole(batches):
        nothing = pa.Table.from_pylist([], pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("passage", pa.binary())]))
        for batch in batches:
            ids = pa.array(np.zeros(batch.num_rows, np.int64))
            for x in locate(pa.table({"doc_id": ids, "text": batch.column("text")}), nothing):
                x = finish(x)
                yield x.set_column(0, "doc_id", pa.nulls(x.num_rows, pa.int64()))

    result = "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "kept binary")
    out = dealt.groupBy("grp").cogroup(passages.groupBy("grp")).applyInArrow(run, result)
    return out.union(rows.where("doc_id IS NULL").mapInArrow(whole, result))
