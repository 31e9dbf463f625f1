"""Benchmark decontamination by template windows.

Texts are cut into tokens (letters, digits, bytes above 127; a point or comma between digits belongs to a number). Numbers, names
(tokens that begin with a capital) and units after a number become typed placeholders; other tokens stay, lower-cased. A window of
`WINDOW` tokens (the whole item, where it has fewer) is keyed twice: by its placeholders and words, and by
its case-folded words alone. A hit by words is a copy in whatever letter case. Document windows with a template key of the benchmark
are checked for slot consistency: two slots hold equal values in the document exactly where they
do in the item, so a question whose numbers and names were swapped one for one is caught, while the same words around values
that do not correspond are not. Windows with fewer than `LITERAL` plain words say too little as templates and are keyed by words only.

The benchmark's keys are held in every task only in slices of about `SLICE` windows (16 bytes each); a larger
benchmark takes one pass over the documents per slice. Documents are never shuffled; only hits are.

Items and texts that are null or hold no token match nothing; an item of few tokens is found wherever they follow each other, so a benchmark
of single words marks many documents. Items with the same windows are all reported. Repeated ids are
one document. Result: doc_id, item_id, n_windows (windows of the item found), n_item_windows, verbatim (some window has the same words, case aside).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight.llm.kernels import LOWER, U64, grams, hashes, mix, slices, texts, words

WINDOW, LITERAL = 13, 6
SLICE = 1_000_000
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb lbs oz ml l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month "
    "months year years percent dollars dollar cents cent euro euros pounds pound meters meter metres metre miles mile feet foot inches inch "
    "grams gram kilograms kilometers kilometres liters litres degrees mph kmh watts volts"
).split()

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_NUMBER, _NAME, _UNIT = (U64(x) for x in (0xA5A5A5A500000001, 0xA5A5A5A500000002, 0xA5A5A5A500000003))


def _piece_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]))
    return hashes(data, starts, ends)


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with spaces between tokens, and each token's start, end and text number."""
    keep = _TOKEN[data]
    if len(data) > 2:
        digit = (data >= 48) & (data <= 57)
        keep[1:-1] |= ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
        # Not across the border of two texts.
        edge = np.concatenate((offsets[1:-1], offsets[1:-1] - 1))
        edge = edge[(edge >= 0) & (edge < len(data))]
        keep[edge] = _TOKEN[data[edge]]
    clean = np.where(keep, data, np.uint8(32))
    return clean, *words(clean, offsets)


def _folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts case-folded. Folding maps token bytes to token bytes and leaves the others, so the tokens stay the same ones."""
    whole = data.tobytes()
    parts = [whole[a:b].decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token: template hash, hash of the case-folded word, whether it is a slot, and its text."""
    clean, starts, ends, of = _cut(data, offsets)
    if not len(starts):
        none = np.zeros(0, U64)
        return none, none, np.zeros(0, bool), of
    if (data > 127).any():
        raw = hashes(*_cut(*_folded(data, offsets))[:3])
    else:
        raw = hashes(LOWER[clean], starts, ends)
    first, second = clean[starts], clean[np.minimum(starts + 1, len(clean) - 1)]
    number = (first >= 48) & (first <= 57)
    capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
    after = np.zeros(len(starts), bool)
    after[1:] = number[:-1] & (of[1:] == of[:-1])
    unit = after & np.isin(raw, _UNIT_HASHES)
    template = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(capital, _NAME, raw)))
    return template, raw, number | unit | capital, of


_UNIT_HASHES = _piece_hashes(" ".join(UNITS))


def windows(template: np.ndarray, raw: np.ndarray, slot: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of n tokens: key by template, key by words, whether the template says too little, and start token."""
    if len(of) < n:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, bool), np.zeros(0, np.int64)
    inside = np.flatnonzero(of[n - 1 :] == of[: len(of) - n + 1])
    plain = np.concatenate(([0], np.cumsum(~slot)))
    weak = (plain[n:] - plain[:-n] < LITERAL)[inside]
    by_words = mix(grams(raw, n)[inside] ^ U64(0x5757))
    return mix(grams(template, n)[inside] ^ U64(n)), mix(by_words ^ U64(n)), weak, inside


def pattern(raw: np.ndarray, slot: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Which slots of each window hold equal values: the first slot with the same value, for each slot, as one number."""
    at = starts[:, None] + np.arange(n)
    values, is_slot = raw[at], slot[at]
    out = np.zeros(len(starts), U64)
    for j in range(n):
        equal = (values[:, : j + 1] == values[:, j : j + 1]) & is_slot[:, : j + 1]
        out = mix(out * U64(31) + np.where(is_slot[:, j], equal.argmax(1) + 1, 0).astype(U64))
    return out


def _lengths(of: np.ndarray, n: int) -> np.ndarray:
    """The window length of each text: WINDOW, or its own token count."""
    return np.minimum(np.bincount(of, minlength=n), WINDOW)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, n, key (by template), weak, shape (slot pattern), words (key by words), n_item_windows: one row per distinct window of each item."""

    def run(batches):
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            template, raw, slot, of = tokens(data, offsets)
            length = _lengths(of, batch.num_rows)
            for n in np.unique(length[length > 0]):
                key, by_words, weak, at = windows(template, raw, slot, of, int(n))
                mine = length[of[at]] == n
                key, by_words, weak, at = key[mine], by_words[mine], weak[mine], at[mine]
                yield pa.RecordBatch.from_pydict({
                    "item_id": batch.column("item_id").take(pa.array(of[at])), "n": np.full(len(at), n, np.int32), "key": np.where(weak, by_words, key).view(np.int64),
                    "weak": weak, "shape": pattern(raw, slot, at, int(n)).view(np.int64), "words": by_words.view(np.int64),
                })

    found = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL")
    found = found.mapInArrow(run, "item_id long, n int, key long, weak boolean, shape long, words long").distinct()
    sizes = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item_windows"))
    return found.join(sizes, "item_id")


def _member(sorted_keys: np.ndarray, key: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(key), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)] == key


def _hits(documents: DataFrame, by_template: np.ndarray, by_words: np.ndarray, lengths: list[int]) -> DataFrame:
    """doc_id, kind, key, shape of the distinct document windows with a key of the benchmark; what is hit by words has no shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            for a, b in slices(offsets, 2 << 20):
                template, raw, slot, of = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for n in lengths:
                    key, spoken, weak, at = windows(template, raw, slot, of, n)
                    for kind, hit in (("template", _member(by_template, key) & ~weak), ("words", _member(by_words, spoken))):
                        if hit.any():
                            where = at[hit]
                            yield pa.RecordBatch.from_pydict({
                                "doc_id": batch.column("doc_id").take(pa.array(of[where] + a)), "kind": [kind] * len(where),
                                "key": (key if kind == "template" else spoken)[hit].view(np.int64),
                                "shape": pattern(raw, slot, where, n).view(np.int64) if kind == "template" else np.zeros(len(where), np.int64),
                            })

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, kind string, key long, shape long").distinct()


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    items = item_windows(benchmark)
    n_slices = max(1, -(-items.count() // SLICE))
    own = F.struct("key", "shape", "words").alias("own")
    of_item = [F.col("item_id"), F.col("n"), F.col("n_item_windows"), own]
    probes = items.where("NOT weak").select(F.lit("template").alias("kind"), "key", "shape", *of_item).unionByName(
        items.select(F.lit("words").alias("kind"), F.col("words").alias("key"), F.lit(0).cast("long").alias("shape"), *of_item))
    found = None
    for i in range(n_slices):
        part = probes.where(F.pmod("key", F.lit(n_slices)) == i)
        got = part.select("kind", "key", "n").distinct().toArrow()
        kind, key = np.array(got["kind"].to_pylist(), object), got["key"].to_numpy().view(U64)
        by_template, by_words = (np.sort(key[kind == x]) for x in ("template", "words"))
        hits = _hits(documents, by_template, by_words, sorted({int(x) for x in got["n"].to_pylist()}))
        pairs = hits.join(part, ["kind", "key", "shape"])
        found = pairs if found is None else found.unionByName(pairs)
    return found.groupBy("doc_id", "item_id").agg(
        F.count_distinct("own").alias("n_windows"), F.max("n_item_windows").alias("n_item_windows"), F.max(F.col("kind") == "words").alias("verbatim"),
    )


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents without those in which a benchmark window was found; rows with a null id cannot be named and stay."""
    gone = contaminated(documents, benchmark).select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
