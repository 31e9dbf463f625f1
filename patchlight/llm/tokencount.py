"""Token counts by a count-only Viterbi search over a unigram vocabulary.

The tokenizer counted for is the unigram model of the `tokenizers` library over the pieces and scores of a public vocabulary file,
spaces marked and split off at the front of each segment, byte fallback for what no piece covers. An Aho-Corasick automaton
lists the pieces that end at each character, longest first; the search keeps, per character, the best score and the
piece count of the path that reached it. Rules that must hold for exact counts: an earlier start wins a tie (a later one replaces it only
with a strictly better score); a character that is no piece of its own may pass as unknown at the worst score less 10; unknown
characters in a row fall back to their bytes together, and a run that is just the unknown piece's own text is one token.

Segments repeat, so each task keeps counts of segments of up to `LONG` characters, `CACHE` characters of them at most. The search holds the last
`BLOCK` positions of a segment, of which a piece can reach back only its own length, so a text of many megabytes without a space takes no more
than a short one beside the text itself. The vocabulary (one file of fixed size) travels with the function. Null and empty texts have 0 tokens;
repeated rows are rows of their own; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
CACHE, LONG = 8_000_000, 200
BLOCK = 4_096
MARK = "▁"
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    unknown: int
    byte_fallback: bool


def read_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Pieces and scores of a sentencepiece file, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    return Vocabulary(
        tuple(model.id_to_piece(i) for i in range(n)), tuple(float(model.get_score(i)) for i in range(n)), model.unk_id(),
        any(model.is_byte(i) for i in range(n)),
    )


def counter(vocabulary: Vocabulary) -> Callable[[str], int]:
    """Tokens of one segment."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, (piece, score) in enumerate(zip(vocabulary.pieces, vocabulary.scores, strict=True)):
        if piece and not automaton.exists(piece):
            automaton.add_word(piece, (len(piece), score, i == vocabulary.unknown))
    automaton.make_automaton()
    low = min(vocabulary.scores) - UNKNOWN_PENALTY
    longest = max(map(len, vocabulary.pieces))
    to_bytes = vocabulary.byte_fallback

    def count(segment: str) -> int:
        n, base = len(segment), 0
        size = min(n, max(BLOCK, 2 * longest)) + 1
        score, done = [0.0] * size, [0] * size
        run, alone = [0] * size, [False] * size

        def closed(at: int) -> int:
            return done[at] + ((1 if alone[at] or not to_bytes else run[at]) if run[at] else 0)

        def unknown(end: int, start: int, text: str, piece: bool) -> None:
            alone[end] = piece and not run[start]
            run[end] = run[start] + len(text.encode("utf-8", "surrogatepass"))
            done[end] = done[start]

        def settle(end: int, found: list) -> None:
            nonlocal base
            end -= base
            if end == size:
                # The last positions that a piece can reach back to move to the front.
                for kept in (score, done, run, alone):
                    kept[:longest] = kept[end - longest :]
                run[longest:], alone[longest:] = [0] * (size - longest), [False] * (size - longest)
                base += end - longest
                end = longest
            best, start, as_unknown, single = None, 0, False, False
            for length, value, is_unknown in found:
                single |= length == 1
                candidate = score[end - length] + value
                if best is None or candidate > best:
                    best, start, as_unknown = candidate, end - length, is_unknown
            piece = as_unknown
            if not single and (best is None or score[end - 1] + low > best):
                best, start, as_unknown, piece = score[end - 1] + low, end - 1, True, False
            score[end] = best
            if as_unknown:
                unknown(end, start, segment[base + start : base + end], piece)
            else:
                done[end] = closed(start) + 1

        at, found = 0, []
        for last, match in automaton.iter(segment):
            while at <= last - 1:
                at += 1
                settle(at, found)
                found = []
            found.append(match)
        while at < n:
            at += 1
            settle(at, found)
            found = []
        return closed(n - base)

    return count


class Counts(dict):
    """Counts of segments seen, worked out on first sight; long ones are not kept, and all are forgotten when they are too many."""

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self.count, self.held = count, 0

    def __missing__(self, part: str) -> int:
        value = self.count(MARK + part)
        if len(part) <= LONG:
            self.held += len(part) + 1
            if self.held > CACHE:
                self.clear()
                self.held = len(part) + 1
            self[part] = value
        return value


def tokens(text: str | None, counts: Counts) -> int:
    if not text:
        return 0
    parts = text.replace(MARK, " ").split(" ")
    return sum(map(counts.__getitem__, parts[1:] if parts[0] == "" else parts))


def count_tokens(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens of every row."""

    def run(batches):
        counts = Counts(counter(vocabulary))
        for batch in batches:
            out = [tokens(value.as_py(), counts) for value in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(out, pa.int64())})

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")
