"""Token counts: a count-only Viterbi pass over the matches of a unigram vocabulary, found by Aho-Corasick."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

#: A piece that no vocabulary entry covers scores this much below the least entry.
UNKNOWN_PENALTY = 10.0
#: Bytes of units whose counts a worker remembers (each with what a dictionary's entry takes), and characters of such a unit.
REMEMBERED, ENTRY, LONGEST_UNIT = 128 << 20, 150, 200
_MARK = "▁"


def model_pieces(path: str) -> tuple[list[tuple[str, float]], list[bool]]:
    """(piece, score) by id, and whether each is a byte, of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids], [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in ids]


class Counter(dict):
    """Counts pieces of the best unigram segmentation.

    Scores are added in double precision; of equal sums the one whose last piece starts first stays, as in the
    tokenizers library: pieces that end at a place are weighed from the longest on, and a later one must be
    strictly better. Where no entry is one character long there, that character may also stand for an unknown
    piece. Unknown pieces count as their UTF-8 bytes (bytes in the vocabulary) or as one for each run.

    A text is cut where no entry can span: before a space mark that follows another character, if no entry has
    one inside, and around newlines, if no entry has one. Best segmentations of the parts are then those of the
    whole, so the counts of parts (units) are remembered.
    """

    def __init__(self, pieces: Iterable[tuple[str, float]], skipped: Iterable[bool] = (), byte_fallback: bool = True) -> None:
        import ahocorasick

        super().__init__()
        pieces = list(pieces)
        left = [p for p, s in zip(pieces, skipped, strict=False) if not s] if skipped else pieces
        self.automaton = ahocorasick.Automaton()
        for piece, score in left:
            if piece and not self.automaton.exists(piece):
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max((len(p) for p, _ in left), default=1)
        self.held = 0
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.cut_marks = not any(re.search(f"[^{_MARK}]{_MARK}", p) for p, _ in left)
        self.cut_lines = not any("\n" in p for p, _ in left)
        self._units = re.compile(f"{_MARK}*[^{_MARK}\n]+|{_MARK}+|\n+" if self.cut_lines else f"{_MARK}*[^{_MARK}]+|{_MARK}+")

    def viterbi(self, text: str) -> int:
        """Pieces of the best segmentation; holds as many places as the longest entry has characters."""
        if not text:
            return 0
        ring = min(self.longest, len(text)) + 1
        best, count, unknown = [0.0] * ring, [0] * ring, [False] * ring  # by place, modulo ring; unknown: the last piece is one
        found = self.automaton.iter(text)
        last, match = next(found, (len(text), None))
        for at in range(len(text)):
            here = []
            while last == at:
                here.append(match)
                last, match = next(found, (len(text), None))
            if len(here) > 1:
                here.sort(reverse=True)
            total, pieces, odd, single = None, 0, False, False
            for length, score in here:  # longest, that is of the earliest start, first
                begin = (at + 1 - length) % ring
                own = best[begin] + score
                if total is None or own > total:
                    total, pieces = own, count[begin] + 1
                single = single or length == 1
            if not single:
                begin = at % ring
                own = best[begin] + self.unknown
                if total is None or own > total:
                    more = len(text[at].encode("utf-8", "surrogatepass")) if self.byte_fallback else int(not unknown[begin])
                    total, pieces, odd = own, count[begin] + more, True
            end = (at + 1) % ring
            best[end], count[end], unknown[end] = total, pieces, odd
        return count[len(text) % ring]

    def __missing__(self, unit: str) -> int:
        count = self.viterbi(unit)
        if len(unit) <= LONGEST_UNIT:
            self.held += 4 * len(unit) + ENTRY
            if self.held > REMEMBERED:
                self.clear()
                self.held = 0
            self[unit] = count
        return count

    def count(self, text: str) -> int:
        """Pieces of a text: a mark goes before it, and spaces become marks. An empty text has none."""
        if not text:
            return 0
        text = _MARK + text.replace(" ", _MARK)
        if not self.cut_marks:
            return self.viterbi(text)
        if self.byte_fallback or not self.cut_lines:
            return sum(self[m.group()] for m in self._units.finditer(text)) if len(text) > 1 << 20 else sum(map(self.__getitem__, self._units.findall(text)))
        return self.viterbi(text)  # runs of unknown pieces could join over a cut


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], skipped: list[bool], byte_fallback: bool = True) -> DataFrame:
    """(doc_id, n_tokens) of every document, by a vocabulary of (piece, score), which is broadcast (about 1 MB).

    Null and empty texts have 0; rows that repeat are counted each; an empty table gives no rows. Texts are
    neither normalised nor cut short; a very long one takes a few bytes a character and no more, even where no
    blank cuts it. With pieces and scores of a BPE model the counts are those of a unigram model over them,
    and no known tokenizer's.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((pieces, skipped))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*held.value, byte_fallback)
        for b in batches:
            n = pa.array([counter.count(t) for t in texts(b.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], ["doc_id", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_tokens long")
