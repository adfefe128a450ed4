"""Secret scans: known forms, and dictionary-primed zstandard novelty of strings in sensitive places."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

#: kind, pattern, group whose length counts, least length; in the order in which spans of one start are listed.
BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
NOVEL = "novel"
#: Words near which a string may be a secret, and what such a string is made of.
SENSITIVE = re.compile(r"(?i:pass(?:word|wd|phrase)|pwd|secret|token|credential|auth|api[ _-]?key|access[ _-]?key|private[ _-]?key|bearer|signature|signing)", re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST_CHARS = 16
_BEGIN, _HEADER, _FOOTER = "-----BEGIN", "-----", "-----END"
#: Characters of the text on both sides of a candidate that prime the compressor, besides the dictionary.
AROUND = 1024
#: Marginal compressed bytes for each of a candidate's characters from which on it is reported.
NOVELTY = 0.8
#: Identifiers and words of code that are no news to a reader; the dictionary is their text.
IDENTIFIERS = (
    "access_key account api_key application argument assert async attribute authorization await bearer boolean buffer "
    "callback certificate class client_id client_secret config configuration connection const container context "
    "controller credentials database default delete describe development document element encoding endpoint "
    "environment example exception export expected extends false final float function get handler hash header "
    "identifier implements import index instance integer interface internal isinstance iterator json kubernetes lambda "
    "length library localhost logger manager message metadata method middleware module namespace number object operator "
    "option override package parameter password path placeholder private production property protected provider public "
    "query raise range refresh_token register repository request required resource response result return schema secret "
    "select self server service session setting signature static status string struct template test this throw timeout "
    "token true type undefined update user username validate value variable version void warning while yield array block bucket byte cache channel check "
    "client code column count create data date directory entry error event field file filter for from group host http "
    "input item label layer limit line link list load lock map memory mode model name node order output page parse pool port "
    "process queue read record role route row rule size socket source start state step store stream table target task thread "
    "time url view worker write"
)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the known forms, leftmost and non-overlapping in each kind; short ones are dropped."""
    found = []
    for kind, pattern, group, least in BASE:
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), kind, m.end()))
    return found


class Novelty:
    """Marginal compressed bytes of a string in its surroundings, over a dictionary of identifiers."""

    def __init__(self, identifiers: str = IDENTIFIERS) -> None:
        import zstandard

        words = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=words, write_checksum=False, write_content_size=False)

    def __call__(self, text: str, start: int, end: int) -> float:
        """Bytes a character of text[start:end], after what stands around it."""
        around = text[max(0, start - AROUND) : start] + text[end : end + AROUND]
        before, own = around.encode("utf-8", "surrogatepass"), text[start:end].encode()
        return (len(self.compressor.compress(before + own)) - len(self.compressor.compress(before))) / len(own)


def sensitive_places(text: str) -> list[tuple[int, int]]:
    """[start, end) of the text near sensitive words, in order and apart: from the first on a line to the next line's end.

    After the header of a key block (PRIVATE KEY-----) it goes on to the block's footer.
    """
    places: list[tuple[int, int]] = []
    line = stop = block = -1  # ends of the current line, of the next one, and of a key block
    for word in SENSITIVE.finditer(text):
        if word.end() > line:
            line = text.find("\n", word.end())
            line = len(text) if line < 0 else line
            stop = text.find("\n", line + 1)
            stop = len(text) if stop < 0 else stop
        end = stop
        if text.startswith(_HEADER, word.end()) and text.rfind(_BEGIN, max(0, word.start() - 40), word.start()) >= 0:
            if block < word.end():
                block = text.find(_FOOTER, word.end() + len(_HEADER))
                block = len(text) if block < 0 else block
            end = max(end, block)
        if places and word.start() <= places[-1][1]:
            places[-1] = (places[-1][0], max(places[-1][1], end))
        else:
            places.append((word.start(), end))
    return places


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """[start, end) of the strings of mixed letters and digits near sensitive words; of an identifier, what follows its last one."""
    for lo, hi in sensitive_places(text):
        for m in CANDIDATE.finditer(text, lo, hi):
            start, end = m.span()
            own = m.group()
            for word in SENSITIVE.finditer(own):
                start = m.start() + word.end()
            while start < end and text[start] in "+/_=-":
                start += 1
            if end - start >= LEAST_CHARS and re.search("[0-9]", text[start:end]) and re.search("[A-Za-z]", text[start:end]):
                yield start, end


def novel_spans(text: str, novelty: Novelty, base: list[tuple[int, str, int]], least: float = NOVELTY) -> list[tuple[int, str, int]]:
    """Candidates that don't compress, outside base spans. Spans are apart, and a text is gone over once."""
    merged: list[list[int]] = []
    for s, _, e in sorted(base):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    starts = [s for s, _ in merged]
    found = []
    for start, end in candidates(text):
        k = bisect_right(starts, end - 1) - 1  # the last base span that begins before the candidate's end
        if (k < 0 or merged[k][1] <= start) and novelty(text, start, end) >= least:
            found.append((start, NOVEL, end))
    return found


def scan(docs: DataFrame, identifiers: str = IDENTIFIERS, least: float = NOVELTY) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>): secrets of every text, by start and then kind.

    Offsets are code points, ends exclusive. Known forms come first in any tie; what the compressor adds never
    overlaps them. Null and empty texts have no spans; rows that repeat are scanned each; an empty table gives
    no rows. Texts are scanned whole, in time that grows with their length.

    What the compressor adds: strings of 16 or more of [A-Za-z0-9+/_=-], with letters and digits, on a line
    with a sensitive word (after it) or on the next, or in a private key's block, that take at least NOVELTY
    bytes a character more after AROUND characters on either side and the dictionary. Of an identifier that
    holds a sensitive word, what follows the word. Shorter strings, words alone and other symbols stay out.
    """
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        rank = {kind: i for i, (kind, *_) in enumerate(BASE)} | {NOVEL: len(BASE)}
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            made = []
            for text in texts(b.column(1)):
                base = base_spans(text)
                spans = sorted(base + novel_spans(text, novelty, base, least), key=lambda s: (s[0], rank[s[1]]))
                made.append([{"kind": k, "start": s, "end": e} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")
