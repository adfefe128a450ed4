"""Substring deduplication: hashed runs of consecutive sentences, joined globally; repeats of a run go."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, saved, small_batches, texts, wide_batches

#: Words that a run of sentences has at least.
MIN_WORDS = 25
#: Blanks that a sentence has before it is cut, and the words of a window, of which one ends a cut at least.
LONG, WINDOW = 16, 12
_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+|\n|$)[^\S\n]*")
_WORD = re.compile(r"\w+")
_RUN = re.compile(r"(\S+)\s*")
_BLANK, _OTHER = re.compile(r"[^\S\n]"), re.compile(r"[^\S\n ]")


def winnowed(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Positions of the least hash of every window, the rightmost of equal ones unless the one before still holds."""
    out, best = [], -1
    for i, h in enumerate(hashes):
        if best <= i - window:  # the least has left the window
            begin = max(0, i - window + 1)
            some = hashes[begin : i + 1]
            best = i - some[::-1].index(min(some))
        elif h < hashes[best]:
            best = i
        if i >= window - 1 and (not out or out[-1] != best):
            out.append(best)
    return out


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, key) of each sentence: up to its stops or newline, with the blanks after them; key: its words.

    A sentence with LONG blanks or more is cut by winnowing: after the word of least hash of every WINDOW
    words. Those cuts fall alike in every copy of a passage, wherever it was put in, and are at most WINDOW
    words apart; a passage of one word over and over is cut every WINDOW words, and its pieces are alike.
    """
    found = []
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is two characters stays, so that places agree
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    other = _OTHER.search(text)  # blanks are counted one by one only where some aren't spaces
    for m in _SENTENCE.finditer(text):
        start, end = m.span()
        if start == end:
            continue
        if (len(_BLANK.findall(m.group())) if other else m.group().count(" ")) >= LONG:
            runs_ = list(_RUN.finditer(low, start, end))
            for k in winnowed([crc32(w[1].encode("utf-8", "surrogatepass")) for w in runs_]):
                mark = runs_[k].end()
                if mark < end:
                    found.append((start, mark, " ".join(_WORD.findall(low, start, mark))))
                    start = mark
        found.append((start, end, " ".join(_WORD.findall(low, start, end))))
    return found


def runs(counts: list[int], least: int) -> list[tuple[int, int]]:
    """[first, last + 1) of the shortest run of sentences from each one on, and up to each one, of least words."""
    n = len(counts)
    total = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(n)
    end = np.searchsorted(total, total[:-1] + least)  # the least end with enough words from first on
    forward = [(int(a), int(b)) for a, b in zip(first, end, strict=True) if b <= n]
    begin = np.searchsorted(total, total[1:] - least, side="right") - 1  # the latest begin with enough words
    backward = [(int(a), int(b)) for a, b in zip(begin, first + 1, strict=True) if a >= 0 and total[b] - total[a] >= least]
    return sorted(set(forward + backward))


def _digests(text: str, min_words: int) -> Iterator[tuple[bytes, int, int]]:
    """(hash, first, last) of each run of a text's sentences; a run begins and ends with words, so it has one place."""
    keys = [k for _, _, k in sentences(text)]
    worded = [i for i, k in enumerate(keys) if k]
    for a, b in runs([keys[i].count(" ") + 1 for i in worded], min_words):
        yield _hash([keys[i] for i in worded[a:b]]), worded[a], worded[b - 1]


def _hash(keys: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(keys).encode("utf-8", "surrogatepass"))[:12]


def spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(h1, h2, doc_id, row, first, last, again): a 96-bit hash of each run of sentences, by the sentences' numbers.

    again: the row has the same run before, so this one goes whatever other documents hold.
    """
    small_batches(docs.sparkSession)
    names = ["h1", "h2", "doc_id", "row", "first", "last", "again"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, owners, firsts, lasts, agains = [], [], [], [], []
            for i, text in enumerate(texts(b.column(2))):
                seen: set[bytes] = set()
                for digest, first, last in _digests(text, min_words):
                    agains.append(digest in seen)
                    seen.add(digest)
                    digests.append(digest)
                    owners.append(i)
                    firsts.append(first)
                    lasts.append(last)
            h = np.frombuffer(b"".join(digests), np.dtype([("h1", ">i8"), ("h2", ">i4")]))
            own = pa.array(owners, pa.int64())
            columns = [pa.array(h["h1"].astype(np.int64)), pa.array(h["h2"].astype(np.int32)), b.column(0).take(own), b.column(1).take(own)]
            columns += [pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32()), pa.array(agains, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = keyed(docs).where("doc_id IS NOT NULL")
    return rows.mapInArrow(each, "h1 long, h2 int, doc_id long, row long, first int, last int, again boolean")


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h1, h2, doc_id): those whose hash an earlier document of the task has (kind 0).

    The task's first hash may have begun in another task: its rows wait (kind 1). Its least document, and the
    least of the last hash, which may go on in another task, are told (kind 2).
    """
    names, kinds = ["kind", "h1", "h2", "doc_id", "first", "last"], (np.int8, np.int64, np.int32, np.int64, np.int32, np.int32)

    def out(*columns) -> pa.RecordBatch:
        n = len(columns[3])
        full = (x if isinstance(x, np.ndarray) else np.full(n, x) for x in columns)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(full, kinds, strict=True)], names)

    opening, run, home, least = None, None, 0, 0
    for b in batches:
        h1, h2, doc, first, last = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        if not len(h1):
            continue
        if run is None:
            opening, least = (int(h1[0]), int(h2[0])), int(doc[0])
        new = np.concatenate([[(int(h1[0]), int(h2[0])) != run], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(doc)), -1))
        homes = np.where(begin >= 0, doc[np.maximum(begin, 0)], home)
        wait = (h1 == opening[0]) & (h2 == opening[1])
        gone = (doc > homes) & ~wait
        if gone.any():
            yield out(0, h1[gone], h2[gone], doc[gone], first[gone], last[gone])
        if wait.any():
            yield out(1, h1[wait], h2[wait], doc[wait], first[wait], last[wait])
        run, home = (int(h1[-1]), int(h2[-1])), int(homes[-1])
    if run is not None:
        yield out(2, *opening, np.array([least]), 0, 0)
        if run != opening:
            yield out(2, *run, np.array([home]), 0, 0)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, gone array<struct<first, last, mark, own>>): sentence runs whose words occur earlier, by (doc_id, place).

    Every sentence begins a run, the shortest of at least min_words words, and ends one; so each sentence of a
    repeated passage that has so many words in whole sentences is covered. Runs are joined globally by one
    shuffle: range-partitioned by (hash, document), so a run that very many documents hold is spread over many
    tasks, and streamed in that order. What a task can't tell alone, of its first hash, is settled by at most two
    rows a task, which are broadcast. Of the overlapping runs of a document, the union goes.

    A run is of that row of its doc_id alone whose text it came from: mark is the row's key where the row
    itself has the run before (own), and else the run's hash, which the row's own words must give again.
    """
    every = saved(spans(docs, min_words), "spans")
    fresh = every.where("NOT again").select("h1", "h2", "doc_id", "first", "last")
    ordered = fresh.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id")
    with wide_batches(docs.sparkSession):
        found = saved(ordered.mapInArrow(_later, "kind byte, h1 long, h2 int, doc_id long, first int, last int"), "repeats")
    home = F.broadcast(found.where("kind = 2").groupBy("h1", "h2").agg(F.min("doc_id").alias("home")))
    late = found.where("kind = 1").join(home, ["h1", "h2"]).where("doc_id > home")
    run = ["doc_id", "first", "last", F.col("h1").alias("mark"), F.lit(False).alias("own")]
    gone = found.where("kind = 0").select(*run).union(late.select(*run))
    gone = gone.union(every.where("again").select("doc_id", "first", "last", F.col("row").alias("mark"), F.lit(True).alias("own")))
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("first", "last", "mark", "own"))).alias("gone"))


def _gone(keys: list[str], row: int, runs_: list[dict]) -> np.ndarray:
    """Which of a row's sentences go: those of the runs that are its own, or whose hash its words give."""
    drop = np.zeros(len(keys) + 1, np.int32)
    for r in runs_:
        first, last = r["first"], r["last"]
        if r["own"]:
            mine = r["mark"] == row
        else:
            mine = last < len(keys) and int.from_bytes(_hash([k for k in keys[first : last + 1] if k])[:8], "big", signed=True) == r["mark"]
        if mine:
            drop[first] += 1
            drop[last + 1] -= 1
    return np.cumsum(drop[:-1]) > 0


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_removed, removed, kept): how many sentences go, their code point spans, and the text that stays.

    A null or empty text has no sentences and comes back empty. Rows of one doc_id are one document, whatever
    their texts: what one of them repeats of another stays, and each loses the runs of its own text. Rows
    without a doc_id are kept whole, as are texts of fewer words than a run has. Very long texts are cut and
    compared whole. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    gone = repeats(docs, min_words).withColumn("deal", F.lit(0).cast("long"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: list[list] = [[], [], []]
            for row, text, runs_ in zip(b.column(1).to_pylist(), texts(b.column(2)), b.column(3), strict=True):
                removed: list[dict] = []
                kept, n = text, 0
                if runs_.is_valid:
                    parts = sentences(text)
                    out = _gone([k for _, _, k in parts], row, runs_.as_py()).tolist()
                    n = sum(out)
                    for (start, end, _), x in zip(parts, out, strict=True):
                        if x and removed and removed[-1]["end"] == start:
                            removed[-1]["end"] = end
                        elif x:
                            removed.append({"start": start, "end": end})
                    kept = "".join(text[s:e] for (s, e, _), x in zip(parts, out, strict=True) if not x)
                for column, x in zip(made, (n, removed, kept), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(made, kinds, strict=True))], ["doc_id", "n_removed", "removed", "kept"])

    # Rows without a doc_id meet nothing; they are dealt by their texts. Texts aren't sorted.
    rows = keyed(docs).withColumn("deal", F.when(F.col("doc_id").isNull(), F.col("row")).otherwise(F.lit(0).cast("long")))
    joined = rows.join(gone.hint("shuffle_hash"), ["doc_id", "deal"], "left").select("doc_id", "row", "text", "gone")
    return joined.mapInArrow(each, "doc_id long, n_removed long, removed array<struct<start: long, end: long>>, kept string")
