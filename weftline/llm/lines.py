"""Line deduplication: range-partitioned line hashes, streamed in order, give a keep bitmap for each document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, keyed, saved, small_batches

MIN_CHARS, MIN_DOCS = 40, 5
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def _keys(text: bytes, least: int) -> Iterator[tuple[int, bytes]]:
    """(position, key) of each line whose key has at least so many code points."""
    for at, line in enumerate(text.split(b"\n")):
        if len(line) >= least and len(key := line.strip(_SPACE)) >= least:
            if key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= least:
                yield at, key.lower()


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, row, at): a 128-bit hash of each long line's key, with its row's key and position."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, owners, ats = [], [], []
            for i, text in enumerate(byte_texts(b.column(2))):
                for at, key in _keys(text, min_chars):
                    hashes.append(xxhash.xxh3_128_digest(key))
                    owners.append(i)
                    ats.append(at)
            h = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            own = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), b.column(0).take(own), b.column(1).take(own), pa.array(ats, pa.int32())],
                ["h1", "h2", "doc_id", "row", "at"],
            )

    return keyed(docs).where("doc_id IS NOT NULL").mapInArrow(each, "h1 long, h2 long, doc_id long, row long, at int")


def dropped_lines(hashed: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row, at) of the lines to drop: those of a key in min_docs documents, but for its largest doc_id's.

    Lines are range-partitioned by (hash, document), so a line that very many documents hold is spread over
    many tasks, and sorted by hash, document downwards and position. Each task streams its runs of one hash:
    the first document met keeps its lines, and later ones lose theirs once enough documents were seen. A
    task's first and last runs may go on in other tasks; their rows wait for the runs' counts, of which there
    are at most two for each task.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "h1", "h2", "doc_id", "row", "at", "docs"]
        kinds = (np.int8, np.int64, np.int64, np.int64, np.int64, np.int32, np.int64)

        def out(*columns) -> pa.RecordBatch:
            n = len(columns[3])
            full = (x if isinstance(x, np.ndarray) else np.full(n, x) for x in columns)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(full, kinds, strict=True)], names)

        run, opening, seen, last, top = None, False, 0, None, 0  # the run that is going on; opening: the task's first
        wait: list[tuple[np.ndarray, ...]] = []  # fewer rows than enough documents have, of others than top
        for b in batches:
            h1, h2, doc, row, at = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            if not len(h1):
                continue
            edges = np.concatenate([[0], np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1, [len(h1)]])
            some = np.diff(edges) >= min_docs  # a shorter run within the batch has too few documents
            some[0] = some[-1] = True
            for k in np.flatnonzero(some).tolist():
                s, e = int(edges[k]), int(edges[k + 1])
                key = (int(h1[s]), int(h2[s]))
                if key != run:
                    if opening:
                        yield out(2, *run, np.array([top]), 0, 0, seen)
                    opening, run, seen, last, top, wait = run is None, key, 0, None, int(doc[s]), []
                d, r, a = doc[s:e], row[s:e], at[s:e]
                seen += int((d[1:] != d[:-1]).sum()) + (last is None or int(d[0]) != last)
                last = int(d[-1])
                if opening:
                    yield out(1, *run, d, r, a, 0)
                    continue
                other = d != top
                wait.append((d[other], r[other], a[other]))
                if seen >= min_docs:
                    yield from (out(0, 0, 0, *w, 0) for w in wait if len(w[0]))
                    wait = []
        if run is not None:
            yield out(2, *run, np.array([top]), 0, 0, seen)
            yield from (out(1, *run, *w, 0) for w in wait if len(w[0]))

    ordered = hashed.repartitionByRange("h1", "h2", F.desc("doc_id")).sortWithinPartitions("h1", "h2", F.desc("doc_id"), "at")
    found = saved(ordered.mapInArrow(each, "kind byte, h1 long, h2 long, doc_id long, row long, at int, docs long"), "lines")
    whole = found.where("kind = 2").groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("doc_id").alias("top"))
    whole = whole.where(F.col("docs") >= min_docs).select("h1", "h2", "top")
    late = found.where("kind = 1").join(F.broadcast(whole), ["h1", "h2"]).where("doc_id <> top")
    return found.where("kind = 0").select("doc_id", "row", "at").union(late.select("doc_id", "row", "at"))


def _bitmap(drop: np.ndarray) -> bytes:
    keep = np.ones(int(drop.max()) // 8 * 8 + 8, bool)
    keep[drop] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1)


def _keep(bitmap: bytes, n: int) -> np.ndarray:
    """Whether each of n lines stays; lines after the bitmap's end do."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n].astype(bool)
    return np.concatenate([bits, np.ones(n - len(bits), bool)])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row, keep) of each row that loses lines; keep is a zlib-compressed bitmap, least bit first.

    It has a bit for each line up to the last that goes, and lines after it stay. row is the XXH64 (seed 42) of
    the row's text, so rows of one doc_id with other texts have bitmaps of their own.
    """
    gone = dropped_lines(saved(hashed_lines(docs, min_chars), "hashes"), min_docs)
    gone = gone.groupBy("doc_id", "row").agg(F.collect_set("at").alias("gone"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [_bitmap(np.array(x.as_py())) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keep, pa.binary())], ["doc_id", "row", "keep"])

    return gone.mapInArrow(each, "doc_id long, row long, keep binary")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs without the lines that documents share; counts names two more columns: lines before, and dropped ones.

    A line is what lies between newlines; its key is stripped of ASCII white space and lower-cased in A-Z. Keys
    of at least min_chars code points in at least min_docs documents go from all documents but the largest
    doc_id that holds them, which keeps all its lines of that key. A null or empty text is one empty line and
    comes back empty. Rows of one doc_id are one document to the counts, whatever their texts; each row loses
    the lines of its own text. Rows without a doc_id lose nothing and don't count. Very long texts are taken
    whole. Other columns stay, whatever their names. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    gone = keep_bitmaps(docs, min_chars, min_docs).toDF("own_id", "own_row", "keep")
    at = docs.columns.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    # Both keys together deal rows that share an id, or have none, by their texts. One plan at every size: no text is sorted.
    same = (F.col(f"c{docs.columns.index('doc_id')}").cast("long") == F.col("own_id")) & (F.xxhash64(F.col(f"c{at}").cast("string")) == F.col("own_row"))
    joined = plain.join(gone.hint("shuffle_hash"), same, "left").drop("own_id", "own_row")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, sizes, dropped = [], [], []
            for text, bitmap in zip(byte_texts(b.column(at)), b.column(b.num_columns - 1), strict=True):
                n, gone_ = text.count(b"\n") + 1, 0
                if bitmap.is_valid:
                    keep = _keep(bitmap.as_py(), n)
                    gone_ = n - int(keep.sum())
                    text = b"\n".join(x for x, k in zip(text.split(b"\n"), keep.tolist(), strict=True) if k)
                kept.append(text)
                sizes.append(n)
                dropped.append(gone_)
            columns = b.columns[:-1]
            columns[at] = pa.array(kept, pa.binary()).cast(pa.string())
            more = [pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *more], [*b.schema.names[:-1], "n", "gone"])

    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    out = joined.mapInArrow(each, T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("gone", T.LongType())]))
    return out.toDF(*docs.columns, *counts) if counts else out.drop("n", "gone").toDF(*docs.columns)
