"""Packing: documents' token ids into near-equal windows, by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

CAPACITY = 1024
#: Pieces that are packed together: a task holds so many at once, and what is left in its last round.
ROUND = 1024
#: A document's last piece is cut into parts of at most so many ids, so that windows come out nearly full.
PART = 512
END_ID = 0
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Texts of these characters alone are split alike by both libraries, whatever Unicode version each has.
_PLAIN = re.compile(r"[\x00-ɏ‐-‧€]*")


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k groups of the items' indexes with near-equal sums (Karmarkar and Karp's largest differencing, k ways).

    Every item begins as a partition of its own: itself and k - 1 empty groups. The two partitions of largest
    spread are merged again and again, the fullest groups of one with the emptiest of the other. Only groups
    that differ from a partition's least sum are held.
    """
    tie = 0
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, tie, [(s, [i])]))
        tie += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]  # groups with sums above the least, largest first
        if len(a) < len(b):
            a, b = b, a
        free = k - len(a)
        if len(b) <= free:
            both = a + b
        else:  # the largest of b meet empty groups, and the rest the least of a
            over = len(b) - free
            both = a[: len(a) - over] + b[:free]
            # a's least groups, ascending, meet b's groups from its largest that is left
            both += [(x[0] + y[0], x[1] + y[1]) for x, y in zip(reversed(a[len(a) - over :]), b[free:], strict=True)]
        both.sort(key=lambda g: -g[0])
        least = both[-1][0] if len(both) == k else 0
        heapq.heappush(heap, (-(both[0][0] - least), tie, both))
        tie += 1
    groups = [g[1] for g in heap[0][2]] if heap else []
    return groups + [[] for _ in range(k - len(groups))]


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Groups of items whose sums are near-equal and at most capacity; no item may be larger than that.

    The count begins at the least that could do and rises whenever a group's sum exceeds the capacity.
    """
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, k)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return [g for g in groups if g]
        k += 1


class Encoder:
    """Ids of a text by the byte-level BPE of the tokenizers library, without special tokens added.

    Plain texts take tiktoken's implementation over the same vocabulary as ranks, which gives the same ids in a
    quarter of the time; texts of other characters, or with a special token's string, take tokenizers itself.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary)
        with open(ranks) as f:
            table = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> np.ndarray:
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[tuple, Encoder] = {}


def pack(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, capacity: int = CAPACITY, part: int = PART, together: int = ROUND) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): all documents' ids in windows of capacity.

    A document is its text's ids and then END_ID; null and empty texts are that id alone. Each id lies in one
    piece: a document is cut at multiples of capacity into whole windows, and what is left, into parts that
    are packed with those of other documents of the task. ids are little-endian unsigned 32-bit. sequence_id
    joins the task's partition with a count, so it is the same when a task is run again; offsets in a sequence
    are gapless from 0. Rows that repeat are packed each; a null doc_id is kept. An empty table gives no rows.

    Nothing is shuffled: a task packs what it reads, and only its last round is short of pieces.
    vocabulary and ranks are files on every executor; by default those of the public_tokenizers package.
    """
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        from pyspark import TaskContext

        files = (vocabulary or public_tokenizers.path(VOCABULARY), ranks or public_tokenizers.path(RANKS))
        if files not in _encoders:
            _encoders[files] = Encoder(*files, public_tokenizers.PATTERN)
        encode = _encoders[files]
        sequence = TaskContext.get().partitionId() << 33
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        made: list[list] = [[] for _ in names]
        left: list[tuple] = []  # doc_id, start, ids, doc_tokens

        def put(doc_id, start, ids, n, offset) -> None:
            for column, x in zip(made, (doc_id, start, len(ids), ids.astype("<u4").tobytes(), n, sequence, offset), strict=True):
                column.append(x)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, kinds, strict=True)], names)
            for column in made:
                column.clear()
            return batch

        def settle() -> None:
            nonlocal sequence
            for group in windows([len(x[2]) for x in left], capacity):
                offset = 0
                for i in sorted(group):
                    put(*left[i], offset)
                    offset += len(left[i][2])
                sequence += 1
            left.clear()

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                ids = np.append(encode(text), np.uint32(END_ID)) if text else np.full(1, END_ID, np.uint32)
                n, whole = len(ids), len(ids) // capacity * capacity
                for at in range(0, whole, capacity):
                    put(doc_id, at, ids[at : at + capacity], n, 0)
                    sequence += 1
                for at in range(whole, n, part):
                    left.append((doc_id, at, ids[at : at + part], n))
                if len(left) >= together:
                    settle()
                if len(made[0]) >= 2048:
                    yield flush()
        if left:
            settle()
        if made[0]:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
