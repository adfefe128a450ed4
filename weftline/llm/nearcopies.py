"""Near copies: documents whose sets of word shingles are alike, found by SimHash and MinHash and verified exactly.

Fingerprints of 64 bits within the trie join's budget tell copies that differ little; at a similarity of 0.8 some
ten bits differ, beyond what a trie can search at scale, so MinHash bands find what the trie leaves out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import by_rows, byte_texts, id_set, keyed, measured, row_set, saved, small_batches
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of a sketch and MinHashes in each: a pair of similarity 0.8 shares no band once in (1 - 0.8^5)^-30, some 150,000.
BANDS, BAND = 30, 5
#: A node is frequent from this fraction of all rows on.
HOT = 1000
#: Counters of how many texts hold a shingle (8 bytes each, broadcast).
BUCKETS = 1 << 20
#: 64-bit words of a set's bits, which bound what two sets share.
WORDS = 8
_BITS = [f"b{k}" for k in range(WORDS)]
#: Shingles that are hashed anew at once; bounds a sketch's memory on long texts.
BLOCK = 4096
_RNG = np.random.default_rng(42)
_XOR = _RNG.integers(0, 2**64, (BANDS * BAND, 1), dtype=np.uint64)
_ODD = _RNG.integers(0, 2**63, (BANDS * BAND, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each word shingle of a UTF-8 text: lower-case ASCII, white-space words; one of all words if they are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(whole, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def sketch(h: np.ndarray) -> list[int]:
    """A key for each band of a set of shingles, told apart by the band's number; none for the empty set."""
    if not len(h):
        return []
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max)
    for at in range(0, len(h), BLOCK):
        np.minimum(least, ((h[at : at + BLOCK] ^ _XOR) * _ODD).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, BAND))]


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def _node(text: bytes) -> int:
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()), 7)


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, row, node, fp, bands) of every row; node is a hash of its words, the same for copies; fp its SimHash."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, fps, bands = [], [], []
            for t in byte_texts(b.column(2)):
                h = shingles(t, shingle)
                nodes.append(_node(t))
                fps.append(simhash.majority(h) if len(h) else 0)
                bands.append(np.array(sketch(h), np.uint64).view(np.int64))
            node, fp = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), node, fp, pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "row", "node", "fp", "bands"])

    return keyed(docs).mapInArrow(each, "doc_id long, row long, node long, fp long, bands array<long>")


def _trie_pairs(nodes: DataFrame, budget: int, n: int) -> DataFrame:
    """(u, v), u > v: pairs of nodes that join all whose fingerprints the trie links: a forest, not every pair."""
    first = saved(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = nodes.join(first, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    links = saved(simhash.links(first.select("fp"), budget, n=n), "trie")
    ends = links.join(first.toDF("u", "a"), "u").join(first.toDF("v", "b"), "v").select("a", "b")
    return same.union(ends).where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of each of the nodes, in one of its documents' spellings."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = pa.array(np.array([_node(t) for t in byte_texts(b.column(0))], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([node, b.column(0)], ["node", "text"])

    every = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(each, "node long, text string")
    ids = id_set(nodes)
    return saved(every.join(ids, every["node"] == ids["__id"], "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those (u, v) of the pairs whose texts' similarity is at least so much."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, None
        for b in batches:
            near = []
            for v, s, t in zip(b.column(1).to_pylist(), byte_texts(b.column(2)), byte_texts(b.column(3)), strict=True):
                if v != last:
                    last, y = v, np.unique(shingles(t, shingle))
                near.append(similarity(np.unique(shingles(s, shingle)), y) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    small_batches(pairs.sparkSession)
    both = pairs.join(texts.toDF("u", "a"), "u").join(texts.toDF("v", "b"), "v").select("u", "v", "a", "b")
    return saved(both.mapInArrow(each, "u long, v long"), "near")


def _residual(keys: DataFrame, forest: DataFrame) -> DataFrame:
    """(node, root): nodes of the keys that hold more than one of the forest's components, with their component."""
    root = forest.select(F.col("u").alias("node"), F.col("v").alias("root"))
    label = keys.join(root, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = label.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key")
    return saved(label.join(mixed, "key", "left_semi").select("node", "root").distinct(), "residual")


def _prefixes(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(key, node, i, n, b0, ...): the rarest of each text's n shingles, in order from i = 0, so many that alike texts share one.

    Sets whose similarity is at least so much share one of their first n - ceil(least * n) + 1 members in any order
    that is one for all. Shingles are ordered by how many texts hold them, counted in BUCKETS by their hash.
    """
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in byte_texts(b.column(1)):
                np.add.at(n, (np.unique(shingles(t, shingle)) % np.uint64(BUCKETS)).astype(np.int64), 1)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own])], ["bucket", "n"])

    seen = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows
    often = np.zeros(BUCKETS, np.int64)
    often[seen.column("bucket").to_numpy()] = seen.column("n").to_numpy()
    held = texts.sparkSession.sparkContext.broadcast(often)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, keys, places, sizes, bits = [], [], [], [], []
            for node, t in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), strict=True):
                h = np.unique(shingles(t, shingle))
                some = max(1, len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1)
                h = h[np.lexsort((h, held.value[(h % np.uint64(BUCKETS)).astype(np.int64)]))]
                keys.append(h[:some].view(np.int64))
                nodes.append(np.full(min(some, len(h)), node))
                places.append(np.arange(min(some, len(h))))
                sizes.append(np.full(min(some, len(h)), len(h)))
                odd = np.bincount((h >> np.uint64(32)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
                bits.append(np.broadcast_to(np.packbits(odd.astype(np.uint8)).view(np.int64), (min(some, len(h)), WORDS)))
            columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(t)) for x, t in ((keys, np.int64), (nodes, np.int64), (places, np.int32), (sizes, np.int32))]
            odd = np.concatenate([np.zeros((0, WORDS), np.int64), *bits])
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(odd[:, k]) for k in range(WORDS))], ["key", "node", "i", "n", *_BITS])

    return texts.mapInArrow(each, "key long, node long, i int, n int, " + ", ".join(f"{b} long" for b in _BITS))


def _across(residual: DataFrame, texts: DataFrame, done: DataFrame, shingle: int, least: float) -> DataFrame:
    """(u, v), u > v: every pair of residual nodes that may be alike, isn't in one component and isn't done.

    Pairs share one of their rarest shingles, of each of which the nodes outside the largest component are paired
    with all that aren't in their own; sizes and the shingles left after the shared one must allow the similarity.
    Copies that differ from a common text by more than links hold shingles of their own among the rarest, so a
    large group of them isn't paired within itself.
    """
    own = texts.join(residual.select("node"), "node", "left_semi")
    label = saved(_prefixes(own, shingle, least).join(residual, "node"), "prefixes")
    most = label.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    most = most.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    apart = saved(label.join(most.select("key", "most"), "key"), "apart").select("key", "node", "root", "most", "i", "n", *_BITS)
    few = apart.where("root <> most").select(F.col("key").alias("own"), F.col("node").alias("v"), F.col("root").alias("other"), F.col("i").alias("j"), F.col("n").alias("m"), *[F.col(b).alias(f"o{b}") for b in _BITS])
    n, m = F.col("n"), F.col("m")
    unlike = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"o{b}"))) for b in _BITS), F.lit(0))
    left = F.least(n - F.col("i"), m - F.col("j"))  # at the first shingle that two sets share, they share no more than these
    need = (n + m) * (least / (1 + least)) - 1e-9
    alike = (n >= m * least - 1e-9) & (m >= n * least - 1e-9) & (left >= need) & ((n + m - unlike) / 2 >= need)
    pairs = apart.join(few, (F.col("key") == F.col("own")) & (F.col("root") != F.col("other")) & alike)
    pairs = pairs.select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v"))
    return pairs.distinct().join(done, ["u", "v"], "left_anti")


def _members(docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """(doc_id, row, first struct<none, doc_id, row>): each row with its group's first one: of the least doc_id, then row key."""
    each, rows = measured(_sketches(docs, shingle), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    nodes, size = measured(each.groupBy("node").agg(first, F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "nodes")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("top")).where("v < top").select("key", "v")
    keys = saved(keys.join(shared, "key").select("key", "node", "v"), "keys")
    star = keys.where("node <> v").select(F.col("node").alias("u"), "v").union(_trie_pairs(nodes.select("node", "fp"), simhash.BUDGET, size["n"]))
    star = saved(star.distinct(), "stars")
    texts = _texts(docs, star.select(F.explode(F.array("u", "v"))).union(keys.select("node")))
    links = _verified(star, texts, shingle, least)
    forest = components(links)
    across, more = measured(_across(_residual(keys.select("key", "node"), forest), texts, star, shingle, least), "across")
    if more["n"]:
        forest = components(links.union(_verified(across, texts, shingle, least)))
    member = forest.select(F.col("u").alias("node"), F.col("v").alias("root"))
    member = member.union(forest.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    smallest = member.join(nodes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("smallest"))
    linked = member.join(smallest, "root").select("node", "smallest")
    label = nodes.select("node", "first", "n").join(linked, "node", "left").select("node", F.coalesce("smallest", "first").alias("first"), "n")
    label = saved(label, "components")
    # Nodes of more than a thousandth of all rows are fewer than a thousand: theirs are joined by broadcast.
    hot = F.broadcast(label.where(F.col("n") * HOT > rows["n"]).select("node", "first"))
    each = each.select("doc_id", "row", "node")
    often = each.join(hot, "node").select("doc_id", "row", "first")
    rest = each.join(hot, "node", "left_anti").join(label, "node").select("doc_id", "row", "first")
    return often.unionByName(rest)


def groups(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id): component_id is the least doc_id reachable over pairs of at least this similarity.

    Copies meet in one node first. A pair of nodes is a candidate where the SimHash trie links it or where it
    shares a MinHash band's key, and a link where the texts' sets of shingles are alike. Each key's least node is
    compared with its others; then, where a key's nodes aren't all in one component, every pair across components
    that the rarest shingles allow is, so that no link is left out and a large group isn't paired within itself. Null and
    empty texts are copies of each other; texts of fewer words than a shingle are one shingle. Very long texts are
    compared whole. A document without a doc_id links like any other and gets the least id that it reaches. Rows
    that repeat are all told; an empty table gives no rows.
    """
    return _members(docs, shingle, least).select("doc_id", F.col("first.doc_id").alias("component_id"))


def kept(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group: that of the least doc_id (none is the greatest), then of the least row key.

    Rows are told apart by doc_id and text, so a text of its own stays whatever other rows of its doc_id hold,
    and rows without a doc_id are copies like others. Of rows alike in both, one stays (by a hash of all columns).
    """
    members = saved(_members(docs, shingle, least), "members")
    mine = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))
    gone = members.where(~mine).select("doc_id", "row")
    again, size = measured(members.where(mine).groupBy("doc_id", "row").count().where("count > 1").select("doc_id", "row"), "again")
    if not size["n"]:
        return by_rows(docs, row_set(gone), "left_anti")
    rest = by_rows(docs, row_set(gone.union(again)), "left_anti")
    own = by_rows(docs, row_set(again), "left_semi").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("x"))
    own = own.groupBy(F.col("x.doc_id").alias("i"), F.xxhash64(F.col("x.text")).alias("r")).agg(F.min_by("x", F.xxhash64("x")).alias("x"))
    return rest.union(own.select("x.*"))
