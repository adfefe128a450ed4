"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Only DataFrame functions are used. Documents are read where they lie, once for each block of items and once
more for the few that may hold one; their texts are never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_rows, keyed, measured, row_set

SHINGLE, CONTAINMENT = 5, 0.8
#: Shingles of the items that are broadcast at once (8 bytes each, and a fifth of them again as signatures).
BLOCK_SHINGLES = 2_000_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(hashes: Column, k: int) -> Column:
    """Hashes of every k consecutive words, from the words' hashes; empty for fewer words.

    The hashes are bound to a lambda's variable, so they are made once and not again for each shingle.
    """

    def of(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + d) for d in range(k)]))
        return F.when(F.size(w) >= k, every).otherwise(F.array().cast("array<long>"))

    return F.get(F.transform(F.array(hashes), of), F.lit(0))


def _items(benchmark: DataFrame, k: int, least: float) -> DataFrame:
    """(item_id, item, width, part, hs, n, need, m): each item text's distinct shingles, in order of their hashes.

    width: as many words as the item has, up to k. n shingles put the item in the partition of its size (part:
    n's power of two); need of them must be found, so a signature of the m least misses no document.
    """
    w = benchmark.select("item_id", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("w")).where("size(w) > 0")
    w = w.withColumn("width", F.least(F.size("w"), F.lit(k)))
    hs = F.lit(None).cast("array<long>")
    for width in range(1, k + 1):
        hs = F.when(F.col("width") == width, shingles(F.col("w"), width)).otherwise(hs)
    w = w.select("item_id", "width", F.array_sort(F.array_distinct(hs)).alias("hs")).dropDuplicates(["item_id", "hs"])
    w = w.withColumn("n", F.size("hs")).withColumn("item", F.xxhash64("item_id", "hs"))
    # Halves are exact, and so are products that should be whole: 0.8 * 5 needs 4 hits, not 5.
    need = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)).cast("int"))
    w = w.withColumn("need", need).withColumn("m", F.col("n") - F.col("need") + 1)
    return w.withColumn("part", F.floor(F.log2("n")).cast("int"))


def _blocks(items: DataFrame, block: int) -> list[list[tuple[int, int, int, int]]]:
    """Passes over the documents: lists of (width, part, number of slices, slice), of at most some block shingles each.

    A size partition of more is cut into slices; small ones share a pass.
    """
    sizes = items.groupBy("width", "part").agg(F.sum("n").alias("n")).collect()  # a row for each width and power of two
    passes: list[list[tuple[int, int, int, int]]] = []
    room = 0
    for row in sorted(sizes):
        slices = math.ceil(row["n"] / block)
        for k in range(slices):
            size = row["n"] / slices
            if not passes or size > room:
                passes.append([])
                room = block
            passes[-1].append((row["width"], row["part"], slices, k))
            room -= size
    return passes


def _of(items: DataFrame, own: list[tuple[int, int, int, int]]) -> DataFrame:
    chosen = F.lit(False)
    for width, part, slices, k in own:
        chosen = chosen | ((F.col("width") == width) & (F.col("part") == part) & (F.pmod(F.col("item"), F.lit(slices)) == k))
    return items.where(chosen)


def _documents(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, row, width, have): a document's distinct shingles of each width."""
    w = docs.select("doc_id", "row", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("w")).where("size(w) > 0")
    have = F.array(*[F.struct(F.lit(k).alias("width"), F.array_distinct(shingles(F.col("w"), k)).alias("have")) for k in widths])
    return w.select("doc_id", "row", F.explode(have).alias("x")).select("doc_id", "row", "x.width", "x.have")


def _pairs(docs: DataFrame, benchmark: DataFrame, shingle: int, containment: float, block: int) -> DataFrame | None:
    """(doc_id, row, item_id, n_shingles, n_found): the item texts that each row holds; None without items."""
    items, size = measured(_items(benchmark, shingle, containment), "items")
    passes = _blocks(items, block) if size["n"] else []
    found = None
    for own in passes:
        mine, widths = _of(items, own), sorted({width for width, *_ in own})
        signed = mine.select("item", "width", "need", F.explode(F.slice("hs", F.lit(1), F.col("m"))).alias("h"))
        each = _documents(keyed(docs), widths).select("doc_id", "row", "width", F.size("have").alias("size"), F.explode("have").alias("h"))
        near = each.join(F.broadcast(signed), ["width", "h"]).where("size >= need").select("doc_id", "row", "item", "width").distinct()
        near, _ = measured(near, "near")  # each document and item once, whatever number of hashes they share
        some = by_rows(docs, row_set(near), "left_semi")
        near = near.withColumnRenamed("row", "own").withColumnRenamed("doc_id", "own_id").withColumnRenamed("width", "own_width")
        have = _documents(keyed(some), widths)
        same = have["doc_id"].eqNullSafe(near["own_id"]) & (have["row"] == near["own"]) & (have["width"] == near["own_width"])
        pair = have.join(near, same).select("doc_id", "row", "item", "have").join(F.broadcast(mine.select("item", "item_id", "n", "need", "hs")), "item")
        pair = pair.withColumn("n_found", F.size(F.array_intersect("hs", "have"))).where("n_found >= need")
        pair = pair.select("doc_id", "row", "item_id", F.col("n").alias("n_shingles"), "n_found")
        found = pair if found is None else found.union(pair)
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found): items of which a document holds enough distinct shingles.

    Items are partitioned by size, and a signature's length follows the item's: the item's least shingle hashes
    (MinHash, bottom-m), one more than the shingles that it may lack at this containment; so a document that
    holds enough has one of the signature, however long the document is, and the search misses nothing. Items
    of fewer words than a shingle are one shingle of all their words. Documents of fewer shingles than an item
    needs aren't paired with it. Size partitions' signatures are broadcast, as many at once as a block of a
    fixed size holds; the documents that share a hash with one are then read again, and every such pair is
    verified once on the distinct shingles of both.

    Null and empty texts hold nothing; items without words match nothing; rows that repeat a document or an
    item give a pair once. Where a doc_id or an item_id has several texts, each text is judged on its own and
    the pair of highest containment is told (of equal ones, the one of more shingles). Very long texts are
    searched whole. Empty tables give no rows. Shingles are compared by 64-bit hashes.
    """
    found = _pairs(docs, benchmark, shingle, containment, block)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shingles int, n_found int")
    best = F.max(F.struct((F.col("n_found") / F.col("n_shingles")).alias("share"), "n_shingles", "n_found")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_shingles", "best.n_found")


def clean(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """docs without the rows whose text holds a benchmark item, with or without a doc_id."""
    found = _pairs(docs, benchmark, shingle, containment, BLOCK_SHINGLES)
    return docs if found is None else by_rows(docs, row_set(found), "left_anti")
