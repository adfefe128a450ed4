"""Exact top-k search: postings scattered term by term into dense scores, partition selection, then a merge."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 10
#: Bytes of the candidates of a block, and of a dense score array.
BLOCK_BYTES, SCORE_BYTES = 64 << 20, 16 << 20
SCALE = 1024


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components as floor(scale * x). Vectors null, or holding null or non-finite components, go."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(scale) * c).cast("long"))
    return rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of the list array, filled with zeros up to the longest or to width."""
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), width or 0)), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat[offsets[0] : offsets[-1]]
    return out


def scatter(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Dense scores of every query against a block: for each term, its weighted postings times the queries' weights."""
    scores = np.zeros((len(queries), len(block)), np.int64)
    for term in range(min(queries.shape[1], block.shape[1])):
        weights, postings = queries[:, term], block[:, term]
        have, rows = np.flatnonzero(weights), np.flatnonzero(postings)
        if len(have) == len(weights) and len(rows) == len(postings):
            scores += weights[:, None] * postings
        elif len(have) and len(rows):
            scores[np.ix_(have, rows)] += weights[have, None] * postings[rows]
    return scores


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row: highest scores, ties to smaller ids. ids has the shape of scores."""
    if scores.shape[1] > 4 * k:  # selection: all that reach the k-th score, of which ties may be many
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        row, at = np.nonzero(scores >= least[:, None])
        order = np.lexsort((ids[row, at], -scores[row, at], row))
        row, at = row[order], at[order]
        rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(scores)))[row]
        keep = rank < k
        return ids[row[keep], at[keep]].reshape(-1, k), scores[row[keep], at[keep]].reshape(-1, k)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


_NONE = np.iinfo(np.int64).min + 1  # its negation is a number too


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of highest integer inner product.

    rows and queries are (vec_id, v array<long>). All rows are candidates but those of the query's own vec_id.
    Ties go to the smaller vec_id; fewer candidates give fewer ranks. Queries that repeat a row count once;
    candidates that repeat one count each time. Components that a shorter vector lacks are zero; scores are
    64-bit sums. Empty tables give no rows.

    Candidates are dealt to blocks of a bounded size, rows of one vec_id too, and the queries to every block,
    sorted after its candidates. A task holds a block's postings and streams the queries past them, so neither
    queries nor candidates pass through the driver; k rows a query and block are shuffled to be merged.
    """
    spark = rows.sparkSession
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    width = max(1, size["width"] or 0)
    blocks = max(spark.sparkContext.defaultParallelism, math.ceil(size["n"] * width * 8 / block_bytes))
    block = F.pmod(F.xxhash64("vec_id", F.spark_partition_id()), F.lit(blocks))
    held = rows.select(block.cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "v")
    asked = queries.dropDuplicates(["vec_id", "v"]).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "v")
    dealt = held.union(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, ids, postings = None, [], None, None
        for b in batches:
            own, kind, vec = (b.column(i).to_numpy() for i in range(3))
            cuts = np.concatenate([[0], np.flatnonzero((own[1:] != own[:-1]) | (kind[1:] != kind[:-1])) + 1, [len(own)]])
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if s == e:
                    continue
                if own[s] != at:
                    at, parts, ids = int(own[s]), [], None
                values = _matrix(b.column(3).slice(s, e - s), width)[:, :width]
                if kind[s] == 0:
                    parts.append((vec[s:e], values))
                    continue
                if ids is None:
                    ids = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)])
                    postings = np.concatenate([np.zeros((0, width), np.int64), *(p[1] for p in parts)])
                    parts = []
                if not len(ids):
                    continue
                step = max(1, SCORE_BYTES // (8 * len(ids)))
                for lo in range(0, e - s, step):
                    asking = vec[s + lo : min(s + lo + step, e)]
                    scores = scatter(values[lo : lo + step], postings)
                    scores[asking[:, None] == ids] = _NONE
                    best_ids, best = _best(np.broadcast_to(ids, scores.shape), scores, k)
                    real = best != _NONE
                    columns = [np.broadcast_to(asking[:, None], best.shape)[real], best_ids[real], best[real]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(each, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
