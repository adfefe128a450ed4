"""Retrieval: postings and BM25, exact nearest neighbours, rank fusion, memory overlay and the whole pipeline."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import budget, graph
from .lineage import cut
from .sizes import small, spread

K1, B = 1.2, 0.75
RRF_K, LEXICAL, VECTOR = 60, 1.0, 0.1
BOOST, PENALTY = 1.25, 0.5
#: Words are more bytes than the compressed texts that they are read from.
TERM_WEIGHT = 4.0
#: Words that are listed in a filter on stored postings.
MOST_TERMS = 200
#: Relations of the one hop from what was found, and dependents that an answer adds.
EXPANDED, MOST_DEPENDENTS = (1, 0, 3, 2), 15
TIERS = ("Target", "Seed", "Dependency")


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(docs: DataFrame, id_column: str, text: Column | str = "text", tokenizer=tokens) -> DataFrame:
    """(term, id, tf, len): documents' terms, a term's in one task.

    Words are dealt by term before they are counted: a document's own words are too many and too different for it to
    pay to count them where it lies, and afterwards no second shuffle is needed.
    """
    return _dealt(docs.select(F.col(id_column).alias("id"), tokenizer(text).alias("terms")).withColumn("len", F.size("terms")))


def _dealt(split: DataFrame) -> DataFrame:
    own = spread(split.select("id", "len", F.explode("terms").alias("term")), "term", weight=TERM_WEIGHT)
    return own.groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf")).select("term", "id", "tf", "len")


def index(docs: DataFrame, id_column: str, text: Column | str = "text", tokenizer=tokens) -> dict[str, DataFrame]:
    """Tables of a stored lexical index: postings laid out by term, and the corpus' sizes (docs, mean)."""
    size = docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.avg(F.size(tokenizer(text))), F.lit(0.0)).alias("mean"))
    return {"postings": postings(docs, id_column, text, tokenizer).sortWithinPartitions("term"), "sizes": size}


def stored_index(docs: DataFrame, id_column: str, text: Column | str = "text", tokenizer=tokens) -> dict[str, DataFrame]:
    """index() as tables in the shared folder; texts are split once, for both."""
    seen = Observation()
    split = docs.select(F.col(id_column).alias("id"), tokenizer(text).alias("terms")).withColumn("len", F.size("terms"))
    split = split.observe(seen, F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"))
    made = cut(_dealt(split).sortWithinPartitions("term"))
    size = seen.get
    return {"postings": made, "sizes": docs.sparkSession.createDataFrame([(size["docs"], size["mean"] or 0.0)], "docs long, mean double")}


def _ranked(hits: DataFrame, docs: Column, mean: Column, wanted: DataFrame, k: int) -> DataFrame:
    """BM25 of hits (id, len, term, tf) for wanted (query_id, term). The wanted words' df are few rows, so hits stay where they lie."""
    df = small(cut(hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))))
    idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    parts = hits.join(df, "term").withColumn("part", part).join(wanted, "term").select("query_id", "id", "part")
    parts = spread(parts, "query_id", "id", weight=TERM_WEIGHT)  # a document's words lie apart, so counting them there would only hold them
    scored = parts.groupBy("query_id", "id").agg(F.sum("part").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _wanted(queries: DataFrame, tokenizer) -> DataFrame:
    return small(queries.select("query_id", F.explode(F.array_distinct(tokenizer("text"))).alias("term")))


def bm25(docs: DataFrame, queries: DataFrame, id_column: str, text: str = "text", k: int = 20, tokenizer=tokens) -> DataFrame:
    """(query_id, rank, id, score): the k best documents for each query (query_id, text), any of its words.

    The corpus is split once: words that no query has are dropped where they lie, by a join with the queries'
    distinct words, and the hits that are left are saved together with the corpus' sizes. Hits of one document
    and word are combined before they are shuffled. Ties go to the smaller id.
    """
    wanted = _wanted(queries, tokenizer)
    seen = Observation()
    split = docs.select(F.col(id_column).alias("id"), tokenizer(text).alias("terms")).withColumn("len", F.size("terms"))
    split = split.observe(seen, F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"))
    hits = split.select("id", "len", F.explode("terms").alias("term")).join(small(wanted.select("term").distinct()), "term")
    hits = cut(hits.groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf")))
    size = seen.get
    return _ranked(hits, F.lit(size["docs"]), F.lit(size["mean"] or 1.0), wanted, k)


def bm25_stored(stored: DataFrame, sizes: DataFrame, queries: DataFrame, k: int = 20, tokenizer=tokens) -> DataFrame:
    """bm25() over the tables of index(): only the queries' words are read, by a list pushed down to the postings."""
    wanted = _wanted(queries, tokenizer)
    terms = wanted.select("term").distinct()
    some = [r["term"] for r in terms.limit(MOST_TERMS + 1).collect()]
    hits = stored.where(F.col("term").isin(some)) if len(some) <= MOST_TERMS else stored.join(small(terms), "term", "left_semi")
    size = sizes.first()
    return _ranked(hits, F.lit(size["docs"]), F.lit(size["mean"] or 1.0), wanted, k)


def weighted(lists: list[tuple[DataFrame, Column]], k: int = 20) -> DataFrame:
    """(query_id, rank, id, score) of several fields' lists, summed; a list's weight is a column of its query."""
    every = None
    for found, weight in lists:
        part = found.select("query_id", "id", (F.col("score") * weight).alias("score")).where("score > 0")
        every = part if every is None else every.union(part)
    out = every.groupBy("query_id", "id").agg(F.sum("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; 1 where either norm is 0; non-finite components read as 0."""
    clean = lambda v: F.transform(v.cast("array<double>"), lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    x, y = clean(a), clean(b)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norms == 0, 1.0).otherwise(1 - F.least(F.greatest(dot(x, y) / norms, F.lit(-1.0)), F.lit(1.0)))


#: Bytes of the candidates that a task holds, and of its distances at once; queries that it streams past them.
HELD_BYTES, DISTANCE_BYTES, ASKED = 64 << 20, 16 << 20, 1 << 17
#: Candidates of a group, of which only the nearest counts for a query's bound.
GROUP = 64


def _vectors(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list array, filled with zeros up to width; null and non-finite components read as 0."""
    offsets, flat = lists.offsets.to_numpy(), lists.values.fill_null(0.0).to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat[offsets[0] : offsets[-1]]
    return np.where(np.isfinite(out), out, 0.0)


def _best(q: np.ndarray, v: np.ndarray, ids: np.ndarray, own: np.ndarray, rough: np.ndarray, by_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, candidate, distance) of the k nearest candidates (ids, own) of each query (q, v), all of norm 1 or 0.

    Single precision (rough) leaves few candidates: those not farther than the k-th of the groups' nearest by more than
    its error. Their distances are taken in double precision.
    """
    near = v.astype(np.float32) @ rough.T
    first, last = (np.searchsorted(ids, q, side, sorter=by_id) for side in ("left", "right"))
    same = last - first  # the queries themselves
    near[np.repeat(np.arange(len(q)), same), by_id[np.arange(same.sum()) + np.repeat(first - np.cumsum(same) + same, same)]] = -np.inf
    n = len(ids) // GROUP
    if n >= k:
        least = np.partition(near[:, : n * GROUP].reshape(len(q), GROUP, n).max(axis=1), n - k, axis=1)[:, n - k]
    elif len(ids) > k:
        least = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k]
    else:
        least = np.full(len(q), -np.inf, np.float32)
    error = 1e-8 + (v.shape[1] + 8) * 2.0**-22
    row, col = np.nonzero(near >= (least - error)[:, None])
    some = np.isfinite(near[row, col])
    row, col = row[some], col[some]
    far, step = np.empty(len(row)), max(1, DISTANCE_BYTES // (16 * v.shape[1]))
    for lo in range(0, len(row), step):  # ties may be many
        far[lo : lo + step] = np.einsum("ij,ij->i", v[row[lo : lo + step]], own[col[lo : lo + step]])
    far = np.round(1 - np.clip(far, -1, 1), 9)
    order = np.lexsort((ids[col], far, row))
    row, col, far = row[order], col[order], far[order]
    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row] < k
    return row[keep], col[keep], far[keep]


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", held_bytes: int = HELD_BYTES, most_asked: int = ASKED) -> DataFrame:
    """(query_id, rank, id, distance): exact neighbours of queries (query_id, embedding), their own id left out.

    distance is 1 - cosine in double precision, 1 where either norm is 0. Candidates are dealt to blocks of a bounded
    size and queries to chunks of a bounded number; each block meets each chunk in a task of its own, which streams
    the queries past the block and hands on its k best for each. So tasks become more with the tables, not longer.
    Nothing passes through the driver. Null vectors take no part.
    """
    spark = rows.sparkSession
    candidates = rows.where("embedding IS NOT NULL").select(F.col(id_column).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = queries.where("embedding IS NOT NULL").select(F.col("query_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    size = candidates.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    width = max(1, size["width"] or 0)
    blocks = max(spark.sparkContext.defaultParallelism, math.ceil(size["n"] * width * 8 / held_bytes))
    chunks = max(1, math.ceil(asked.count() / most_asked))
    one_of = lambda n: F.pmod(F.xxhash64("id", F.spark_partition_id()), F.lit(n)).cast("int")
    each_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    met = candidates.select(one_of(blocks).alias("block"), each_of(chunks).alias("chunk"), F.lit(0).alias("kind"), "id", "v")
    met = met.union(asked.select(one_of(chunks).alias("chunk"), each_of(blocks).alias("block"), F.lit(1).alias("kind"), "id", "v").select(*met.columns))
    every = met.select((F.col("block") * chunks + F.col("chunk")).alias("place"), "kind", "id", "v")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], None
        for b in batches:
            place, kind, key = (b.column(i).to_numpy() for i in range(3))
            cuts = np.concatenate([[0], np.flatnonzero((place[1:] != place[:-1]) | (kind[1:] != kind[:-1])) + 1, [len(place)]])
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if s == e:
                    continue
                if place[s] != at:
                    at, parts, held = int(place[s]), [], None
                v = _vectors(b.column(3).slice(s, e - s), width)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), np.finfo(float).tiny)
                if kind[s] == 0:
                    parts.append((key[s:e], v))
                    continue
                if held is None:
                    ids = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in parts)])
                    own = np.concatenate([np.zeros((0, width)), *(x for _, x in parts)])
                    held, parts = (ids, own, own.astype(np.float32), np.argsort(ids, kind="stable")), []
                if not len(held[0]):
                    continue
                step = max(1, DISTANCE_BYTES // (4 * len(held[0])))
                for lo in range(s, e, step):
                    q = key[lo : min(lo + step, e)]
                    row, col, far = _best(q, v[lo - s : lo - s + len(q)], *held, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(held[0][col]), pa.array(far)], ["query_id", "id", "distance"])

    dealt = every.repartitionById(blocks * chunks, F.col("place")).sortWithinPartitions("place", "kind")
    found = dealt.mapInArrow(each, "query_id long, id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def fuse(lexical: DataFrame, vector: DataFrame, lexical_weight: float = LEXICAL, vector_weight: float = VECTOR) -> DataFrame:
    """(query_id, id, score): reciprocal ranks of both lists, weighted and summed."""
    part = lambda df, w: df.select("query_id", "id", (F.lit(w) / (RRF_K + F.col("rank"))).alias("part"))
    return part(lexical, lexical_weight).union(part(vector, vector_weight)).groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def overlay(scored: DataFrame, lessons: DataFrame, boost: float = BOOST, penalty: float = PENALTY) -> DataFrame:
    """Scores after lessons (id, good, bad): boosted where good, lowered where bad; bad wins."""
    factor = F.when(F.col("bad"), penalty).when(F.col("good"), boost).otherwise(1.0)
    joined = scored.join(lessons.select("id", "good", "bad"), "id", "left")
    return joined.withColumn("score", F.col("score") * factor).select(*scored.columns)


def similar(rows: DataFrame, k: int = 3, threshold: float = 0.75, id_column: str = "vec_id") -> DataFrame:
    """(id, other, similarity15): each row's k nearest by cosine from the threshold on, in fifteenths; one-sided.

    All rows are queries, streamed past nearest()'s blocks.
    """
    queries = rows.select(F.col(id_column).alias("query_id"), "embedding")
    near = nearest(rows, queries, k, id_column).where((1 - F.col("distance")) >= threshold)
    return near.select(F.col("query_id").alias("id"), F.col("id").alias("other"), F.round((1 - F.col("distance")) * 15).cast("int").alias("similarity15"))


def search(docs: DataFrame, questions: DataFrame, id_column: str = "doc_id", k: int = 20, vectors: DataFrame | None = None, question_vectors: DataFrame | None = None, lessons: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, score): stop-words dropped, BM25, vectors where there are any, fusion, overlay."""
    asked = questions.select("query_id", C.without_stopwords("text").alias("text"))
    lexical = bm25(docs, asked, id_column, k=k)
    if vectors is not None and question_vectors is not None:
        near = nearest(vectors, question_vectors, k)
    else:
        near = lexical.limit(0)
    out = fuse(lexical, near)
    if lessons is not None:
        out = overlay(out, lessons)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def dependents(edges: DataFrame, targets: DataFrame, k: int = MOST_DEPENDENTS, name: Callable[[Column], Column] = graph._as_is) -> DataFrame:
    """(id, place): who depends on the targets (id), certain and runtime edges first; one id once, at most k."""
    own = graph.edge_filter(edges, graph.DEPENDENCIES)
    ends = small(targets.select("id").distinct())
    into = own.join(ends.withColumnRenamed("id", "to_id"), "to_id", "left_semi").join(ends.withColumnRenamed("id", "from_id"), "from_id", "left_anti")
    trust = F.struct(C.meta_inferred("meta").alias("inferred"), C.meta_context("meta", 0b11).alias("context"))
    best = into.groupBy(F.col("from_id").alias("id")).agg(F.min(trust).alias("trust")).withColumn("tie", name(F.col("id"))).orderBy("trust", "tie").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy("trust", "tie"))).select("id", "place")  # at most k rows


def expanded(nodes: DataFrame, edges: DataFrame, found: DataFrame, asks: bool, k: int = MOST_DEPENDENTS, name: Callable[[Column], Column] = graph._as_is) -> DataFrame:
    """(id, tier, place, score): what was found (rank, id, score), one hop along semantic edges, and dependents.

    The first hit is the target, others are seeds; forward dependency edges aren't followed. Where the question
    asks for dependents, those of the hits come after, and then those of the hits' files.
    """
    seeds = small(found.select("id", F.when(F.col("rank") == 1, 0).otherwise(1).alias("tier"), F.col("rank").alias("place"), "score"))
    hop = edges.where(F.col("edge_type").isin(list(EXPANDED))).join(seeds.select(F.col("id").alias("from_id"), "place"), "from_id")
    hop = hop.groupBy(F.col("to_id").alias("id")).agg((F.min("place") + 1000).alias("place")).join(seeds.select("id"), "id", "left_anti")
    out = seeds.union(hop.select("id", F.lit(2).alias("tier"), "place", F.lit(0.0).alias("score")))
    if asks:
        files = edges.where(F.col("edge_type") == graph.DEFINED_IN).join(seeds.select(F.col("id").alias("from_id")), "from_id").select(F.col("to_id").alias("id"))
        both = dependents(edges, seeds, k, name).withColumn("place", F.col("place") + 2000).union(dependents(edges, files, k, name).withColumn("place", F.col("place") + 3000))
        more = both.groupBy("id").agg(F.min("place").alias("place")).join(out.select("id"), "id", "left_anti").orderBy("place", name(F.col("id"))).limit(k)
        out = out.union(more.select("id", F.lit(2).alias("tier"), "place", F.lit(0.0).alias("score")))
    return out.join(nodes.select("id"), "id", "left_semi")


def markdown(items: DataFrame) -> str:
    """A dense answer of items (tier, seq, lang, text) in their order: a heading and a fenced block for each."""
    rows = items.orderBy("tier", "seq").collect()  # what a token budget let through
    return "".join(f"### {TIERS[r['tier']]}\n```{r['lang'] or ''}\n{r['text']}\n```\n\n" for r in rows)


def answer(items: DataFrame, max_tokens: int) -> DataFrame:
    """Items (id, tier, place, lang, text) that fit a budget, tier by tier in the order of place."""
    return budget.fit(items.withColumn("answer", F.lit(0)), "answer", "tier", "place", "text", max_tokens).withColumn("seq", F.col("place"))
