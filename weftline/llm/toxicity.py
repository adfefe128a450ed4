"""Toxicity: a linear classifier of words and stems whose score changes under swapped identity terms are penalised."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, saved, small_batches, texts

#: Labelled rows that are fitted (those of the least hashes of their ids).
MAX_ROWS = 20_000
#: Documents in which a word must be, of the fitted ones, and the least chi-square of its presence and the label.
MIN_DOCS, MIN_CHI = 3, 10.83
#: Letters of a longer word's stem, which is a feature too.
STEM = 4
#: Weight of the penalties on weights and on score changes under swaps, and the number of steps.
RIDGE, SWAP, STEPS = 1e-4, 1.0, 400
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Terms that name groups of people; swapping one for another shouldn't change what is toxic.
IDENTITY = (
    "women men woman man girls boys christian muslim jewish hindu buddhist atheist gay straight lesbian bisexual "
    "transgender black white asian african european latino american immigrant immigrants refugee disabled deaf blind "
    "old young elderly femmes hommes musulman juif frauen männer muslime juden mujeres hombres musulmanes judíos"
).split()
_WORD = re.compile(r"\w+")


def fold(doc_id: F.Column, folds: int = FOLDS) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _words(text: str) -> set[str]:
    """A text's distinct words, and their stems after a caret."""
    own = set(_WORD.findall(text.lower()))
    return own | {"^" + w[:STEM] for w in own if len(w) > STEM}


def _swaps(own: set[str], index: dict[str, int], identity: list[str]) -> list[list[int]]:
    """A row's counterfactuals: for each identity term in it and each other one, the features that change.

    The whole feature set of the swapped text counts: a term's stem goes with it, unless another word of the
    row has it too, and the new term brings its own. Features are numbered from 1; those that go are negative.
    """
    made = []
    words = {w for w in own if w[0] != "^"}
    for out in identity:
        if out not in words:
            continue
        rest = words - {out}
        kept = rest | {"^" + w[:STEM] for w in rest if len(w) > STEM}
        for term in identity:
            if term not in own:
                other = kept | _words(term)
                made.append([index[f] + 1 for f in sorted(other - own) if f in index] + [-index[f] - 1 for f in sorted(own - other) if f in index])
    return made


def fit(rows: list[set[int]], y: np.ndarray, n_words: int, swaps: list[list[int]], ridge: float = RIDGE, swap: float = SWAP) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model of the presence of words and stems.

    The loss is the mean log loss, in which both labels weigh the same, ridge times the squared weights, and
    swap times the mean squared change of a row's score in its counterfactuals (swaps: signed features, from 1). Gradient steps with per-weight scaling (Adam) from zero, so the result is a function
    of the rows and their order alone.
    """
    sizes = np.array([len(r) for r in rows], np.int64)
    of = np.repeat(np.arange(len(rows)), sizes)
    at = np.array([w for r in rows for w in sorted(r)], np.int64)
    pair = np.repeat(np.arange(len(swaps)), [len(x) for x in swaps]) if swaps else np.zeros(0, np.int64)
    signed = np.array([f for x in swaps for f in x], np.int64)
    feature, sign = np.abs(signed) - 1, np.sign(signed).astype(float)
    rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    w, bias = np.zeros(n_words), float(np.log(rate / (1 - rate)))
    share = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate)) / max(len(rows), 1)
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for t in range(1, STEPS + 1):
        z = bias + np.bincount(of, w[at], len(rows))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        error = (p - y) * share
        grad = np.bincount(at, error[of], n_words) + 2 * ridge * w
        if len(signed):
            change = np.bincount(pair, w[feature] * sign, len(swaps))
            grad += np.bincount(feature, 2 * swap / len(swaps) * change[pair] * sign, n_words)
        g = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, identity: list[str] | None = None, swap: float = SWAP) -> tuple[dict[str, float], float]:
    """(weights by word, bias), learnt from labelled rows outside the held-out fold.

    At most max_rows labelled documents are fitted, those whose ids hash least; their texts are taken whole. Of
    an id's rows with other texts, the one whose text hashes least is fitted, so weights are a function of the
    tables. Every word and stem in MIN_DOCS of them whose presence goes with the label (chi-square of MIN_CHI or
    more) has a weight, and so have the identity terms and their stems.
    """
    identity = IDENTITY if identity is None else identity
    small_batches(docs.sparkSession)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    own = own.where(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = saved(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "labels")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sorted(_words(t)) for t in texts(b.column(2))], pa.list_(pa.string()))], ["doc_id", "toxic", "words"])

    labelled = rows.join(F.broadcast(own), "doc_id")  # at most max_rows ids
    labelled = labelled.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("doc_id", "toxic", "x.text")
    bags = saved(few(labelled).mapInArrow(split, "doc_id long, toxic int, words array<string>"), "bags")
    size = bags.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    n, pos = size["n"], size["pos"]
    if not n:
        return {}, float(np.log(1e-3 / (1 - 1e-3)))
    seen = bags.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("pos")).where(F.col("n") >= MIN_DOCS)
    share = F.lit(pos / n)
    chi = F.pow(F.col("pos") - F.col("n") * share, 2) / (F.col("n") * share * (1 - share) * (1 - F.col("n") / F.lit(n)) + 1e-9)
    seen = seen.where(chi >= MIN_CHI)
    chosen = [r["word"] for r in seen.select("word").collect()]  # words of at most max_rows documents, each in several
    chosen = sorted({*chosen, *(f for t in identity for f in _words(t))})
    index = {w: i for i, w in enumerate(chosen)}
    held = docs.sparkSession.sparkContext.broadcast(index)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(2).to_pylist()
            own = [[held.value[w] for w in ws if w in held.value] for ws in words]
            swaps = [_swaps(set(ws), held.value, list(identity)) if swap else [] for ws in words]
            columns = [b.column(0), b.column(1), pa.array(own, pa.list_(pa.int32())), pa.array(swaps, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "words", "swaps"])

    coded = bags.mapInArrow(code, "doc_id long, toxic int, words array<int>, swaps array<array<int>>").orderBy("doc_id").toArrow()  # at most max_rows rows
    swaps = [x for xs in coded.column("swaps").to_pylist() for x in xs]
    w, bias = fit([set(x) for x in coded.column("words").to_pylist()], coded.column("toxic").to_numpy().astype(float), len(chosen), swaps, swap=swap)
    return {c: float(x) for c, x in zip(chosen, w, strict=True) if abs(x) > 1e-9}, bias


def score(docs: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """(doc_id, score) of every document, from its words alone; weights are broadcast (a bounded number)."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = held.value
        for b in batches:
            z = np.array([bias + sum(sorted(weight[w] for w in _words(t) & weight.keys())) for t in texts(b.column(1))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; options: those of train().

    score is 0 to 1, higher where label 1 is likelier. Null and empty texts have the bias's score. Labels that
    are null or not 0 or 1 are ignored; a document labelled twice is toxic if either label says so. Without
    labelled rows every score is the same and low. held_out is null for a null doc_id. Rows that repeat are
    scored each, and rows of one doc_id by their own texts; very long texts are taken whole. An empty table
    gives no rows.
    """
    weights, bias = train(docs, labels, **options)
    out = score(docs, weights, bias)
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
