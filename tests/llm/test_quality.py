import math
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext

from weftline.llm import quality

from pyspark.sql import functions as F

from .corpora import edge_rows, empty, frame

ORDER = quality.ORDER


def plain_model(texts):
    """Modified Kneser-Ney over byte n-grams, straight from its definition; prob(context, byte)."""
    grams = {ORDER: Counter()}
    for t in texts:
        b = quality._PAD + t.translate(quality._PLAIN)
        for i in range(ORDER - 1, len(b)):
            grams[ORDER][b[i - ORDER + 1 : i + 1]] += 1
    for k in range(ORDER - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    disc = {}
    for k, c in grams.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        raw = [1 - 2 * y * n[2] / n[1] if n[1] else y, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        disc[k] = [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]
    after = {k: {} for k in grams}
    for k, c in grams.items():
        for g, n in c.items():
            after[k].setdefault(g[:-1], {})[g[-1]] = n

    def prob(gram):
        k = len(gram)
        if not k:
            return 1 / 256
        low = prob(gram[1:])
        own = after[k].get(gram[:-1])
        if not own:
            return low
        total = sum(own.values())
        d = lambda n: disc[k][min(n, 3) - 1] if n else 0.0
        gamma = sum(d(n) for n in own.values()) / total
        n = own.get(gram[-1], 0)
        return max(n - d(n), 0) / total + gamma * low

    return prob


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    syllables = ["the", "on", "er", "in", "at", "ed", "ing", "é"]
    rows = []
    for i in range(n):
        t = " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60)))
        rows.append((i, t + ".", "en" if i % 4 else "fr"))
    return rows


@pytest.mark.parametrize("shard", [1_000_000, 100])
def test_likelihoods_match_the_definition(spark, monkeypatch, shard):
    monkeypatch.setattr(quality, "SHARD_TYPES", shard)
    monkeypatch.setattr(quality, "SCORED", 1 << 20 if shard > 100 else 2000)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").orderBy(F.rand()).repartition(5)  # in no fixed order
    trusted = docs.where("doc_id < 40")
    models = {(lang, f): plain_model([t.encode() for d, t, x in rows if d < 40 and x == lang and quality.fold_of(d) == f]) for lang in ("en", "fr") for f in (0, 1)}
    found = quality.scores(docs, trusted).collect()
    assert sorted(r.doc_id for r in found) == [r[0] for r in rows]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("weftline_chunks")]
    for r in found:
        text = quality._PAD + rows[r.doc_id][1].encode().translate(quality._PLAIN)
        prob = models[r.lang, 1 - quality.fold_of(r.doc_id)]
        want = -sum(math.log(prob(text[i - ORDER + 1 : i + 1])) for i in range(ORDER - 1, len(text)))
        assert r.nll == pytest.approx(want, rel=1e-5)
        assert r.n == len(text) - ORDER + 1


def test_probabilities_sum_to_one():
    code = np.concatenate([quality.codes(t.encode()) for _, t, _ in corpus()])
    tables, own = {}, None
    for k in range(ORDER, 0, -1):
        own = np.unique(code, return_counts=True) if k == ORDER else np.unique(np.unique(own[0]) & ((1 << 8 * k) - 1), return_counts=True)
        tables[k] = own
    model = quality.Model(tables, {k: (0.6, 1.1, 1.4) for k in range(1, ORDER + 1)})
    for context in (code[100] >> 8, 0x2061626364 & 0xFFFFFFFF, 0):
        assert np.exp(model.score((int(context) << 8) + np.arange(256))).sum() == pytest.approx(1, abs=1e-4)


def test_quantile_and_keep_match_brute_force(spark):
    rows = corpus(150, 4) + [(None, "%%$# 00 @@" * 30, "en"), (7, "another text of document seven", "en"), (3, corpus(150, 4)[3][1], "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    good = {d for d in range(0, 150, 2)}
    labels = spark.createDataFrame([(d, int(d in good)) for d in range(150)], "doc_id long, quality int")
    trusted = [(d, t, x) for d, t, x in rows if d in good]
    models = {(x, f): plain_model([t.encode() for d, t, y in trusted if y == x and quality.fold_of(d) == f]) for x in ("en", "fr") for f in (0, 1)}
    nll = []
    for d, t, x in rows:
        text, prob = quality._PAD + t.encode().translate(quality._PLAIN), models[x, 1 - quality.fold_of(d)]
        nll.append(-sum(math.log(prob(text[i - ORDER + 1 : i + 1])) for i in range(ORDER - 1, len(text))))
    size = [len(t.encode()) for _, t, _ in rows]
    for quantile in (0.5, 0.9):
        want = []
        for lang in ("en", "fr"):
            sure = [i for i, r in enumerate(rows) if r[2] == lang and r[0] in good]
            mean = sum(nll[i] for i in sure) / sum(size[i] for i in sure)
            level = [(nll[i] + quality.PRIOR_BYTES * mean) / (size[i] + quality.PRIOR_BYTES) for i in range(len(rows))]
            bins = sorted(math.ceil(level[i] / quality.STEP) for i in sure)
            limit = bins[math.ceil(len(bins) * quantile - 1e-9) - 1] * quality.STEP
            want += [(r[0], round(math.exp(level[i]), 3), round(math.exp(limit), 3), level[i] <= limit) for i, r in enumerate(rows) if r[2] == lang]
        out = quality.classify(docs, labels, quantile).collect()
        got = [(r.doc_id, round(r.perplexity, 3), round(r.threshold, 3), r.keep) for r in out]
        close = lambda a, b: a[0] == b[0] and abs(a[1] - b[1]) < 0.003 and abs(a[2] - b[2]) < 0.003 and a[3] == b[3]
        assert all(close(a, b) for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True))
        stay = {(r.doc_id, r.text) for r in quality.kept(docs, labels, quantile).collect()}
        assert {d for d, *_, k in want if k} == {d for d, _ in stay}


def test_junk_goes_and_clean_text_stays(spark):
    rows = corpus(300, 2)
    rng = random.Random(3)
    junk = [(1000 + i, " ".join(f"{rng.randrange(10**6):x}%%{rng.choice('#$&@')}" for _ in range(40)), "en") for i in range(40)]
    labels = spark.createDataFrame([(i, 1) for i in range(200)] + [(1000 + i, 0) for i in range(20)] + [(5, 1), (None, 1)], "doc_id long, quality int")
    out = {r.doc_id: r.keep for r in quality.classify(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string"), labels).collect()}
    assert not any(out[1000 + i] for i in range(40))
    assert sum(not out[i] for i in range(300)) <= 6
    kept = quality.kept(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string"), labels)
    assert kept.columns == ["doc_id", "text", "lang"] and kept.count() == sum(out.values())


def test_edge_cases(spark):
    labels = spark.createDataFrame([(5, 1), (6, 1), (13, 1), (0, None)], "doc_id long, quality int")
    docs = frame(spark, edge_rows())
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(edge_rows())
    assert all(r.keep and r.n_bytes == 0 for r in out if r.doc_id in (0, 1))
    assert all(r.keep and r.perplexity is None for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(empty(spark), labels).count() == 0
    assert quality.kept(docs, labels).columns == docs.columns


def kernel(monkeypatch, spark, make):
    """The function that a query's first mapInArrow takes, and batches for it: 12 languages, 23 MB of text."""
    found, frame_type = [], type(spark.range(0))
    with monkeypatch.context() as m:
        m.setattr(frame_type, "mapInArrow", lambda self, f, schema: found.append(f) or spark.createDataFrame([], schema), raising=False)
        m.setattr(quality, "saved", lambda df, name: df)
        make()
    rng = random.Random(11)
    texts = [random_text(rng) for _ in range(12)]

    def batches():
        for k in range(10):
            for i, t in enumerate(texts):
                yield pa.RecordBatch.from_arrays([pa.array([2 * (12 * k + i)]), pa.array([t]), pa.array([f"l{i:02}"])], ["doc_id", "text", "lang"])

    return found[0], batches


def random_text(rng):
    known = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(3000)]
    return " ".join(rng.choices(known, k=31_000))


def anonymous_mb():
    """MB that this process holds beside mapped files."""
    with open("/proc/self/smaps_rollup") as f:
        return sum(int(x.split()[1]) for x in f if x.startswith(("Pss_Anon", "Pss_Shmem"))) / 1024


KERNELS = {
    "counts": lambda docs: quality.ngram_counts(docs),
    "chunks": lambda docs: quality._chunks(docs, [f"l{i:02}" for i in range(12)], {(f"l{i:02}", k) for i in range(12) for k in (0, 1)}),
}


@pytest.mark.parametrize("name", KERNELS)
def test_a_tasks_memory_does_not_grow_with_languages_and_goes_back(spark, monkeypatch, name):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    each, batches = kernel(monkeypatch, spark, lambda: KERNELS[name](docs))
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 0)))
    size = sum(b.column(1).nbytes for b in batches())
    before = anonymous_mb()
    tracemalloc.start()
    try:
        for _ in each(batches()):
            pass
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert size > 20e6
    assert most < 100e6  # codes of all languages' texts take 8 times their size
    assert anonymous_mb() - before < 50


def test_small_chunks_and_blocks_give_the_same_counts_and_likelihoods(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string").coalesce(2)
    trusted = docs.where("doc_id < 40")
    take = lambda: (sorted(map(tuple, quality.ngram_counts(trusted).collect()), key=str), sorted((r.doc_id, r.n, r.nll) for r in quality.scores(docs, trusted).collect()))
    counts, found = take()
    monkeypatch.setattr(quality, "CHUNK", 1500)
    monkeypatch.setattr(quality, "GATHERED", 3000)
    monkeypatch.setattr(quality, "SORTED", 300)
    again, cut = take()
    assert again == counts
    assert [x[:2] for x in cut] == [x[:2] for x in found]
    assert [x[2] for x in cut] == pytest.approx([x[2] for x in found], rel=1e-6)
