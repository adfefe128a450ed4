import random
import zlib

import numpy as np

from weftline.llm import toxicity

from .corpora import edge_rows, empty, frame

BAD = ["rotten", "foul", "vile"]


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{rng.randrange(200)}" for _ in range(rng.randrange(3, 60))]
        toxic = i % 5 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
            if rng.random() < 0.7:
                w.append("women")
        elif rng.random() < 0.03:
            w.append(rng.choice(["women", "men"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_folds(spark):
    rows, labels = corpus()
    docs, own = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, own).collect()
    assert len(out) == 600
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(r.score, r.doc_id % 5 == 0, r.predicted) for r in out if r.held_out]
    assert np.mean([p == t for _, t, p in held]) > 0.95
    flipped = spark.createDataFrame([(d, q, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t) for d, q, t in labels], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, toxicity.toxicity(docs, flipped).collect())) == sorted(map(tuple, out))  # the held-out labels aren't read


def test_swaps_pull_identity_terms_together(spark):
    rows, labels = corpus()
    docs, own = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    spread = {}
    for swap in (0.0, 20.0):
        weights, _ = toxicity.train(docs, own, swap=swap, identity=["women", "men", "black"])
        terms = [weights.get(t, 0.0) for t in ("women", "men", "black")]
        spread[swap] = max(terms) - min(terms)
    assert spread[20.0] < 0.5 * spread[0.0]


def biased(spark, n=900):
    """Toxic documents of which most name women, and neutral mentions of other groups more than of women."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(10, 40))]
        toxic = i % 4 == 0
        if toxic:
            w += [rng.choice(BAD)] * (rng.random() < 0.9) + ["women"] * (rng.random() < 0.7)
        elif rng.random() < 0.3:
            w.append(rng.choice(["muslim", "black", "elderly", "asian", "deaf", "gay"]))
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_stems_carry_no_identity_past_the_penalty(spark):
    docs, labels = biased(spark)
    change = {}
    for swap in (0.0, toxicity.SWAP):
        weights, _ = toxicity.train(docs, labels, swap=swap)
        z = lambda text: sum(weights.get(f, 0.0) for f in toxicity._words(text))  # noqa: E731,B023
        change[swap] = np.mean([abs(z("women") - z(t)) for t in toxicity.IDENTITY if t != "women"])
    assert change[toxicity.SWAP] < 0.4 * change[0.0]


def test_neutral_mentions_are_flagged_less(spark):
    docs, labels = biased(spark)
    neutral = spark.createDataFrame([(i, f"the women of w{i} and w{i + 1} met w{i + 2}") for i in range(100)], "doc_id long, text string")
    scores = {}
    for swap in (0.0, toxicity.SWAP):
        weights, bias = toxicity.train(docs, labels, swap=swap)
        scores[swap] = [r.score for r in toxicity.score(neutral, weights, bias).collect()]
    flagged = {k: sum(x >= toxicity.THRESHOLD for x in v) for k, v in scores.items()}
    assert np.mean(scores[toxicity.SWAP]) < np.mean(scores[0.0]) and flagged[toxicity.SWAP] <= min(5, flagged[0.0])


def test_swaps_are_the_whole_feature_set():
    index = {f: i for i, f in enumerate(["women", "^wome", "men", "girls", "^girl"])}
    own = toxicity._words("women x")
    assert sorted(map(sorted, toxicity._swaps(own, index, ["women", "men", "girls"]))) == sorted(map(sorted, [[3, -1, -2], [4, 5, -1, -2]]))
    own = toxicity._words("women womenfolk")  # another word has the stem as well
    assert [sorted(x) for x in toxicity._swaps(own, index, ["women", "men"])] == [[-1, 3]]


def test_fit_is_of_the_least_loss():
    """Gradient steps against finite differences: no direction lowers the loss that the docstring states."""
    rng = np.random.default_rng(3)
    rows = [set(rng.choice(6, 3, replace=False).tolist()) for _ in range(60)]
    y, swaps = rng.integers(0, 2, 60).astype(float), [[1, -2], [3, 4, -1], [-6, 2]]
    ridge, swap = 0.05, 0.5

    def loss(w, b):
        z = np.array([b + sum(w[f] for f in r) for r in rows])
        share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(rows)
        change = [sum(np.sign(f) * w[abs(f) - 1] for f in x) for x in swaps]
        return (share * np.logaddexp(0, np.where(y > 0, -z, z))).sum() + ridge * (w**2).sum() + swap * np.mean(np.square(change))

    w, b = toxicity.fit(rows, y, 6, swaps, ridge=ridge, swap=swap)
    for _ in range(30):
        step = rng.normal(size=7) * 0.02
        assert loss(w, b) <= loss(w + step[:6], b + step[6]) + 1e-5


def test_repeated_ids_give_the_same_scores(spark):
    rows, labels = corpus()
    rows = rows + [(d, f"other text of document {d} foul women") for d in range(0, 300, 3)]
    own = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = [sorted(map(tuple, toxicity.toxicity(spark.createDataFrame(r, "doc_id long, text string").repartition(n), own).collect())) for r, n in ((rows, 2), (rows[::-1], 7))]
    assert out[0] == out[1] and len(out[0]) == len(rows)


def test_edge_cases(spark):
    docs = frame(spark, edge_rows())
    labels = spark.createDataFrame([(5, 0, 1), (6, 1, 0), (3, 1, None), (None, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0), labels.where("toxic = 0")):
        out = toxicity.toxicity(docs, own).collect()
        assert len(out) == len(edge_rows()) and all(0 <= r.score <= 1 for r in out)
        assert all(r.held_out is None for r in out if r.doc_id is None)
    assert toxicity.toxicity(empty(spark), labels).count() == 0
