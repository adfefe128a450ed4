import random

from weftline.llm import nearcopies

from .corpora import edge_rows, empty, frame, words


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def plain(rows):
    made = [(d, sets(t)) for d, t in rows]
    root = list(range(len(made)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(made)):
        for j in range(i):
            x, y = made[i][1], made[j][1]
            if x == y or len(x & y) >= 0.8 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(made):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, least.get(find(i))) for i, (d, _) in enumerate(made)), key=str)


def got(df):
    return sorted(map(tuple, nearcopies.groups(df).select("doc_id", "component_id").collect()), key=str)


def edited(rng, base, edits):
    out = list(base)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(rng):
    rows = []
    for g in range(12):
        base = words(rng, rng.choice([60, 150, 300])).split()
        rows.append((g * 10, " ".join(base)))
        for k in range(1, 6):  # similarities on both sides of 0.8, and chains of them
            rows.append((g * 10 + k, edited(rng, rows[-1][1].split() if k > 3 else base, rng.randrange(1, max(2, len(base) // 30)))))
    return rows


def test_groups_match_brute_force(spark):
    rows = corpus(random.Random(2))
    want = plain(rows)
    assert len({c for _, c in want}) > 12 and sum(d != c for d, c in want) > 20
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want


def test_edge_cases(spark):
    assert got(frame(spark, edge_rows())) == plain([(r[0], r[1]) for r in edge_rows()])
    assert got(empty(spark)) == []


def test_a_key_shared_by_unlike_nodes_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "sketch", lambda h: [1, 2] if len(h) else [])
    rows = corpus(random.Random(3))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_pipeline_drops_edited_copies(spark):
    import corpus_pipeline

    rng = random.Random(4)
    base = words(rng, 200).split()
    rows = [(0, " ".join(base), "a"), *((d, edited(rng, base, 3), "b") for d in range(1, 11)), (20, words(rng, 200), "c")]
    out = corpus_pipeline.without_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    assert out.columns == ["doc_id", "text", "source"] and sorted(r.doc_id for r in out.collect()) == [0, 20]


def test_recall_at_the_threshold(spark):
    """Pairs of similarity just over 0.8, most of them far beyond four bits of SimHash."""
    rng = random.Random(6)
    rows = []
    while len(rows) < 200:
        base = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice([60, 150, 400]))]
        copy = edited(rng, base, max(1, len(base) // 60))
        x, y = sets(" ".join(base)), sets(copy)
        if 0.8 <= len(x & y) / len(x | y) <= 0.9:
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, copy)]
    out = dict(got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert sum(out[d] == d - 1 for d in range(1, 200, 2)) >= 99


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(7)
    base, other = words(rng, 120).split(), words(rng, 120)
    rows = [(1, " ".join(base), "a"), (1, other, "b"), (2, edited(rng, base, 2), "c"), (None, edited(rng, base, 2), "d"), (None, words(rng, 90), "e"),
            (3, None, "f"), (4, "", "g"), (5, "x y", "h"), (5, "x y", "h"), (5, "x y", "i"), (None, "q r s", "j"), (None, "q r s", "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `row` string")
    out = sorted(((r.doc_id, r.text) for r in nearcopies.kept(df).collect()), key=str)
    assert out == sorted([(1, rows[0][1]), (1, other), (None, rows[4][1]), (3, None), (5, "x y"), (None, "q r s")], key=str)
    assert nearcopies.kept(empty(spark)).count() == 0 and nearcopies.kept(df).columns == df.columns
