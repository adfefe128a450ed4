import random
import re

import pytest

from weftline.llm import decontamination as D

from .corpora import edge_rows, empty, frame, words


def plain(docs, items, k=5, least=0.8):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = {}
    for item, text in items:
        w = cut(text)
        if not w:
            continue
        own = grams(w, min(k, len(w)))
        for d, t in docs:
            n = len(own & grams(cut(t), min(k, len(w))))
            if n >= least * len(own) - 1e-9 and n:
                out[d, item] = max(out.get((d, item), (0, 0, 0)), (n / len(own), len(own), n))
    return sorted(((d, item, size, n) for (d, item), (_, size, n) in out.items()), key=str)


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_matches_brute_force(spark, block):
    rng = random.Random(4)
    items = [(i, words(rng, n)) for i, n in enumerate([1, 3, 5, 6, 20, 60, 60, 0])] + [(8, None), (9, "")]
    docs = []
    for d in range(120):
        w = words(rng, rng.randrange(300)).split()
        if d % 2:
            own = (items[d % 7][1]).split()
            for _ in range(d % 3):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = " ".join(own).upper().split()
        docs.append((d, (", " if d % 5 else " ").join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, D.leaks(df, bench, block=block).collect()), key=str) == plain(docs, items)


def test_edge_cases(spark):
    bench = spark.createDataFrame([(1, "own 1"), (1, "own 1"), (2, None)], "item_id long, text string")
    docs = frame(spark, edge_rows())
    assert [(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()] == [(8, 1)]
    assert D.clean(docs, bench).count() == len(edge_rows()) - 1
    assert D.leaks(empty(spark), bench).count() == 0
    assert D.leaks(docs, bench.limit(0)).count() == 0
    assert D.clean(docs, bench.limit(0)).count() == len(edge_rows())


def test_several_texts_under_one_id(spark):
    rng = random.Random(8)
    items = [(i % 4, words(rng, 5 + 9 * i)) for i in range(8)]
    docs = [(d if d % 5 else None, f"{words(rng, 30)} {rng.choice(items)[1]} {words(rng, d)}") for d in range(40)]
    docs += [(d, f"{rng.choice(items)[1]} x") for d in range(0, 40, 3)] + docs[:4]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, D.leaks(df, bench).collect()), key=str) == plain(docs, items)
    own = docs + [(50, "clean"), (None, "clean too"), (50, items[0][1])]
    out = D.clean(spark.createDataFrame(own, "doc_id long, text string"), bench).collect()
    assert sorted(map(tuple, out), key=str) == sorted(((d, t) for d, t in own if not plain([(d, t)], items)), key=str)


def test_a_shingle_over_and_over_is_verified_once(spark):
    import time

    bench = spark.createDataFrame([(1, "foo foo foo foo foo foo")], "item_id long, text string")
    took = []
    for n in (20_000, 160_000):
        df = spark.createDataFrame([(1, "foo " * n)], "doc_id long, text string")
        began = time.time()
        assert [tuple(r) for r in D.leaks(df, bench).collect()] == [(1, 1, 1, 1)]
        took.append(time.time() - began)
    assert took[1] < 5 * took[0] + 10


def test_size_partitions(spark):
    items = D._items(spark.createDataFrame([(n, words(random.Random(n), n, 10**6)) for n in (3, 5, 6, 12, 40, 41, 300)], "item_id long, text string"), 5, 0.8)
    assert {r.item_id: (r.width, r.part, r.n) for r in items.collect()} == {3: (3, 0, 1), 5: (5, 0, 1), 6: (5, 1, 2), 12: (5, 3, 8), 40: (5, 5, 36), 41: (5, 5, 37), 300: (5, 8, 296)}
    passes = D._blocks(items, 40)
    assert len(passes) > 5 and all(sum(own[2] for own in p) for p in passes)
    assert sorted({own[:2] for p in passes for own in p}) == [(3, 0), (5, 0), (5, 1), (5, 3), (5, 5), (5, 8)]


def test_query_gives_what_its_sql_gives(spark, data):
    import duckdb

    from weftline.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL["op1_decontamination"]).fetchall()
    assert want and sorted(map(tuple, queries.op1_decontamination(spark, data).collect())) == sorted(want)


def test_plan_is_native(spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    plan = D.leaks(frame(spark, edge_rows()), bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    import inspect

    source = inspect.getsource(D)
    assert not re.search("mapIn|applyIn|udf|rdd|toPandas|toArrow", source)
