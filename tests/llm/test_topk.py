import numpy as np
import pytest

from weftline.llm import topk


def plain(rows, k=10):
    clean = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in dict((q, v) for q, v in clean if q % 100 == 0).items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in clean if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [64 << 20, 6000])
def test_matches_brute_force(spark, block_bytes):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in rng.permutation(900)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)]  # ties
    rows += [(2000, None), (2001, [float("nan")] * 8), (2002, [float("inf")] + [0.0] * 7), (2003, [None] * 8), (2004, [0.0] * 8), (2100, [])]
    df = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5))
    found = topk.top_k(df, df.where("vec_id % 100 = 0"), block_bytes=block_bytes)
    assert sorted(map(tuple, found.collect())) == plain(rows)


def test_few_and_none(spark):
    make = lambda rows: topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"))
    few = make([(0, [1.0, -1.0], 1), (1, [0.25, 0.0], 2), (2, [1.0, 0.0], 3)])
    assert sorted(map(tuple, topk.top_k(few, few.where("vec_id % 100 = 0")).collect())) == [(0, 1, 2, 1 << 20), (0, 2, 1, 1 << 18)]
    none = make([])
    assert topk.top_k(none, none).count() == 0
    lone = make([(100, [1.0], 0)])
    assert topk.top_k(lone, lone).count() == 0


def test_scatter_skips_zeros():
    q, b = np.array([[1, 0, 3], [0, 0, 2]]), np.array([[5, 1, 0], [0, 7, 1]])
    assert (topk.scatter(q, b) == q @ b.T).all()


def test_query_gives_what_its_sql_gives(spark, data):
    import duckdb

    from weftline.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    want = con.execute(queries.ORACLE_SQL["op2_topk"]).fetchall()
    assert sorted(map(tuple, queries.op2_topk(spark, data).collect())) == sorted(want)


def test_repeated_candidates_count_each(spark):
    rows = topk.integer_vectors(spark.createDataFrame([(100, [1.0])] + [(7, [0.5])] * 40, "vec_id long, embedding array<float>"))
    out = topk.top_k(rows, rows.where("vec_id = 100")).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(out, key=lambda r: r["rank"])] == [(i, 7) for i in range(1, 11)]
