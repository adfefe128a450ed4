import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from weftline.llm import quality, queries  # noqa: E402

from .corpora import edge_rows, frame  # noqa: E402
from .test_decontamination import plain as leaked  # noqa: E402
from .test_lines import plain as without_lines  # noqa: E402
from .test_nearcopies import plain as near_groups  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    at = str(tmp_path_factory.mktemp("corpus"))
    syllables = ["the", "on", "er", "in", "at", "ed", "ing"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(40)) for i in range(5)]
    rows = []
    for d in range(160):
        t = text(rng.randrange(20, 200))
        if d % 10 == 1:
            t = rows[d - 1][1].replace(" ", "  ")
        elif d % 10 == 2:
            t += "\nA line of licence terms that many of these documents share.\nend"
        elif d % 20 == 3:
            t += f" {items[d % 5][1]}"
        elif d % 20 == 5:
            t = " ".join(f"{rng.randrange(10**6):x}%%#" for _ in range(60))
        rows.append((d, t, "en", "s", len(t), d, 0.1, "k"))
    frame(spark, rows + [(900 + i, *r[1:]) for i, r in enumerate(edge_rows()[:5])]).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, int(d % 20 != 5), 0) for d in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_do_what_plain_versions_do(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder)
        assert after.columns == docs.columns
        a, b = [(r.doc_id, r.text) for r in before.collect()], [(r.doc_id, r.text) for r in after.collect()]
        if name == "quality":
            bad = {r.doc_id for r in quality.classify(before, spark.read.parquet(f"{folder}/labels.parquet")).collect() if not r.keep}
            assert bad and sorted(d for d, _ in b) == sorted(d for d, _ in a if d not in bad)
        elif name == "line_dedup":
            import hashlib

            want = {(d, h) for d, _, _, h in without_lines(a)}
            assert {(d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in b} == want and len(a) == len(b)
            assert any("licence" in (t or "") for _, t in b) and sum("licence" in (t or "") for _, t in b) == 1
            assert all(r.n_chars == len(r.text) for r in after.collect())
        elif name == "near_duplicates":
            assert sorted(b, key=str) == sorted({x for x, (d, c) in zip(sorted(a, key=str), near_groups(sorted(a, key=str))) if d == c}, key=str)
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            bad = {d for d, *_ in leaked(a, items)}
            assert bad and sorted(b) == sorted(x for x in a if x[0] not in bad)
        before = after
    kept = {r.doc_id for r in before.collect()}
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == kept
    fill = {}
    for p in pieces:
        fill[p.sequence_id] = fill.get(p.sequence_id, 0) + p.length
    assert max(fill.values()) <= 1024


ODD = "doc_id long, text string, lang string, `row` string, `__id` long, `keep` string, `a.b` int, n_chars int"


def odd_rows():
    """Repeated rows, rows of one doc_id with other texts, rows without one, and null columns."""
    rng = random.Random(31)
    words = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    item, line, copy = words(40), "A line of terms that many of these documents share, in all of them.", words(80)
    texts = [(d, words(60) + (f"\n{line}" if d < 8 else "")) for d in range(12)]
    texts += [(3, words(50)), (3, f"{words(5)} {item}"), (None, f"{words(9)} {item} {words(9)}"), (None, words(30)), (None, copy), (20, copy), (21, copy + " end"), (5, copy)]
    texts += [(30, None), (31, ""), texts[0], texts[0]]
    return [(d, t, None if (d or 0) % 2 else "en", "r", i, "k", None, None) for i, (d, t) in enumerate(texts)], item


def test_odd_rows_and_names(spark, tmp_path):
    rows, item = odd_rows()
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(d, 1, 0) for d in range(0, 12, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality", "line_dedup", "near_duplicates", "decontamination"):
        assert stages[name](spark, docs, str(tmp_path)).columns == docs.columns
        assert stages[name](spark, docs.limit(0), str(tmp_path)).collect() == []
    assert stages["packing"](spark, docs.limit(0), str(tmp_path)).collect() == []
    a = [(r.doc_id, r.text) for r in docs.collect()]
    lines = {(d, h) for d, _, _, h in without_lines(a)}
    import hashlib

    out = stages["line_dedup"](spark, docs, str(tmp_path)).collect()
    assert {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in out} == lines and len(out) == len(rows)
    near = [(r.doc_id, r.text) for r in stages["near_duplicates"](spark, docs, str(tmp_path)).collect()]
    copies = {x for x in a if x[1] in (rows[16][1], rows[18][1])}
    assert set(near) == ({x for x in a if x not in copies} - {(31, "")}) | {(5, rows[16][1])} and len(near) == len(set(near))
    clean = sorted(((r.doc_id, r.text) for r in stages["decontamination"](spark, docs, str(tmp_path)).collect()), key=str)
    assert clean == sorted((x for x in a if item not in (x[1] or "")), key=str)


def test_queries_are_all_there():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
