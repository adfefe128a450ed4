"""What a query reads, holds and deals doesn't outgrow its input: ids of eight bytes, inputs read once, tasks by size."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.operators import communities, evaluation, search, sizes
from weftline.operators import graph as G
from weftline.plans import graph_queries, report_queries, starschema


def plan(df):
    return df._jdf.queryExecution().toString()


def counted(spark, df):
    """df, and how many of its rows were made so far."""
    made = spark.sparkContext.accumulator(0)

    def run(frames):
        for f in frames:
            made.add(len(f))
            yield f

    return df.mapInPandas(run, df.schema), made


def test_graph_is_of_long_ids_and_keeps_nothing(spark, data):
    spark.catalog.clearCache()
    nodes, edges = starschema.graph(spark, data)
    assert dict(nodes.dtypes)["id"] == dict(edges.dtypes)["from_id"] == dict(edges.dtypes)["to_id"] == "bigint"
    graph_queries.g_degree(spark, data).count()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().isEmpty()


def test_named_is_the_stable_id(spark, data):
    for kind, key in (("task", "o_orderkey"), ("requirement", "o_custkey")):
        own = starschema.table(spark, data, "orders").select(starschema.named(starschema.coded(kind, key)).alias("x"), C.stable_id(kind, key).alias("y"))
        assert own.where("x <> y").isEmpty() and own.count()
    low = spark.sql("select -3L as k").select(starschema.named(starschema.coded("file", "k")).alias("x"), C.stable_id("file", "k").alias("y")).first()
    assert low["x"] == low["y"]


@pytest.mark.parametrize("query", [graph_queries.g_coverage, report_queries.b_hit_locations])
def test_edges_that_a_query_has_no_use_for_are_not_made(spark, data, query):
    assert "lineitem.parquet" not in plan(query(spark, data))


def test_edges_of_types_are_all_edges_of_those_types(spark, data):
    whole = starschema.edges(spark, data)
    for types in ((0,), (3,), (5,), (6,), (7, 10), (11,)):
        own, want = starschema.edges(spark, data, types), whole.where(F.col("edge_type").isin(list(types)))
        assert own.count() == want.count() and own.exceptAll(want).isEmpty()


def test_walks_filter_lines_before_they_are_dealt(spark, data):
    edges = starschema.edges(spark, data, (7,)).where(F.col("to_id") == starschema.code("symbol", 5))
    logical = plan(edges).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert logical.index("RepartitionByExpression") < logical.index("Filter")


def test_tasks_of_pairs_grow_with_the_lines(spark, data, tmp_path, monkeypatch):
    line = starschema.table(spark, data, "lineitem")
    once, four = str(tmp_path / "once"), str(tmp_path / "four")
    line.coalesce(1).write.parquet(once)
    line.union(line).union(line).union(line).repartition(2).write.parquet(four)
    monkeypatch.setattr(sizes, "SPREAD_BYTES", 4096)
    few, many = (sizes.tasks(spark.read.parquet(at)) for at in (once, four))
    assert few > 4 and many >= 2.5 * few
    dealt = [int(n) for n in re.findall(r"REPARTITION_BY_NUM|RepartitionByExpression \[.*\], (\d+)", plan(starschema.supplier_partners(spark, data, 5))) if n]
    assert dealt and min(dealt) > 4 == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sizes.tasks(spark.createDataFrame([(1,)], "a int").select("a")) in (None, 1)


def test_cycles_read_their_links_once(spark):
    links, made = counted(spark, spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d")], "a string, b string"))
    assert sorted((r["cycle"], r["size"]) for r in communities.cycles(links).collect()) == [("a", 2), ("d", 3)]
    assert made.value == 6


def test_importance_reads_its_edges_once(spark):
    edges, made = counted(spark, spark.createDataFrame([("a", "b", 0), ("a", "c", 7), ("b", "c", 5), ("x", "c", 5)], "from_id string, to_id string, edge_type int"))
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = {r["id"]: r["importance"] for r in evaluation.importance(nodes, edges, spark.createDataFrame([("a", "b")], "a string, b string")).collect()}
    assert got == {"a": 52, "b": 52, "c": 3} and made.value == 4


def test_degrees_read_their_edges_once(spark):
    edges, made = counted(spark, spark.createDataFrame([("a", "b", 5, 0), ("a", "c", 7, 0), ("b", "c", 5, 0), ("x", "c", 5, 0)], "from_id string, to_id string, edge_type int, meta int"))
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = {r["id"]: (r["in_degree"], r["out_degree"], r["degree"]) for r in G.degrees(nodes, edges).collect()}
    assert got == {"a": (0, 2, 2), "b": (1, 1, 2), "c": (2, 0, 2)} and made.value == 4


def test_khop_makes_its_seeds_once(spark):
    seeds, made = counted(spark, spark.createDataFrame([("a",)], "id string"))
    edges = spark.createDataFrame([("a", "b", 7), ("b", "c", 7), ("c", "d", 7), ("b", "a", 7)], "from_id string, to_id string, edge_type int")
    assert sorted(map(tuple, G.khop(edges, seeds, 2, (7,)).collect())) == [("a", 0), ("b", 1), ("c", 2)]
    assert made.value == 1


def test_barrels_shuffle_only_edges_of_files_that_re_export(spark, data):
    text = plan(G.barrels(*starschema.graph(spark, data, G.DEPENDENCIES)))
    assert "BroadcastHashJoin [from_id" in text


@pytest.mark.parametrize("percent", [0, 0.5, 10, 50, 99, 100])
def test_top_percent_with_ties(spark, percent):
    rng = random.Random(percent)
    rows = [(f"{i:04d}", rng.choice([None, 1, 1, 1, 2, 3])) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, importance int").repartition(7)
    out = evaluation.top_percent(df, percent, 600)
    want = sorted(rows, key=lambda r: (-(r[1] or 0), r[0]))[: max(1, math.ceil(600 * percent / 100))]
    assert sorted(out.collect(), key=str) == sorted(want, key=str)


def test_top_percent_orders_only_the_last_places_rows(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 4).alias("importance"))
    assert "TakeOrdered" not in plan(evaluation.top_percent(df, 25, 1000))
    assert {r["importance"] for r in evaluation.top_percent(df, 25, 1000).collect()} == {3}
    assert [r["id"] for r in evaluation.first_rows(df, "id", 700).orderBy("id").collect()] == sorted(map(str, range(1000)))[:700]


def test_postings_shuffle_once_and_split_texts_once(spark):
    docs, made = counted(spark, spark.createDataFrame([(1, "a b a"), (2, "b c"), (2, "b"), (3, None), (4, "a b a")], "doc_id long, text string"))
    got = search.index(docs, "doc_id")["postings"].groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
    assert sorted(map(tuple, got.collect())) == [("a", 2, 4), ("b", 4, 4), ("c", 1, 1)]
    assert plan(got).split("== Physical Plan ==")[1].split("== Initial Plan ==")[-1].count("Exchange ") == 1 and made.value == 5
    stored = search.stored_index(docs, "doc_id")
    assert made.value == 10 and tuple(stored["sizes"].first()) == (5, 1.8)
    assert sorted(map(tuple, stored["postings"].collect())) == sorted(map(tuple, search.postings(docs, "doc_id").collect()))


def test_scores_are_dealt_before_they_are_summed(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "c d e")], "doc_id long, text string")
    made = search.stored_index(docs, "doc_id")
    asked = spark.createDataFrame([(7, "a b"), (8, "e")], "query_id long, text string")
    out = search.bm25_stored(made["postings"], made["sizes"], asked)
    assert [(r["query_id"], r["rank"], r["id"]) for r in out.orderBy("query_id", "rank").collect()] == [(7, 1, 1), (7, 2, 2), (8, 1, 3)]
    assert re.search(r"Exchange hashpartitioning\(query_id#\d+L, id#\d+L, \d+\), REPARTITION_BY", plan(out))


def test_neighbours_are_exact_in_blocks_and_chunks(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 6)).round(2)
    base[40:90] = base[7]  # ties
    base[95], base[96] = 0, np.nan
    ids = np.concatenate([np.arange(290), np.arange(10)])  # some ids twice
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, base, strict=True)], "vec_id long, embedding array<double>").repartition(5)
    asked = df.select(F.col("vec_id").alias("query_id"), "embedding")
    clean = np.where(np.isfinite(base), base, 0)
    unit = clean / np.maximum(np.linalg.norm(clean, axis=1, keepdims=True), 1e-300)
    far = np.round(1 - np.clip(unit @ unit.T, -1, 1), 9)
    for k in (3, 20, 400):
        want = []
        for q in np.unique(ids).tolist():
            all_ = sorted((far[i, j], int(ids[j])) for i in np.flatnonzero(ids == q) for j in range(300) if ids[j] != q)
            want += [(q, n + 1, d, round(float(f), 6)) for n, (f, d) in enumerate(all_[:k])]
        got = search.nearest(df, asked, k, held_bytes=2048 * 6, most_asked=70).collect()
        assert sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 6)) for r in got) == sorted(want)


def test_more_queries_are_more_tasks(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)], "vec_id long, embedding array<double>")
    asked = df.select(F.col("vec_id").alias("query_id"), "embedding")
    blocks = spark.sparkContext.defaultParallelism
    for most, chunks in ((200, 1), (20, 10)):
        text = plan(search.nearest(df, asked, 3, most_asked=most)).split("== Physical Plan ==")[1]
        assert re.search(rf"Exchange [^\n]*\b{blocks * chunks}\), REPARTITION_BY_NUM", text)
