"""Embedding, enrichment's contract, lessons, baselines, watchers, communities and cycles against plain versions."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.functions.tokens import exact_tokens
from weftline.operators import cochange, communities, embed, enrich, evaluation, graph, memory, search
from weftline.sources import graph_tables
from weftline.streaming import feeds


def test_vectors_follow_the_texts(spark, tmp_path):
    make = lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])
    texts = spark.createDataFrame([("a", "one"), ("b", "three"), ("c", None)], "id string, text string")
    first = embed.refreshed(texts, None, make)
    first.write.parquet(f"{tmp_path}/v")
    never = lambda: lambda texts: [np.full(2, -1.0) for _ in texts]
    then = texts.where("id <> 'b'").union(spark.createDataFrame([("d", "new")], "id string, text string"))
    out = {r.id: r.embedding for r in embed.refreshed(then, spark.read.parquet(f"{tmp_path}/v"), never).collect()}
    assert out == {"a": [3.0, 1.0], "d": [-1.0, -1.0]}
    with pytest.raises(embed.ModelNotAvailable):
        embed.local_model(str(tmp_path))
    hidden, mask = np.array([[[3.0, 0], [0, 4], [9, 9]]]), np.array([[1, 1, 0]])
    assert np.allclose(embed.pooled(hidden, mask), [[0.6, 0.8]])


def test_exact_tokens_fall_back_to_the_estimate(spark, tmp_path):
    df = spark.createDataFrame([("some text, and more",), (None,)], "t string")
    assert [r[0] for r in df.select(exact_tokens("t", None)).collect()] == [r[0] for r in df.select(C.token_estimate("t")).collect()]
    import base64

    ranks = tmp_path / "r.tiktoken"
    ranks.write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i}\n" for i in range(256)))
    assert [r[0] for r in df.select(exact_tokens("t", str(ranks))).collect()] == [19, 0]


def test_provider_contract():
    text = enrich.prompt([("a.ts", "code")], ["en", "pt"])
    assert "=== FILE: a.ts ===\ncode" in text and "en, pt" in text
    answer = json.dumps([{"path": "a", "summaries": {"EN": "x", "pt-BR": " y "}}, {"path": "b", "summaries": {"en": "x"}}, 7])
    good, bad = enrich.parsed(answer, ["a", "b", "c"], ["en", "pt"])
    assert good == {"a": {"en": "x", "pt": "y"}} and set(bad) == {"b", "c"}
    for wrong in ("no", "{}"):
        with pytest.raises(enrich.BadAnswer):
            enrich.parsed(wrong, ["a"], ["en"])


def test_budget_prices_and_state(spark, tmp_path):
    ranked = spark.createDataFrame([(f"f{i}", 10 - i, 1000) for i in range(6)], "path string, importance int, tokens long")
    one = ((1000 + 18 + 220 / 8) * 0.1 + 74 * 0.4) / 1e6
    assert enrich.within_budget(ranked, "tokens", 1, one * 3.5, (0.1, 0.4)).count() == 3
    assert evaluation.cost(10**6, 10**6, "gemini-2.5-flash") == (2.8, True) and evaluation.cost(10**6, 0, "other") == (0.1, False)
    assert evaluation.cost(10**6, 0, "other", 1.0, 2.0) == (1.0, True)
    assert evaluation.format_usd(0.001) == "$0.0010" and evaluation.format_usd(2) == "$2.00"
    states = spark.createDataFrame([("a", "stale"), ("b", "pending"), ("c", "pending")], "path string, state string")
    assert enrich.write_state(spark, f"{tmp_path}/state.json", states, {"tokens": 5}) == json.loads((tmp_path / "state.json").read_text())


def test_gates(spark):
    rows = lambda *r: spark.createDataFrame(r, "kind string, queries long, recall_at_5 double")
    assert evaluation.gate(rows(("locate", 9, 0.9), ("structure", 2, 0.0)), rows(("locate", 9, 0.95), ("structure", 2, 0.5))).count() == 0
    found = {tuple(r) for r in evaluation.gate(rows(("locate", 9, 0.7), ("behavior", 5, 0.5)), rows(("locate", 9, 0.7), ("behavior", 5, 0.6))).collect()}
    assert found == {("locate", "recall below 0.8"), ("behavior", "recall fell by more than 5 points")}
    before = {"behavior": {"recall_at_5": 0.4}, "locate": {"mrr": 0.93}, "latency": 86.0}
    assert evaluation.accepts_summaries(before, {"behavior": {"recall_at_5": 0.55}, "locate": {"mrr": 0.93}, "latency": 60.0}) == []
    assert len(evaluation.accepts_summaries(before, {"behavior": {"recall_at_5": 0.5}, "locate": {"mrr": 0.9}, "latency": 110.0})) == 3
    assert [tuple(r) for r in evaluation.accepts_memory(rows(("a", 1, 0.9), ("b", 1, 0.9)), rows(("a", 1, 0.88), ("b", 1, 0.8))).collect()] == [("b", 10.0)]


def test_baselines(spark):
    files = spark.createDataFrame([("a", "x" * 7), ("b", "y" * 35)], "id string, text string")
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "query_id int, id string")
    assert {tuple(r) for r in evaluation.whole_file_baseline(files, expected).collect()} == {(1, 2, 12), (2, 1, 2)}
    assert tuple(evaluation.corpus_baseline(files).first()) == (2, 12)


def test_secrets_after_references_are_found(spark):
    texts = ['password = "${ENVIRON_X}"\nsecret = "hunter2hunter2"', 'password = "${ENVIRON_X}"', "api_key: 'process.env.KEYKEY'", "client_secret = `abcdefgh`", 'password = "short"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(C.find_secret("t")).collect()] == ["hard-coded credential", None, None, "hard-coded credential", None]
    assert "hunter2" not in df.where("i = 0").select(C.redact_secrets("t")).first()[0]


def test_summary_weight_can_be_set(spark, monkeypatch):
    df = spark.createDataFrame([("how does a user log into the shop",), ("handleInvoice",)], "q string")
    assert [r[0] for r in df.select(C.summary_weight("q")).collect()] == [2.0, 0.0]
    assert df.select(C.summary_weight()).first()[0] == 0.5
    monkeypatch.setenv("WEFTLINE_SUMMARY_WEIGHT", "1.5")
    assert [r[0] for r in df.select(C.summary_weight("q")).collect()] == [1.5, 1.5]


def test_snippets_are_cut_by_bytes(spark):
    text = "é" * 6 + "\n" + "a" * 10
    assert spark.createDataFrame([(text,)], "t string").select(C.snippet("t", 14)).first()[0] == "é" * 6


def test_relevant_paths(spark):
    ignore = "# c\n*.log\n!keep.log\n/build/\ndocs/*.tmp\n"
    cases = {"a.log": False, "keep.log": True, "x/build/a": True, "build/a": False, "docs/a.tmp": False, "docs/x/a.tmp": True, "src/a.ts": True, "a/node_modules/b": False, ".git/HEAD": False, "target/x": False, "targets/x": True, "": False}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.ok for r in df.select("p", feeds.relevant(F.col("p"), ignore).alias("ok")).collect()} == cases


def test_a_second_watcher_is_refused(tmp_path):
    with feeds.sole_watcher(str(tmp_path)), pytest.raises(feeds.Watched), feeds.sole_watcher(str(tmp_path)):
        pass
    with feeds.sole_watcher(str(tmp_path)):
        pass


def modularity(links, member):
    m = sum(w for *_, w in links)
    total, inside = {}, 0.0
    for a, b, w in links:
        inside += w * (member[a] == member[b])
        for x in (a, b):
            total[member[x]] = total.get(member[x], 0.0) + w
    return inside / m - sum((t / (2 * m)) ** 2 for t in total.values())


def test_communities_gain_modularity_and_no_move_gains_more(spark):
    rng = random.Random(3)
    for _ in range(20):
        names = [f"n{i:02}" for i in range(14)]
        links = [(a, b, rng.choice([0.25, 1.0, 2.0])) for a, b in itertools.combinations(names, 2) if rng.random() < (0.7 if int(a[1:]) // 7 == int(b[1:]) // 7 else 0.08)]
        member = communities.local_moving(links)
        own = modularity(links, member)
        for v in member:
            for c in set(member.values()):
                assert modularity(links, {**member, v: c}) <= own + 1e-9
    a = [(x, y, 1.0) for x, y in itertools.combinations("abcd", 2)] + [(x, y, 1.0) for x, y in itertools.combinations("efgh", 2)] + [("d", "e", 0.25)]
    assert communities.local_moving(a) == dict.fromkeys("abcd", 0) | dict.fromkeys("efgh", 1)
    df = spark.createDataFrame(a, "a string, b string, weight double")
    assert {r.file: r.community for r in communities.communities(df).collect()} == communities.local_moving(a)


def test_cycles_match_reachability(spark):
    rng = random.Random(5)
    links = sorted({(f"n{rng.randrange(30):02}", f"n{rng.randrange(30):02}") for _ in range(45)} | {("x1", "x2"), ("x2", "x1")})
    links = [x for x in links if x[0] != x[1]]
    reach = {x: {x} for p in links for x in p}
    for _ in range(40):
        for a, b in links:
            reach[a] |= reach[b]
    want = {tuple(sorted(y for y in reach[x] if x in reach[y])) for x in reach}
    found = communities.cycles(spark.createDataFrame(links, "a string, b string")).collect()
    assert {tuple(r.nodes) for r in found} == {g for g in want if len(g) > 1}
    for r in found:  # without the links named, no cycle is left
        left = [x for x in links if f"{x[0]} -> {x[1]}" not in r.cut and x[0] in r.nodes and x[1] in r.nodes]
        assert communities.strong_components(left) == []


def test_chains_longer_than_any_number_of_rounds_join(spark):
    links = spark.createDataFrame([(f"{i:04}", f"{i + 1:04}") for i in range(150)], "a string, b string")
    assert {r.component for r in communities.weak_components(links).collect()} == {"0000"}


def test_capped_pairs_follow_the_sequential_rule(spark):
    rng = random.Random(8)
    commits = [(f"c{i:02}", i * 1000, sorted(rng.sample([f"f{k}" for k in range(9)], rng.randrange(2, 5)))) for i in range(25)]
    df = spark.createDataFrame(commits, "commit string, at long, files array<string>").withColumn("at", F.timestamp_seconds("at"))
    seen, used, want = set(), {}, set()
    for _, _, files in sorted(commits, key=lambda c: -c[1]):
        for a, b in itertools.combinations(files, 2):
            if (a, b) not in seen:
                seen.add((a, b))
                if used.get(a, 0) < 3 and used.get(b, 0) < 3:
                    want.add((a, b))
                    used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    assert {tuple(r) for r in cochange.capped(df, 3).collect()} == want
    assert cochange.recent(df).count() == 0  # decades old
    assert cochange.recent(df, now=F.timestamp_seconds(F.lit(30_000))).count() == 25


def test_names_are_chased_through_re_exports(spark):
    files = {
        "src/a.ts": "import { make as m, Shape } from './index';\nimport type { T } from './deep/z';\nexport function run() { return make(); }\n",
        "src/index.ts": "export * from './deep';\nexport { build as make } from './deep/z';\n",
        "src/deep/index.ts": "export { Shape } from './z';\n",
        "src/deep/z.ts": "export function build() { return 1; }\nexport class Shape {}\nexport interface T {}\n",
        "tsconfig.json": '{"extends": "./conf/base", "compilerOptions": {}}',
        "conf/base.json": "{}",
    }
    own = spark.createDataFrame(list(files.items()), "path string, content string")
    nodes, edges = graph_tables.build(own)
    names = {r.id: (r.path, r.label) for r in nodes.collect()}
    calls = {(names[r.from_id][1], names[r.to_id][1]) for r in edges.where("edge_type = 7").collect() if r.from_id in names and r.to_id in names}
    extends = {(names[r.from_id][1], names[r.to_id][1]) for r in edges.where("edge_type = 1").collect()}
    assert extends == {("tsconfig.json", "conf/base.json")}
    from weftline.sources import extract as E

    symbols, facts = E.over(own, E.symbols, E.SYMBOLS), graph_tables.resolved_imports(own, E.over(own, E.imports, E.IMPORTS))
    found = {(r.file, r.name): r.home for r in graph_tables.declaring(symbols, facts).collect()}
    assert found["src/index.ts", "make"] is not None and found["src/index.ts", "Shape"] == "src/deep/z.ts" and found["src/deep/index.ts", "Shape"] == "src/deep/z.ts"
    assert all(a == "run" for a, _ in calls)


def test_descriptions_and_lost_paths(spark):
    nodes = spark.createDataFrame(
        [("f", "file", "a.ts", "a.ts", None, None, None), ("s", "symbol", "run", "a.ts", None, 4, 6), ("r", "requirement", "REQ-1", "r.md", "x" * 300, None, None), ("t", "symbol", "other", "b.ts", None, 0, 1), ("z", "file", "z.ts", "z.ts", None, None, None)],
        "id string, kind string, label string, path string, body string, line_start int, line_end int",
    )
    edges = spark.createDataFrame([("s", "f", 3, 0), ("s", "r", 0, 0), ("t", "s", 7, 0), ("s", "t", 12, 12 << 4)], "from_id string, to_id string, edge_type int, meta int")
    notes = spark.createDataFrame([("s", "mind the gap")], "target string, note string")
    authors = spark.createDataFrame([("ann", 3), ("bob", 5), ("ann", 9)], "author string, at long")
    rows = {(r.section, r.place): (r.value, r.total) for r in graph.described(nodes, edges, "s", None, None, notes, authors).collect()}
    assert rows["location", 1][0] == "a.ts:5-7" and rows["depended on by", 1] == ("calls other", 1) and rows["requirements", 1][0] == "REQ-1"
    assert rows["similar", 1][0] == "other (0.80)" and rows["notes", 1][0] == "mind the gap" and [rows["authors", i][0] for i in (1, 2)] == ["ann", "bob"]
    told = {(r.section, r.place): r.value for r in graph.described(nodes, edges, "r").collect()}
    assert told["text", 1] == "x" * 240 and told["requirements", 1] == "satisfied by run"
    assert graph.lost_path(nodes, edges, "s", "z") == {"from": 2, "to": 0}


def test_lessons_in_markdown():
    rows = [{"label": "a", "node": "1", "lesson": "preferred", "useful": 2, "negative": 0, "leaning": None}, {"label": "b", "node": "2", "lesson": "contested", "useful": 1, "negative": 3, "leaning": "negative"}]
    text = memory.render(rows)
    assert "## Preferred\n\n- `a`: useful 2 times\n" in text and "the latest says avoid" in text and "Tentative" not in text
    assert "No lessons yet" in memory.render([])


def test_lint_finds_broken_relations(spark):
    rows = [("1", "t", "n", "fresh", "see:2"), ("2", "t", "m", "fresh", "see:9"), ("3", "u", "k", "fresh", None)]
    df = spark.createDataFrame(rows, "id string, target string, note string, state string, relation string")
    assert {tuple(r) for r in memory.annotation_lint(df).collect()} == {("2", "broken_relation")}


def test_markdown_answers(spark):
    items = spark.createDataFrame([("a", 0, 1, "typescript", "x" * 70), ("b", 1, 2, None, "y" * 70), ("c", 2, 3, None, "z" * 700)], "id string, tier int, place int, lang string, text string")
    text = search.markdown(search.answer(items, 60))
    assert text == f"### Target\n```typescript\n{'x' * 70}\n```\n\n### Seed\n```\n{'y' * 70}\n```\n\n"


def test_weighted_fields(spark):
    a = spark.createDataFrame([(1, 1, "x", 2.0), (1, 2, "y", 1.0)], "query_id int, rank int, id string, score double")
    b = spark.createDataFrame([(1, 1, "y", 1.0)], "query_id int, rank int, id string, score double")
    assert [(r.id, r.score) for r in search.weighted([(a, F.lit(1.0)), (b, F.lit(2.0))]).orderBy("rank").collect()] == [("y", 3.0), ("x", 2.0)]
    assert [r.id for r in search.weighted([(a, F.lit(1.0)), (b, F.lit(0.0))]).orderBy("rank").collect()] == ["x", "y"]
