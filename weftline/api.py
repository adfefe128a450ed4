"""One engine over a store: sync a repository, then ask."""

from __future__ import annotations

import contextlib
import json
import tomllib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.columns import asks_for_dependents, identifier_tokens, language, seed_terms, summary_weight, without_stopwords
from .operators import cochange, communities, evaluation, export, graph, memory, search
from .operators.lineage import read_text, write_text
from .operators.store import Store
from .sources import git, graph_tables


class Ambiguous(LookupError):
    """A target that names several nodes, or none."""


class Engine:
    """A repository's graph in a versioned store. Methods return DataFrames; render_* give text."""

    def __init__(self, spark: SparkSession, path: str, repo: str | None = None) -> None:
        self.spark, self.repo, self.folder = spark, repo, path
        self.store = Store(spark, path)

    # --- keeping in step ---

    def _files(self, revision: str | None, working_tree: bool) -> DataFrame:
        files = git.files(self.spark, self.repo, revision or "HEAD").where("content IS NOT NULL")
        if working_tree and revision is None:
            files = git.with_working_tree(files, git.dirty(self.spark, self.repo))
        return files.select("path", "content")

    def _same(self, now: DataFrame) -> bool:
        before = self.store.read("files")
        return before is not None and now.exceptAll(before).isEmpty() and before.exceptAll(now).isEmpty()

    def is_current(self) -> bool:
        """Whether the store holds what HEAD and the working tree do; nothing is written."""
        return self._same(self._files(None, True).select("path", F.sha2("content", 256).alias("hash")))

    def sync(self, revision: str | None = None, working_tree: bool = True) -> int:
        """Bring the store to a revision, or to HEAD and the working tree; nothing changed, nothing is written."""
        files = self._files(revision, working_tree).persist()
        now = files.select("path", F.sha2("content", 256).alias("hash"))
        if self._same(now):
            return self.store.version()
        nodes, edges = graph_tables.build(files)
        log = git.commits(self.spark, self.repo, revision=revision or "HEAD").select(F.col("oid").alias("commit"), F.timestamp_seconds("ts").alias("at"), F.col("paths").alias("files"))
        taken = cochange.capped(cochange.recent(log))
        id_of = lambda c: F.sha2(F.concat_ws(":", F.lit("file"), c), 256)
        pairs = taken.select(id_of("a").alias("from_id"), id_of("b").alias("to_id"), F.lit(4).alias("edge_type"), F.lit(0).alias("meta"))
        edges = edges.unionByName(pairs)
        lexical = search.index(nodes.where("text IS NOT NULL"), "id", tokenizer=identifier_tokens)
        laid_out = edges.repartitionByRange("from_id").sortWithinPartitions("from_id", "edge_type")
        version = self.store.commit({"files": now, "nodes": nodes, "edges": laid_out, **lexical})
        files.unpersist()
        return version

    @property
    def nodes(self) -> DataFrame:
        return self.store.read("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.store.read("edges")

    # --- asking ---

    def resolve(self, target: str) -> str:
        found = graph.resolve(self.nodes, target).where("step < 90").limit(6).collect()
        if len(found) == 1:
            return found[0]["id"]
        if found:
            raise Ambiguous(f"{target!r} names several: " + ", ".join(sorted(r["label"] for r in found)))
        close = [r["label"] for r in graph.resolve(self.nodes, target).collect()]
        raise Ambiguous(f"nothing is named {target!r}" + (f"; close: {', '.join(close)}" if close else ""))

    def trace(self, target: str, depth: int = 3, cap: int = 25) -> DataFrame:
        return graph.trace(self.nodes, self.edges, self.resolve(target), depth, cap)

    def affected(self, target: str, depth: int = 2, cap: int = 25) -> DataFrame:
        return graph.affected(self.nodes, self.edges, self.resolve(target), depth, cap)

    def path(self, a: str, b: str, hops: int = 12) -> DataFrame:
        return graph.shortest_path(self.nodes, self.edges, self.resolve(a), self.resolve(b), hops)

    def explain(self, target: str) -> DataFrame:
        return graph.explain(self.nodes, self.edges, self.resolve(target))

    def describe(self, target: str) -> DataFrame:
        """(section, place, value, total): a node with its links, requirements, community, notes, similar nodes and authors."""
        node = self.nodes.where(F.col("id") == self.resolve(target)).first()
        links = export.file_links(self.nodes, self.edges)
        member = communities.communities(links).persist()
        authors = None
        if self.repo is not None and node["path"]:
            touched = git.commits(self.spark, self.repo).where(F.array_contains("paths", node["path"]))
            authors = touched.select("author", F.timestamp_seconds("ts").alias("at"))
        return graph.described(self.nodes, self.edges, node["id"], member, communities.cohesion(links, member), None, authors)

    def missing_path(self, a: str, b: str) -> dict[str, int]:
        """How many nodes each end reaches, where no path joins them."""
        return graph.lost_path(self.nodes, self.edges, self.resolve(a), self.resolve(b))

    def _asked(self, question: str) -> DataFrame:
        asked = self.spark.createDataFrame([(0, question)], "query_id int, text string")
        return asked.select("query_id", without_stopwords("text").alias("text"))

    def _ranked(self, question: str, k: int, lessons: DataFrame | None, summaries: DataFrame | None, vectors: tuple[DataFrame, DataFrame] | None) -> DataFrame:
        """(rank, id, score): stored postings, summaries (id, text) by the question's weight, vectors, fusion and lessons."""
        asked = self._asked(question)
        found = search.bm25_stored(self.store.read("postings"), self.store.read("sizes"), asked, k=k, tokenizer=identifier_tokens)
        if summaries is not None:
            weight = self.spark.createDataFrame([(question,)], "q string").select(summary_weight("q")).first()[0]
            told = search.bm25(summaries, asked, "id", k=k, tokenizer=identifier_tokens)
            found = search.weighted([(found, F.lit(1.0)), (told, F.lit(weight))], k)
        near = search.nearest(*vectors, k, "id") if vectors is not None else found.select("query_id", "rank", "id").limit(0)
        fused = search.fuse(found, near) if vectors is not None else found.select("query_id", "id", "score")
        if lessons is not None:
            fused = search.overlay(fused, lessons)
        top = fused.orderBy(F.desc(F.round("score", 9)), "id").limit(k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id"))).select("rank", "id", "score")  # at most k rows

    def search(self, question: str, k: int = 20, lessons: DataFrame | None = None, summaries: DataFrame | None = None, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """(label, kind, path, score, id): what was found, then one hop on, then dependents if the question asks for them."""
        found = self._ranked(question, k, lessons, summaries, vectors)
        asks = self.spark.createDataFrame([(question,)], "q string").select(asks_for_dependents("q")).first()[0]
        every = search.expanded(self.nodes, self.edges, found, asks)
        named = every.join(self.nodes.select("id", "label", "kind", "path"), "id")
        return named.orderBy("tier", "place", "id").select("label", "kind", "path", "score", "id", "tier", "place")

    def answer(self, question: str, max_tokens: int, k: int = 20, **options) -> str:
        """A Markdown answer within a budget: the target, the seeds, then what is around them, each in a fenced block."""
        hits = self.search(question, k, **options).select("id", "tier", "place")
        own = hits.join(self.nodes.select("id", "kind", "label", "path", "title", "body"), "id")
        text = F.coalesce(F.concat_ws("\n", F.concat_ws(": ", "label", "title"), F.expr("nullif(body, '')"), F.when(F.col("path") != F.col("label"), F.col("path"))), F.col("label"))
        placed = own.withColumn("text", text).withColumn("lang", F.when(F.col("kind") == "symbol", language("path")))
        order = F.row_number().over(Window.orderBy("tier", "place", "id"))  # what one search found
        return search.markdown(search.answer(placed.withColumn("place", order), max_tokens))

    def query(self, question: str, depth: int = 3, max_nodes: int = 60, depth_first: bool = False) -> DataFrame:
        """A walk from what the question names exactly, and from its best hits (one beside exact ones, else five)."""
        words = self.spark.createDataFrame([(question,)], "q string").select(F.split(seed_terms("q"), r"\s+").alias("w")).first()["w"]
        seeds = []
        for w in dict.fromkeys(words):
            with contextlib.suppress(Ambiguous):
                seeds.append(self.resolve(w))
        hits = [r["id"] for r in self._ranked(" ".join(words), 1 if seeds else 5, None, None, None).orderBy("rank").collect()]
        return graph.expand(self.nodes, self.edges, list(dict.fromkeys(seeds + hits))[:5], depth, max_nodes, depth_first=depth_first)

    def blame(self, target: str) -> DataFrame:
        node = self.nodes.where(F.col("id") == self.resolve(target)).first()
        return git.blame(self.spark, self.repo, [node["path"]], node["line_start"] or 0, node["line_end"])

    def changed_with(self, target: str, full_history: bool = False) -> DataFrame:
        """(path): files that change together with the target's file, in the last months or ever."""
        path = self.nodes.where(F.col("id") == self.resolve(target)).first()["path"]
        log = git.commits(self.spark, self.repo).select(F.col("oid").alias("commit"), F.timestamp_seconds("ts").alias("at"), F.col("paths").alias("files"))
        taken = cochange.capped(cochange.recent(log, None, None) if full_history else cochange.recent(log))
        return taken.where(F.col("a") == path).select(F.col("b").alias("path")).union(taken.where(F.col("b") == path).select("a")).distinct()

    def compact(self) -> list[str]:
        """Fold what tables hold beside their bases into them, and remove folders that no version uses."""
        self.store.compact()
        return self.store.vacuum()

    def diff(self) -> DataFrame:
        """(path, label, kind, side): symbols of files that differ from the index, and what directly depends on them."""
        now = self._files(None, True).select("path", F.sha2("content", 256).alias("hash"))
        paths = now.exceptAll(self.store.read("files")).select("path").distinct()
        own = self.nodes.where("kind IN ('file', 'symbol')").join(F.broadcast(paths), "path", "left_semi").select("id", "path", "label", "kind")
        links = graph.edge_filter(self.edges, graph.DEPENDENCIES)
        near = links.join(own.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct().join(own.select("id"), "id", "left_anti")
        there = self.nodes.join(near, "id", "left_semi").select("path", "label", "kind", F.lit("dependent").alias("side"))
        return own.select("path", "label", "kind", F.lit("changed").alias("side")).union(there)

    def report(self, top: int = 10) -> dict:
        return export.report(self.nodes, self.edges, top)

    def render_report(self, budget: int | None = None) -> str:
        return export.render(self.report(), budget)

    # --- lessons ---

    def save_result(self, question: str, outcome: str, nodes: list[str], at: int) -> None:
        """Note how an answer turned out; outcome: useful, dead_end or corrected."""
        if outcome not in (*memory.USEFUL, *memory.NEGATIVE) or not question.strip():
            raise ValueError("an outcome is one of useful, dead_end, corrected, for a question")
        rows = "".join(json.dumps({"node": self.resolve(n), "at": at, "outcome": outcome, "question": question}) + "\n" for n in nodes)
        with self.store.lock():
            write_text(self.spark, f"{self.folder}/signals.jsonl", (read_text(self.spark, f"{self.folder}/signals.jsonl") or "") + rows)

    def reflect(self, now: int, half_life: float = memory.HALF_LIFE_DAYS) -> DataFrame:
        at = f"{self.folder}/signals.jsonl"
        schema = "node string, at long, outcome string, question string"
        rows = self.spark.read.schema(schema).json(at) if read_text(self.spark, at) else self.spark.createDataFrame([], schema)
        return memory.reflect(rows.select("node", F.timestamp_seconds("at").alias("at"), "outcome"), F.timestamp_seconds(F.lit(now)), half_life)

    def write_lessons(self, now: int, half_life: float = memory.HALF_LIFE_DAYS) -> str:
        """LESSONS.md for readers, and memory.json with what a search boosts and lowers; the text."""
        found = self.reflect(now, half_life).join(self.nodes.select(F.col("id").alias("node"), "label"), "node", "left").persist()
        text = memory.render([r.asDict() for r in found.where("lesson IS NOT NULL").orderBy("label", "node").collect()])
        write_text(self.spark, f"{self.folder}/LESSONS.md", text)
        nudged = memory.lessons(found).where("good OR bad").orderBy("id").collect()
        write_text(self.spark, f"{self.folder}/memory.json", json.dumps({r["id"]: "bad" if r["bad"] else "good" for r in nudged}, indent=1, sort_keys=True) + "\n")
        return text

    def saved_lessons(self) -> DataFrame:
        """(id, good, bad) of memory.json, for a search."""
        found = json.loads(read_text(self.spark, f"{self.folder}/memory.json") or "{}")
        return self.spark.createDataFrame([(k, v == "good", v == "bad") for k, v in found.items()], "id string, good boolean, bad boolean")

    # --- measuring ---

    def bench(self, corpus: str, k: int = 10) -> DataFrame:
        """(query_id, kind, recall_at_5, recall_at_10, reciprocal_rank) for the queries of a TOML file.

        A hit counts by where it lies: its path, its symbol or its marker, or what satisfies the marker.
        """
        queries = read_corpus(corpus)
        hits = None
        for q in queries:
            own = self._ranked(q["query"], k, None, None, None).select(F.lit(q["id"]).alias("query_id"), "rank", "id")
            hits = own if hits is None else hits.union(own)
        places = evaluation.hit_locations(self.nodes, self.edges, hits)
        named = places.select("query_id", "rank", F.explode(F.array_compact(F.array("path", "symbol", "marker"))).alias("name"))
        expected = self.spark.createDataFrame([(q["id"], e) for q in queries for e in q["expect"]], "query_id string, id string")
        fits = (F.col("name") == F.col("id")) | F.endswith("name", F.concat(F.lit("/"), F.col("id")))
        ranked = named.join(F.broadcast(expected), "query_id").where(fits).groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
        kinds = self.spark.createDataFrame([(q["id"], q.get("kind", "locate")) for q in queries], "query_id string, kind string")
        return evaluation.recall_mrr(ranked, expected).join(F.broadcast(kinds), "query_id")

    def bench_kinds(self, corpus: str, k: int = 10) -> DataFrame:
        """(kind, queries, recall_at_5, recall_at_10, mrr): means by kind of question."""
        return self.bench(corpus, k).groupBy("kind").agg(F.count(F.lit(1)).alias("queries"), *[F.avg(f"recall_at_{n}").alias(f"recall_at_{n}") for n in (5, 10)], F.avg("reciprocal_rank").alias("mrr"))

    def save_baseline(self, corpus: str, path: str, k: int = 10) -> None:
        rows = self.bench_kinds(corpus, k).orderBy("kind").collect()
        write_text(self.spark, path, json.dumps({"kinds": {r["kind"]: {c: r[c] for c in r.asDict() if c != "kind"} for r in rows}}, indent=1, sort_keys=True) + "\n")

    def check_baseline(self, corpus: str, path: str, k: int = 10) -> DataFrame:
        """(kind, problem) against a saved baseline; no rows: the gate is passed."""
        kinds = json.loads(read_text(self.spark, path) or '{"kinds": {}}')["kinds"]
        saved = self.spark.createDataFrame([(n, int(x["queries"]), float(x["recall_at_5"])) for n, x in kinds.items()], "kind string, queries long, recall_at_5 double")
        return evaluation.gate(self.bench_kinds(corpus, k), saved)


def read_corpus(path: str) -> list[dict]:
    """The queries of a benchmark's TOML file, each with a grep term (its first word, unless it names one)."""
    with open(path, "rb") as f:
        queries = tomllib.load(f).get("query", [])
    ids = [q.get("id") for q in queries]
    if not queries or len(set(ids)) != len(ids) or not all(q.get("query") and q.get("expect") for q in queries):
        raise ValueError(f"{path}: queries need unique ids, a query and what to expect")
    return [{**q, "grep": q.get("grep") or q["query"].split()[0]} for q in queries]
