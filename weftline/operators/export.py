"""Exports: JSON that reads back, pages, a wiki, reports and answers within a budget."""

from __future__ import annotations

import fnmatch
import html
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from . import communities, graph

SCHEMA_VERSION, MAX_PAGE_NODES = 1, 5000
NODE_DDL = "id string, kind string, label string, path string, name string, title string, body string, line_start int, line_end int, source_hash string, text string"
EDGE_DDL = "from_id string, to_id string, edge_type int, meta int"


def selected(nodes: DataFrame, glob: str | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Nodes whose path fits a glob (a node without one fits none) and whose kind is listed."""
    if glob:
        nodes = nodes.where(F.col("path").rlike(fnmatch.translate(glob)))
    return nodes.where(F.col("kind").isin(kinds)) if kinds else nodes


def to_json(nodes: DataFrame, edges: DataFrame, path: str, glob: str | None = None, kinds: list[str] | None = None) -> str:
    """One sorted, indented document, the same bytes for the same graph; edges stay if both ends do."""
    own = selected(nodes, glob, kinds)
    kept = graph.live(edges, own)
    plain = lambda r: {k: v for k, v in sorted(r.asDict().items()) if v is not None}
    relation = C.relation_name("edge_type").alias("relation")
    rows = kept.select("from_id", "to_id", relation, C.context_name(C.meta_context("meta")).alias("context"), "edge_type", "meta").orderBy("from_id", "to_id", "relation", "context")
    document = {"schema_version": SCHEMA_VERSION, "nodes": [plain(r) for r in own.orderBy("id").toLocalIterator()], "edges": [plain(r) for r in rows.toLocalIterator()]}
    text = json.dumps(document, indent=2, ensure_ascii=False) + "\n"
    with open(f"{path}.tmp", "w") as f:
        f.write(text)
    os.replace(f"{path}.tmp", path)
    return text


def from_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an export; a newer format is refused."""
    schema = f"schema_version int, nodes array<struct<{NODE_DDL.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<{EDGE_DDL.replace(' ', ':').replace(',:', ',')}>>"
    document = spark.read.schema(schema).json(path, multiLine=True)
    version = document.select("schema_version").first()[0]
    if version is None or version > SCHEMA_VERSION:
        raise ValueError(f"{path} has schema version {version}; this reads up to {SCHEMA_VERSION}")
    return document.select(F.inline("nodes")), document.select(F.inline("edges"))


def is_fresh(nodes: DataFrame, edges: DataFrame, path: str) -> bool:
    """Whether an export on disk is what it would be now."""
    try:
        with open(path) as f:
            before = f.read()
    except FileNotFoundError:
        return False
    return before == to_json(nodes, edges, f"{path}.check") and not os.remove(f"{path}.check")


def to_html(nodes: DataFrame, edges: DataFrame, path: str, limit: int = MAX_PAGE_NODES) -> None:
    """A page of the most connected nodes and what is between them, co-changes left out."""
    own = edges.where("edge_type <> 4")
    top = graph.degrees(nodes, own, tuple(t for t in range(13) if t != 4)).orderBy(F.desc("degree"), "id").limit(limit)
    rows = top.join(nodes.select("id", "label", "kind"), "id").orderBy("id").collect()
    place = {r["id"]: i for i, r in enumerate(rows)}
    links = graph.live(own, top).orderBy("from_id", "to_id", "edge_type").collect()
    data = {"nodes": [[r["label"], r["kind"], r["degree"]] for r in rows], "edges": [[place[e["from_id"]], place[e["to_id"]], e["edge_type"]] for e in links]}
    body = json.dumps(data, ensure_ascii=False).replace("</", "<\\/")
    with open(path, "w") as f:
        f.write(f"<!doctype html><meta charset=utf-8><title>Graph</title><h1>Graph</h1><p>{len(rows)} nodes, {len(links)} links</p><ul id=l></ul><script>const g={body};for(const [n,k,d] of g.nodes){{const e=document.createElement('li');e.textContent=`${{n}} (${{k}}, ${{d}})`;l.append(e)}}</script>\n")


def to_tree(nodes: DataFrame, path: str) -> None:
    """A page of folders and files."""
    tree: dict = {}
    for r in nodes.where("kind = 'file'").select("path").orderBy("path").toLocalIterator():
        at = tree
        for part in r["path"].split("/"):
            at = at.setdefault(part, {})
    draw = lambda t: "<ul>" + "".join(f"<li>{html.escape(k)}{draw(v) if v else ''}</li>" for k, v in t.items()) + "</ul>"
    with open(path, "w") as f:
        f.write(f"<!doctype html><meta charset=utf-8><title>Files</title>{draw(tree)}\n")


def slug(text: str) -> str:
    return re.sub(r"[\W_]+", "-", text.lower()).strip("-") or "community"


def to_wiki(links: DataFrame, member: DataFrame, folder: str) -> list[str]:
    """An index and an article for each community of files (file, community); the files' names."""
    os.makedirs(folder, exist_ok=True)
    groups: dict[int, list[str]] = {}
    for r in member.orderBy("community", "file").toLocalIterator():
        groups.setdefault(r["community"], []).append(r["file"])
    solid = {r["community"]: r for r in communities.cohesion(links, member).collect()}
    written, index = [], ["# Communities", ""]
    for c, files in sorted(groups.items(), key=lambda g: (-len(g[1]), g[1][0])):
        name, at = communities.label(files), solid.get(c)
        own = f"{slug(name)}-{c}.md"
        lines = [f"# {name}", "", f"{len(files)} files, cohesion {at['cohesion'] if at else 0.0:.2f}" + (", fragile" if at and at["fragile"] else ""), "", *[f"- `{f}`" for f in files]]
        with open(f"{folder}/{own}", "w") as f:
            f.write("\n".join(lines) + "\n")
        index.append(f"- [{name}]({own}): {len(files)} files")
        written.append(own)
    with open(f"{folder}/index.md", "w") as f:
        f.write("\n".join(index) + "\n")
    return ["index.md", *written]


def file_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, weight): the graph of files over imports and co-changes, for communities."""
    files = nodes.where("kind = 'file'").select("id", "path")
    a, b = files.toDF("from_id", "a"), files.toDF("to_id", "b")
    both = edges.where(F.col("edge_type").isin(4, 5, 6)).join(a, "from_id").join(b, "to_id")
    imports = both.where("edge_type <> 4").select(F.col("a").alias("from_path"), F.col("b").alias("to_path"))
    return communities.file_graph(imports, both.where("edge_type = 4").select("a", "b"))


def report(nodes: DataFrame, edges: DataFrame, top: int = 10) -> dict:
    """Counts, most connected nodes, communities, cycles and coverage, as plain values."""
    files = nodes.where("kind = 'file'").select("id", "path")
    a, b = files.toDF("from_id", "a"), files.toDF("to_id", "b")
    imports = edges.where(F.col("edge_type").isin(5, 6)).join(a, "from_id").join(b, "to_id")
    together = edges.where("edge_type = 4").join(a, "from_id").join(b, "to_id").select("a", "b")
    links = communities.file_graph(imports.select(F.col("a").alias("from_path"), F.col("b").alias("to_path")), together)
    member = communities.communities(links).persist()
    rows = lambda df: [r.asDict() for r in df.collect()]
    return {
        "summary": rows(graph.summary(nodes, edges).orderBy("section", "name")),
        "most_connected": rows(graph.god_nodes(nodes, edges, top).drop("id")),
        "communities": rows(communities.cohesion(links, member).orderBy(F.desc("files"), "community").limit(top)),
        "surprises": rows(communities.surprises(imports.select(F.col("a").alias("from_path"), F.col("b").alias("to_path")), member, top)),
        "cycles": rows(communities.cycles(imports.where("edge_type = 5").select("a", "b")).orderBy(F.desc("size"), "cycle").limit(top)),
        "coverage": rows(graph.coverage(nodes, edges).groupBy("state").count().orderBy("state")),
    }


def render(found: dict, budget: int | None = None) -> str:
    """A report in Markdown; with a budget, later sections are halved and then dropped until it fits."""
    sections = [(k, [", ".join(f"{a}: {b}" for a, b in row.items()) for row in rows]) for k, rows in found.items()]
    draw = lambda: "# Report\n" + "".join(f"\n## {k.replace('_', ' ').capitalize()}\n\n" + "".join(f"- {x}\n" for x in xs) for k, xs in sections)
    cost = lambda: -(-len(draw()) * 2 // 7)  # noqa: E731  characters by 3.5, rounded up
    for i in range(len(sections) - 1, -1, -1):
        while budget is not None and cost() > int(budget * 0.9) and len(sections[i][1]) > 1:
            sections[i] = (sections[i][0], sections[i][1][: len(sections[i][1]) // 2])
    while budget is not None and cost() > int(budget * 0.9) and len(sections) > 1:
        sections.pop()
    return draw()


def questions(found: dict, limit: int = 5) -> list[str]:
    """Questions that a report suggests, in a fixed order."""
    out = [f"What depends on {r['label']}?" for r in found["most_connected"][:1]]
    out += [f"How does {r['from_path']} reach {r['to_path']}?" for r in found["surprises"][:1]]
    out += [f"Which import would open the cycle of {r['cycle']}?" for r in found["cycles"][:1]]
    out += [f"What would satisfy the {r['count']} requirements that nothing does?" for r in found["coverage"] if r["state"] == "uncovered"]
    out += [f"Should community {r['community']} be one module?" for r in found["communities"] if r["fragile"]]
    return out[:limit]
