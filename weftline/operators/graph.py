"""Graph operators over nodes (id, kind, label, path, ...) and edges (from_id, to_id, edge_type, meta).

Edges may dangle: every read joins their ends with the nodes. Walks with a cap on each level hold their frontier
on the driver, which the cap bounds, and scan the edges with a pushed-down list of its ids; walks without one
keep it in tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import words as W
from .lineage import cut
from .sizes import small

DEPENDENCIES = (1, 5, 6, 7, 8, 9, 10)
SATISFIES, IMPLEMENTS, DEFINED_IN, IMPORTS, RE_EXPORTS = 0, 2, 3, 5, 6
DEFAULT_TYPES = (*DEPENDENCIES, SATISFIES, IMPLEMENTS)
#: Relations that pass a repository on: definitions, notes and calls.
TAGGING = (DEFINED_IN, 11, 7)
#: Forward relations of a trace, in the order in which they are tried.
TRACE_TYPES = (SATISFIES, DEFINED_IN, IMPLEMENTS, *DEPENDENCIES)


def _as_is(id_: Column) -> Column:
    return id_


def _kind_of_id(nodes: DataFrame) -> str:
    return nodes.schema["id"].dataType.simpleString()


def relation_codes(names: Sequence[str]) -> list[int]:
    """Codes of relation names; hyphens and case are free, and 'dependencies' is a group."""
    out: list[int] = []
    for name in names:
        plain = name.strip().lower().replace("-", "_")
        if plain == "dependencies":
            out += DEPENDENCIES
        elif plain in W.RELATIONS:
            out.append(W.RELATIONS.index(plain))
        elif plain.replace("_", "") in [r.replace("_", "") for r in W.RELATIONS]:
            out.append([r.replace("_", "") for r in W.RELATIONS].index(plain.replace("_", "")))
        else:
            raise ValueError(f"unknown relation {name!r}; one of: {', '.join(W.RELATIONS)}")
    return list(dict.fromkeys(out))


def context_codes(names: Sequence[str]) -> list[int]:
    allowed = W.CONTEXTS[:4]
    out = []
    for name in names:
        plain = name.strip().lower().replace("-", "_")
        if plain not in allowed:
            raise ValueError(f"unknown context {name!r}; one of: {', '.join(allowed)}")
        out.append(W.CONTEXTS.index(plain))
    return out


def edge_filter(edges: DataFrame, types: Sequence[int] = DEFAULT_TYPES, extracted_only: bool = False, contexts: Sequence[int] = ()) -> DataFrame:
    """Edges of the types (none: all), certain enough, in the contexts (none: all)."""
    keep = F.lit(True)
    if types:
        keep = keep & F.col("edge_type").isin(list(types))
    if extracted_only:
        keep = keep & (C.meta_inferred("meta") == 0)
    if contexts:
        keep = keep & C.meta_context("meta").isin(list(contexts))
    return edges.where(keep)


def live(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist, dealt by where they start."""
    ids = nodes.select(F.col("id"))
    return edges.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi")


# --- counts -------------------------------------------------------------------------------------------------------


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, name, n): nodes by kind, edges by relation, files by extension."""
    kinds = nodes.groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("section"), "name", "n")
    relations = edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("section"), C.relation_name("edge_type").alias("name"), "n")
    bucket = F.coalesce(C.language("path"), F.lit("other"))
    files = nodes.where("kind = 'file'").groupBy(bucket.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("files").alias("section"), "name", "n")
    return kinds.unionByName(relations).unionByName(files)


def degrees(nodes: DataFrame, edges: DataFrame, types: Sequence[int] = DEPENDENCIES) -> DataFrame:
    """(id, in_degree, out_degree, degree) over live edges of the types: one pass over them, both ends combined before they are shuffled."""
    own = live(edge_filter(edges, types).select("from_id", "to_id"), nodes)
    half = own.select(F.posexplode(F.array("from_id", "to_id")).alias("end", "id"))
    return half.groupBy("id").agg(F.sum("end").alias("in_degree"), F.sum(1 - F.col("end")).alias("out_degree"), F.count(F.lit(1)).alias("degree"))


def barrels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, reexports, outgoing): files of two re-exports or more that make up half of what leaves them."""
    files = nodes.where("kind = 'file'").select(F.col("id").alias("from_id"))
    several = edges.where(F.col("edge_type") == RE_EXPORTS).groupBy("from_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("from_id")
    own = edge_filter(edges, DEPENDENCIES).join(small(several.join(files, "from_id", "left_semi")), "from_id", "left_semi")  # the other edges aren't shuffled
    out = own.groupBy(F.col("from_id").alias("id")).agg(F.count_if(F.col("edge_type") == RE_EXPORTS).alias("reexports"), F.count(F.lit(1)).alias("outgoing"))
    return out.where("reexports >= 2 AND 2 * reexports >= outgoing")


def god_nodes(nodes: DataFrame, edges: DataFrame, top: int = 10, kinds: Sequence[str] = ("file", "symbol"), name: Callable[[Column], Column] = _as_is) -> DataFrame:
    """(id, label, kind, degree): the most connected nodes that aren't barrels; ties by label."""
    named = nodes.where(F.col("kind").isin(list(kinds))).select("id", "label", "kind")
    own = degrees(nodes, edges).join(named, "id").join(barrels(nodes, edges).select("id"), "id", "left_anti")
    return own.orderBy(F.desc("degree"), "label", name(F.col("id"))).limit(top).select("id", "label", "kind", "degree")


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label, state): requirements that nothing satisfies, tasks without one, and links to what isn't there."""
    links = edges.where(F.col("edge_type") == SATISFIES)
    ids = nodes.select("id")
    requirements, tasks = nodes.where("kind = 'requirement'"), nodes.where("kind = 'task'")
    sources = links.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    bare = requirements.join(sources.select(F.col("to_id").alias("id")), "id", "left_anti").select("id", "label", F.lit("uncovered").alias("state"))
    loose = tasks.join(links.select(F.col("from_id").alias("id")), "id", "left_anti").select("id", "label", F.lit("without_requirement").alias("state"))
    lost = links.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select(F.col("from_id").alias("id")).distinct()
    lost = lost.join(nodes.select("id", "label"), "id", "left").select("id", "label", F.lit("orphan_reference").alias("state"))
    return bare.unionByName(loose).unionByName(lost)


def with_requirement(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind): symbols that satisfy an existing requirement, and the files that they are defined in."""
    requirements = nodes.where("kind = 'requirement'").select(F.col("id").alias("to_id"))
    own = edges.where(F.col("edge_type") == SATISFIES).join(requirements, "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct()
    symbols = nodes.where("kind = 'symbol'").select("id", "kind").join(own, "id", "left_semi")
    home = edges.where(F.col("edge_type") == DEFINED_IN).join(symbols.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()
    return symbols.union(nodes.where("kind = 'file'").select("id", "kind").join(home, "id", "left_semi"))


def repositories(nodes: DataFrame, edges: DataFrame, tag: Column, rounds: int = 2) -> DataFrame:
    """(id, repo) of a global graph: what nodes tell of themselves (tag), passed on twice over edges.

    A node without a repository takes that of what it is defined in, of what it annotates, or, if it is an external
    endpoint, of its callers; of several the least. Two rounds reach from a file to its symbols and their notes.
    """
    map_ = nodes.select("id", tag.alias("repo")).where("repo IS NOT NULL")
    outside = nodes.where("kind = 'endpoint' AND path IS NULL").select("id")
    down = edges.where(F.col("edge_type") == DEFINED_IN).select(F.col("from_id").alias("id"), F.col("to_id").alias("by"))
    notes = edges.where("edge_type = 11").select(F.col("to_id").alias("id"), F.col("from_id").alias("by"))
    called = edges.where("edge_type = 7").select(F.col("to_id").alias("id"), F.col("from_id").alias("by")).join(outside, "id", "left_semi")
    ways = down.union(notes).union(called)
    for _ in range(rounds):
        passed = ways.join(map_.withColumnRenamed("id", "by"), "by").groupBy("id").agg(F.min("repo").alias("repo"))
        map_ = cut(map_.union(passed.join(map_.select("id"), "id", "left_anti").select("id", "repo")))
    return map_


def restricted(nodes: DataFrame, edges: DataFrame, repos: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """The nodes of one repository and the edges among them."""
    own = nodes.join(repos.where(F.col("repo") == repo).select("id"), "id", "left_semi")
    return own, live(edges, own)


# --- walks --------------------------------------------------------------------------------------------------------


def _frontier(edges: DataFrame, ids: list[str], column: str) -> DataFrame:
    spark = edges.sparkSession
    return F.broadcast(spark.createDataFrame([(x, i) for i, x in enumerate(ids)], f"{column} string, pos int"))


def affected(nodes: DataFrame, edges: DataFrame, root: str | int, depth: int = 2, cap: int = 25, types: Sequence[int] = DEFAULT_TYPES, name: Callable[[Column], Column] = _as_is) -> DataFrame:
    """(id, label, kind, depth, relation, inferred, context, omitted): what depends on root, over incoming edges.

    A node's first sighting, from the earliest frontier node, gives its relation. Each level keeps the cap
    best by (inferred, context by two bits, label, id); the others aren't visited and may come up again one
    level down. omitted: how many a level dropped. Ids may be of any type; name makes what ties are put in order by.
    """
    spark = edges.sparkSession
    own = edge_filter(edges, types)
    visited, frontier, rows = [root], [root], []
    for d in range(1, depth + 1):
        if not frontier:
            break
        seen = own.where(F.col("to_id").isin(frontier) & ~F.col("from_id").isin(visited)).join(_frontier(edges, frontier, "to_id"), "to_id")
        first = seen.groupBy(F.col("from_id").alias("id")).agg(F.min(F.struct("pos", "edge_type", "meta")).alias("via")).select("id", "via.edge_type", "via.meta")
        named = first.join(nodes.select("id", "label", "kind"), "id")
        order = [C.meta_inferred("meta"), C.meta_context("meta", 0b11), F.col("label"), name(F.col("id"))]
        seen_all = Observation()  # the level's size, from the job that takes its best
        best = named.observe(seen_all, F.count(F.lit(1)).alias("n")).orderBy(*order).limit(cap).collect()  # at most cap rows
        dropped = max(0, seen_all.get["n"] - cap)
        frontier = [r["id"] for r in best]
        visited += frontier
        rows += [(r["id"], r["label"], r["kind"], d, W.RELATIONS[r["edge_type"]], bool(r["meta"] & 1), W.CONTEXTS[r["meta"] >> 1 & 7], dropped) for r in best]
    return spark.createDataFrame(rows, f"id {_kind_of_id(nodes)}, label string, kind string, depth int, relation string, inferred boolean, context string, omitted long")


def trace(nodes: DataFrame, edges: DataFrame, root: str | int, depth: int = 3, cap: int = 25, name: Callable[[Column], Column] = _as_is) -> DataFrame:
    """(id, label, kind, depth, relation, incoming, meta): semantic and dependency edges both ways.

    DefinedIn is followed forward only. Of a node's edges to the earliest frontier node, forward ones come first,
    in the order of TRACE_TYPES. A level keeps the cap best by (is DefinedIn, inferred, context by two bits, id).
    Nodes that don't exist are walked through but not listed.
    """
    spark = edges.sparkSession
    rank = F.array_position(F.array(*[F.lit(t) for t in TRACE_TYPES]), F.col("edge_type"))
    own = edges.where(F.col("edge_type").isin(list(TRACE_TYPES)))
    visited, frontier, rows = [root], [root], []
    for d in range(1, depth + 1):
        if not frontier:
            break
        out = own.where(F.col("from_id").isin(frontier) & ~F.col("to_id").isin(visited)).join(_frontier(edges, frontier, "from_id"), "from_id")
        out = out.select(F.col("to_id").alias("id"), F.struct("pos", F.lit(0).alias("back"), rank.alias("rank"), "edge_type", "meta").alias("via"))
        back = own.where((F.col("edge_type") != DEFINED_IN) & F.col("to_id").isin(frontier) & ~F.col("from_id").isin(visited)).join(_frontier(edges, frontier, "to_id"), "to_id")
        back = back.select(F.col("from_id").alias("id"), F.struct("pos", F.lit(1).alias("back"), F.col("edge_type").cast("long").alias("rank"), "edge_type", "meta").alias("via"))
        first = out.union(back).groupBy("id").agg(F.min("via").alias("via")).select("id", "via.*")
        order = [F.col("edge_type") == DEFINED_IN, C.meta_inferred("meta"), C.meta_context("meta", 0b11), name(F.col("id"))]
        best = first.orderBy(*order).limit(cap).join(nodes.select("id", "label", "kind"), "id", "left").orderBy(*order).collect()
        frontier = [r["id"] for r in best]
        visited += frontier
        rows += [(r["id"], r["label"], r["kind"], d, W.RELATIONS[r["edge_type"]], bool(r["back"]), r["meta"]) for r in best if r["kind"] is not None]
    return spark.createDataFrame(rows, f"id {_kind_of_id(nodes)}, label string, kind string, depth int, relation string, incoming boolean, meta int")


def neighbours(nodes: DataFrame, edges: DataFrame, ids: list, visited: list, name: Callable[[Column], Column] = _as_is) -> DataFrame:
    """(id, pos, inferred, ctx, back, edge_type, meta): undirected live steps from ids to nodes not visited."""
    out = edges.where(F.col("from_id").isin(ids) & ~F.col("to_id").isin(visited)).join(_frontier(edges, ids, "from_id"), "from_id").select(F.col("to_id").alias("id"), "pos", F.lit(0).alias("back"), "edge_type", "meta", F.col("from_id").alias("parent"))
    back = edges.where(F.col("to_id").isin(ids) & ~F.col("from_id").isin(visited)).join(_frontier(edges, ids, "to_id"), "to_id").select(F.col("from_id").alias("id"), "pos", F.lit(1).alias("back"), "edge_type", "meta", F.col("to_id").alias("parent"))
    steps = out.union(back).join(nodes.select("id"), "id", "left_semi")
    return steps.select("id", "parent", F.struct("pos", C.meta_inferred("meta").alias("inferred"), C.meta_context("meta", 0b11).alias("ctx"), name(F.col("id")).alias("id"), "back", "edge_type", "meta").alias("via"))


def expand(nodes: DataFrame, edges: DataFrame, seeds: list, depth: int = 3, max_nodes: int = 60, types: Sequence[int] = DEFAULT_TYPES, depth_first: bool = False, name: Callable[[Column], Column] = _as_is) -> DataFrame:
    """(seq, id, depth, parent, relation, forward, meta): an undirected walk of at most max_nodes nodes.

    Breadth first: a level's nodes in the order of (frontier place, inferred, context, id). Depth first: a node's
    neighbours are marked when they are stacked, worst first, and the best is walked on from.
    """
    spark = edges.sparkSession
    own = edge_filter(edges, types)
    visited, rows = list(dict.fromkeys(seeds)), []

    def add(steps: list, d: int) -> list[str]:
        new = []
        for r in steps:
            if len(rows) >= max_nodes:
                break
            v = r["via"]
            rows.append((len(rows), r["id"], d, r["parent"], W.RELATIONS[v["edge_type"]], not v["back"], v["meta"]))
            new.append(r["id"])
        visited.extend(new)
        return new

    def steps(ids: list[str]) -> DataFrame:
        return neighbours(nodes, own, ids, visited, name).groupBy("id").agg(F.min("via").alias("via"), F.min_by("parent", "via").alias("parent"))

    if depth_first:
        stack = [(s, 0) for s in seeds]
        while stack and len(rows) < max_nodes:
            node, d = stack.pop()
            if d < depth:
                found = steps([node]).orderBy(F.desc("via")).collect()  # one node's neighbours, worst first
                stack += [(x, d + 1) for x in add(found, d + 1)]
    else:
        frontier = list(seeds)
        for d in range(1, depth + 1):
            if not frontier or len(rows) >= max_nodes:
                break
            frontier = add(steps(frontier).orderBy("via").limit(max_nodes - len(rows)).collect(), d)
    return spark.createDataFrame(rows, f"seq int, id {_kind_of_id(nodes)}, depth int, parent {_kind_of_id(nodes)}, relation string, forward boolean, meta int")


def khop(edges: DataFrame, seeds: DataFrame, depth: int, types: Sequence[int]) -> DataFrame:
    """(id, depth): nodes within depth forward hops of the seeds (id), each at its least depth.

    Frontiers are tables in the shared folder: each level is one equi-join with the edges and one anti-join with
    what is visited, and no level is made twice.
    """
    own = edge_filter(edges, types).select("from_id", "to_id")
    seen = frontier = cut(seeds.select("id", F.lit(0).alias("depth")))
    for d in range(1, depth + 1):
        step = frontier.join(own, frontier["id"] == own["from_id"]).select(F.col("to_id").alias("id")).distinct()
        frontier = cut(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth")))
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(nodes: DataFrame, edges: DataFrame, a: str, b: str, max_hops: int = 12, types: Sequence[int] = DEFAULT_TYPES) -> DataFrame:
    """(hop, id): a shortest undirected path from a to b, or no rows. Of several, each node's least predecessor.

    Levels are tables; the walk ends when b is reached.
    """
    spark = edges.sparkSession
    own = live(edge_filter(edges, types), nodes).select("from_id", "to_id")
    both = cut(own.union(own.select("to_id", "from_id")).distinct())
    levels = [spark.createDataFrame([(a, None)], "id string, parent string")]
    seen = levels[0].select("id")
    while a != b and len(levels) <= max_hops:
        step = levels[-1].join(both, levels[-1]["id"] == both["from_id"]).groupBy(F.col("to_id").alias("id")).agg(F.min("from_id").alias("parent"))
        new = cut(step.join(seen, "id", "left_anti"))
        levels.append(new)
        if new.where(F.col("id") == b).count() or new.isEmpty():
            break
        seen = seen.union(new.select("id"))
    path, at = [], b
    for d in range(len(levels) - 1, -1, -1):
        row = levels[d].where(F.col("id") == at).first()
        if row is None:
            path = []
            break
        path.append((d, at))
        at = row["parent"]
    return spark.createDataFrame(path, "hop int, id string")


def reachable(nodes: DataFrame, edges: DataFrame, start: str, cap: int = 100_000, types: Sequence[int] = DEFAULT_TYPES) -> int:
    """How many other nodes an undirected walk from start reaches; the walk ends after the level that passes cap."""
    spark = edges.sparkSession
    own = live(edge_filter(edges, types), nodes).select("from_id", "to_id")
    both = cut(own.union(own.select("to_id", "from_id")).distinct())
    frontier = spark.createDataFrame([(start,)], "id string")
    seen, n = frontier, 1
    while n <= cap:
        step = both.join(frontier.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()
        frontier = cut(step.join(seen, "id", "left_anti"))
        new = frontier.count()
        if not new:
            break
        seen, n = seen.union(frontier), n + new
    return n - 1


def lost_path(nodes: DataFrame, edges: DataFrame, a: str, b: str, types: Sequence[int] = DEFAULT_TYPES) -> dict[str, int]:
    """What to say where no path joins a and b: how many nodes each reaches."""
    return {"from": reachable(nodes, edges, a, types=types), "to": reachable(nodes, edges, b, types=types)}


# --- look-ups -----------------------------------------------------------------------------------------------------


def explain(nodes: DataFrame, edges: DataFrame, root: str | int, top: int = 10, name: Callable[[Column], Column] = _as_is) -> DataFrame:
    """(side, place, id, label, relation, total): dependencies and dependents, best first, with their whole counts."""
    own = edge_filter(edges, DEPENDENCIES)
    out = own.where(F.col("from_id") == root).select(F.lit("dependencies").alias("side"), F.col("to_id").alias("id"), "edge_type", "meta")
    back = own.where(F.col("to_id") == root).select(F.lit("dependents").alias("side"), F.col("from_id").alias("id"), "edge_type", "meta")
    named = out.union(back).join(nodes.select("id", "label"), "id")
    order = Window.partitionBy("side").orderBy(C.meta_inferred("meta"), C.meta_context("meta"), "label", name(F.col("id")), "edge_type")
    named = named.withColumn("place", F.row_number().over(order)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("side")))
    return named.where(F.col("place") <= top).select("side", "place", "id", "label", C.relation_name("edge_type").alias("relation"), "total")


def described(nodes: DataFrame, edges: DataFrame, root: str, member: DataFrame | None = None, solid: DataFrame | None = None, annotations: DataFrame | None = None, authors: DataFrame | None = None, top: int = 10) -> DataFrame:
    """(section, place, value, total): a node's whole explanation, a row for each thing to say.

    location (lines from 1), text (240 characters), depends on and depended on by (the best, with whole counts),
    requirements (or what satisfies one), community with its cohesion, notes, similar nodes (5, by score) and
    recent authors (3), as far as the tables for them are given.
    """
    node = nodes.where(F.col("id") == root)
    row = lambda df, section, place, value, total=F.lit(None): df.select(F.lit(section).alias("section"), place.cast("int").alias("place"), value.cast("string").alias("value"), total.cast("long").alias("total"))
    one = F.lit(1)
    lines = F.concat_ws("-", (F.col("line_start") + 1).cast("string"), (F.col("line_end") + 1).cast("string"))
    place = F.concat_ws(":", "path", F.when((F.col("kind") == "symbol") & F.col("line_start").isNotNull(), lines))
    out = row(node, "label", one, F.col("label")).union(row(node, "kind", one, F.col("kind"))).union(row(node.where("path IS NOT NULL"), "location", one, place))
    prose = node.where("kind IN ('requirement', 'task', 'adr') AND body <> ''")
    out = out.union(row(prose, "text", one, F.substring("body", 1, 240)))
    near = explain(nodes, edges, root, top)
    for side, section in (("dependencies", "depends on"), ("dependents", "depended on by")):
        out = out.union(row(near.where(F.col("side") == side), section, F.col("place"), F.concat_ws(" ", "relation", "label"), F.col("total")))
    labels = nodes.select("id", "label", "kind")
    by = edges.where((F.col("edge_type") == SATISFIES) & (F.col("to_id") == root)).select(F.col("from_id").alias("id")).join(labels, "id")
    by = by.join(F.broadcast(node.where("kind = 'requirement'").select(F.lit(1).alias("is"))), how="inner").select(F.concat(F.lit("satisfied by "), F.col("label")).alias("label"))  # one row or none
    own = edges.where((F.col("edge_type") == SATISFIES) & (F.col("from_id") == root)).select(F.col("to_id").alias("id")).join(labels.where("kind IN ('requirement', 'adr')"), "id").select("label")
    both = by.union(own).distinct().withColumn("n", F.row_number().over(Window.orderBy("label")))  # one node's links
    out = out.union(row(both, "requirements", F.col("n"), F.col("label")))
    if member is not None:
        home = member.join(F.broadcast(node.select(F.col("path").alias("file"))), "file")
        home = home.join(solid.select("community", "cohesion"), "community", "left") if solid is not None else home.withColumn("cohesion", F.lit(None).cast("double"))
        out = out.union(row(home, "community", one, F.format_string("community %d, cohesion %.2f", F.col("community"), F.coalesce("cohesion", F.lit(0.0)))))
    if annotations is not None:
        notes = annotations.where(F.col("target") == root).withColumn("n", F.row_number().over(Window.orderBy("note")))  # one node's notes
        out = out.union(row(notes, "notes", F.col("n"), F.col("note")))
    like = edges.where((F.col("edge_type") == 12) & (F.col("from_id") == root)).join(labels, F.col("to_id") == labels["id"]).select("label", F.coalesce(C.meta_similarity("meta"), F.lit(0.0)).alias("score"))
    like = like.withColumn("n", F.row_number().over(Window.orderBy(F.desc("score"), "label"))).where("n <= 5")
    out = out.union(row(like, "similar", F.col("n"), F.format_string("%s (%.2f)", F.col("label"), F.col("score"))))
    if authors is not None:  # (author, at) of the commits that touched the node
        last = authors.groupBy("author").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "author").limit(3)
        out = out.union(row(last.withColumn("n", F.row_number().over(Window.orderBy(F.desc("at"), "author"))), "authors", F.col("n"), F.col("author")))
    return out


def resolve(nodes: DataFrame, target: str, top: int = 5) -> DataFrame:
    """(step, id, label, kind): what a text names; the first step with a match decides, several are ambiguous.

    Steps: 1 id, 2 marker, 3 path:Symbol, 4 path or its tail, 5 symbol (as written, then any case), 6 other names
    (as written, then any case), 9 suggestions that contain the text, shortest first.
    """
    t, low = F.lit(target), F.lower(F.lit(target))
    label, path = F.col("label"), F.col("path")
    code = F.col("kind").isin("symbol")
    named = F.col("kind").isin("table", "column", "constraint", "package", "endpoint", "view")
    step = (
        F.when(F.col("id") == t, 10)
        .when(F.col("kind").isin("requirement", "task", "adr") & (label == t), 20)
        .when(code & (F.concat_ws(":", path, label) == t), 30)
        .when((F.col("kind") == "file") & ((path == t) | path.endswith("/" + target)), 40)
        .when(code & (label == t), 50)
        .when(code & (F.lower(label) == low), 51)
        .when(named & (label == t), 60)
        .when(named & (F.lower(label) == low), 61)
        .when(F.lower(label).contains(low), 90)
    )
    found = nodes.withColumn("step", step).where("step IS NOT NULL")
    best = found.agg(F.min("step").alias("best"))
    chosen = found.join(F.broadcast(best), found["step"] == best["best"])
    exact = chosen.where("step < 90").select("step", "id", "label", "kind")
    close = chosen.where("step = 90").orderBy(F.length("label"), "label", "id").limit(top).select("step", "id", "label", "kind")
    return exact.union(close)


# --- versions -----------------------------------------------------------------------------------------------------


def delta_view(base: DataFrame, upserts: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    """Base rows that the delta neither removes nor replaces, and the delta's upserts that it doesn't remove."""
    gone = removed.select(key).union(upserts.select(key)).distinct()
    return base.join(gone, key, "left_anti").select(*base.columns).unionByName(upserts.join(removed.select(key), key, "left_anti").select(*base.columns))


def reconcile(desired: DataFrame, existing: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, op): what turns existing rows into the desired ones: upsert new or changed, remove the rest."""
    d = desired.select(key, F.struct(*fields).alias("d"))
    e = existing.select(key, F.struct(*fields).alias("e"))
    both = d.join(e, key, "full")
    op = F.when(F.col("d").isNull(), "remove").when(F.col("e").isNull() | ~F.col("d").eqNullSafe(F.col("e")), "upsert")
    return both.select(key, op.alias("op")).where("op IS NOT NULL")


def union_prefer(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """All rows by key; ours win."""
    return ours.unionByName(theirs.join(ours.select(key), key, "left_anti").select(*ours.columns))


def should_compact(delta_rows: int, base_rows: int, ratio: float = 0.05) -> bool:
    return delta_rows > 0 and (base_rows == 0 or delta_rows / base_rows >= ratio)
