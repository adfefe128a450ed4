"""From scanned files to one property graph: nodes, edges and the texts to search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.lineage import cut
from ..operators.sizes import small
from . import extract as E

NODE = ["id", "kind", "label", "path", "name", "title", "body", "line_start", "line_end", "source_hash", "text"]
_TWINS = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def _nodes(df: DataFrame, **columns) -> DataFrame:
    none = F.lit(None)
    kinds = {"line_start": "int", "line_end": "int"}
    return df.select(*[columns.get(c, none).cast(kinds.get(c, "string")).alias(c) for c in NODE])


def _edges(df: DataFrame, a, b, code: int, meta=0) -> DataFrame:
    return df.select(a.alias("from_id"), b.alias("to_id"), F.lit(code).cast("int").alias("edge_type"), (F.lit(meta) if isinstance(meta, int) else meta).cast("int").alias("meta"))


def _file(path="path"):
    return C.stable_id("file", path)


def markdown_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = E.over(files.where("path LIKE '%.md'"), E.markdown, E.MARKDOWN).withColumn("id", C.stable_id("marker", "marker"))
    nodes = _nodes(own, id=F.col("id"), kind=F.col("kind"), label=F.col("marker"), path=F.col("path"), name=F.col("marker"), title=F.col("title"), body=F.col("body"), text=F.concat_ws(" ", "title", "body"))
    links = own.select("id", F.explode("satisfies").alias("req"))
    return nodes.dropDuplicates(["id"]), _edges(links, F.col("id"), C.stable_id("marker", "req"), 0)


def code_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols, their files, same-file calls, requirement comments, and links between files over imports."""
    code = files.where(C.language("path").isNotNull())
    symbols = E.over(code, E.symbols, E.SYMBOLS).withColumn("id", C.stable_id("symbol", "path", "name", "ordinal")).persist()
    nodes = _nodes(symbols, id=F.col("id"), kind=F.lit("symbol"), label=F.col("name"), path=F.col("path"), name=F.col("name"), line_start=F.col("line_start"), line_end=F.col("line_end"), text=F.col("name"))
    edges = _edges(symbols, F.col("id"), _file(), 3)
    edges = edges.union(_edges(symbols.select("id", F.explode("satisfies").alias("req")), F.col("id"), C.stable_id("marker", "req"), 0))
    used = E.over(code, E.calls, E.CALLS)
    span = symbols.select("path", F.col("id").alias("caller"), "start", "end")
    caller = used.join(span, "path").where("start <= at AND at < end").groupBy("path", "name", "at").agg(F.min_by("caller", "start").alias("caller"))
    callee = symbols.groupBy("path", "name").agg(F.min_by("id", "start").alias("callee"))
    inner = caller.join(callee, ["path", "name"]).where("caller <> callee").select("path", "caller", "callee").distinct()
    edges = edges.union(_edges(inner, F.col("caller"), F.col("callee"), 7, C.encode_meta(F.lit(0), C.file_context("path"))))
    links = resolved_imports(files, E.over(code, E.imports, E.IMPORTS))
    kind = F.when(F.col("kind") == "reexport", 6).otherwise(5)
    first = links.groupBy("path", "target").agg(F.min(F.struct(F.when(F.col("kind") == "reexport", 1).otherwise(0), F.col("type_only"), F.col("kind"))).alias("w")).select("path", "target", "w.kind", "w.type_only")
    context = F.when(F.col("type_only") & (C.file_context("path") == 0), 1).otherwise(C.file_context("path"))
    edges = edges.union(across(symbols, used, caller, links))
    imports = first.select(_file().alias("from_id"), _file("target").alias("to_id"), kind.cast("int").alias("edge_type"), C.encode_meta(F.lit(0), context).cast("int").alias("meta"))
    return nodes, edges.union(imports)


def declaring(symbols: DataFrame, links: DataFrame, rounds: int = 8) -> DataFrame:
    """(file, name, home): the file that declares what another passes on, over chains of re-exports, nearest first.

    symbols (path, name) declare; links are resolved imports of which re-exports bind 'x', 'x as y' or '*'. Of several
    chains the shortest counts, then the first by path.
    """
    declared = symbols.select(F.col("path").alias("file"), "name").distinct()
    pass_on = links.where("kind = 'reexport'").select(F.col("path").alias("file"), "target", F.explode("bindings").alias("b"))
    pass_on = pass_on.select("file", "target", F.element_at(F.split("b", " as "), 1).alias("outer"), F.element_at(F.split("b", " as "), -1).alias("local"))
    found = declared.select("file", "name", F.col("file").alias("home"))
    step = found
    for _ in range(rounds):
        inner = step.select(F.col("file").alias("target"), F.col("name").alias("there"), "home")
        on = pass_on.join(inner, "target").where((F.col("outer") == "*") | (F.col("outer") == F.col("there")))
        on = on.select("file", F.when(F.col("outer") == "*", F.col("there")).otherwise(F.col("local")).alias("name"), "home")
        new = cut(on.groupBy("file", "name").agg(F.min("home").alias("home")).join(found.select("file", "name"), ["file", "name"], "left_anti"))
        if new.isEmpty():
            break
        found, step = found.union(new), new
    return found


def across(symbols: DataFrame, used: DataFrame, caller: DataFrame, links: DataFrame) -> DataFrame:
    """Edges between symbols of different files: calls of imported names, to where they are declared."""
    found = declaring(symbols, links)
    bound = links.where("kind <> 'reexport' AND NOT type_only").select("path", "target", F.explode("bindings").alias("b")).where("b NOT IN ('*', 'default')")
    bound = bound.join(found.select(F.col("file").alias("target"), F.col("name").alias("b"), "home"), ["target", "b"])
    callee = symbols.groupBy(F.col("path").alias("home"), F.col("name").alias("b")).agg(F.min_by("id", "start").alias("callee"))
    calls = caller.withColumnRenamed("name", "b").join(bound.join(callee, ["home", "b"]).select("path", "b", "callee").distinct(), ["path", "b"])
    return _edges(calls.select("path", "caller", "callee").distinct(), F.col("caller"), F.col("callee"), 7, C.encode_meta(F.lit(0), C.file_context("path")))


def aliased(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts whose specifiers go by a tsconfig alias or by a package of the tree, as places seen from the root."""
    import json

    def aliases(path: str, text: str) -> list[tuple]:
        try:
            if path.endswith("package.json"):
                d = json.loads(E.jsonc(text))
                place = path.rpartition("/")[0]
                entry = d.get("source") or d.get("module") or d.get("main") or "src/index"
                own = "/".join(x for x in (place, str(entry).removeprefix("./")) if x)
                return [(d["name"], own, False), (d["name"] + "/", "/".join(x for x in (place, "src") if x) + "/", True)] if d.get("name") else []
            options = json.loads(E.jsonc(text)).get("compilerOptions") or {}
            base = "/".join(x for x in (path.rpartition("/")[0], str(options.get("baseUrl", ".")).strip("./")) if x)
            found = []
            for name, targets in (options.get("paths") or {}).items():
                to = "/".join(x for x in (base, str(targets[0]).removeprefix("./")) if x)
                found.append((name.rstrip("*"), to.rstrip("*"), name.endswith("*")))
            return found
        except (ValueError, AttributeError, IndexError, TypeError):
            return []

    named = E.over(files.where(r"path RLIKE '(^|/)(package\\.json|tsconfig[^/]*\\.json)$'"), aliases, "path string, name string, place string, prefix boolean")
    # Of a name in several files, the one nearest the root counts, then the first by path.
    named = named.groupBy("name").agg(F.min(F.struct(F.size(F.split("path", "/")), "path", "place", "prefix")).alias("x")).select("name", "x.place", "x.prefix")
    fits = F.when(F.col("prefix"), F.startswith("specifier", F.col("name"))).otherwise(F.col("specifier") == F.col("name"))
    web = facts.where("lang IN ('typescript', 'tsx', 'javascript') AND specifier NOT LIKE '.%'")
    # A repository's aliases are few: one task's reach of the manifests' rows.
    longest = web.select("row", "specifier").join(small(named), fits).groupBy("row").agg(F.max_by(F.struct("name", "place"), F.length("name")).alias("alias"))
    joined = facts.join(longest, "row", "left")
    place = F.concat(F.lit("./"), F.col("alias.place"), F.expr("substring(specifier, length(alias.name) + 1)"))
    return joined.withColumn("folder", F.when(F.col("alias").isNotNull(), F.lit("")).otherwise(F.col("folder"))).withColumn("specifier", F.when(F.col("alias").isNotNull(), place).otherwise(F.col("specifier"))).drop("alias")


def resolved_imports(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Import facts with the tracked file that each specifier names.

    Aliases of tsconfig files and names of the tree's own packages are turned into places first. Candidates in
    order: the place itself, its extension twins and index files; for Python, modules and packages
    from the file's folder (relative) or anywhere if only one fits; for Rust, modules beside or below; for Go,
    all files of the imported folder that aren't tests. Packages outside the tree have no target.
    """
    folder = F.regexp_replace(F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(""), "^/", "")
    own = facts.withColumn("folder", folder).withColumn("lang", C.language("path")).withColumn("row", F.xxhash64("path", "specifier", "kind"))
    own = aliased(files, own)
    web = own.where("lang IN ('typescript', 'tsx', 'javascript') AND specifier LIKE '.%'")
    joined = F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), "specifier")
    flat = F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), lambda acc, s: F.when(s.isin(".", ""), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    base = F.array_join(flat, "/")
    bare = F.regexp_replace(base, r"\.(js|jsx|mjs|cjs)$", "")
    tries = F.array(*[F.concat(base, F.lit(t)) for t in _TWINS], *[F.concat(bare, F.lit(t)) for t in (".ts", ".tsx")])
    py = own.where("lang = 'python'")
    dots = F.length(F.regexp_extract("specifier", r"^\.*", 0))
    up = F.when(dots > 0, F.slice(F.split("folder", "/"), F.lit(1), F.greatest(F.size(F.split("folder", "/")) - dots + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    module = F.array_join(F.filter(F.concat(up, F.split(F.regexp_replace("specifier", r"^\.+", ""), r"\.")), lambda s: s != ""), "/")
    tries_py = F.array(F.concat(module, F.lit(".py")), F.concat(module, F.lit("/__init__.py")))
    rust = own.where("lang = 'rust' AND specifier LIKE 'mod %'")
    name = F.regexp_replace("specifier", "^mod ", "")
    stem = F.regexp_replace("path", r"(/mod|/lib|/main)?\.rs$", "")
    beside = F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), name)
    tries_rs = F.array(F.concat(beside, F.lit(".rs")), F.concat(beside, F.lit("/mod.rs")), F.concat(stem, F.lit("/"), name, F.lit(".rs")))
    out = None
    for df, t in ((web, tries), (py, tries_py), (rust, tries_rs)):
        part = df.select("row", "path", "specifier", "kind", "type_only", "bindings", F.posexplode(t).alias("place", "try"))
        out = part if out is None else out.union(part)
    tracked = files.select(F.col("path").alias("try"))
    found = out.join(tracked, "try").withColumn("n", F.row_number().over(Window.partitionBy("row").orderBy("place", "try"))).where("n = 1")
    exact = found.select("path", "specifier", "kind", "type_only", "bindings", F.col("try").alias("target")).where("path <> target")
    tails = files.where("path LIKE '%.py'").select(F.col("path").alias("whole"), F.regexp_replace(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "/", ".").alias("dotted"))
    tail = tails.select("whole", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("dotted", r"\."))), lambda i: F.array_join(F.slice(F.split("dotted", r"\."), i, F.size(F.split("dotted", r"\."))), "."))).alias("specifier"))
    lone = tail.groupBy("specifier").agg(F.count(F.lit(1)).alias("n"), F.first("whole").alias("target")).where("n = 1").drop("n")
    absolute = py.where("specifier NOT LIKE '.%'").join(exact.select("path", "specifier"), ["path", "specifier"], "left_anti").join(lone, "specifier").where("path <> target")
    go = own.where("lang = 'go'").withColumn("last", F.element_at(F.split("specifier", "/"), -1))
    packages = files.where("path LIKE '%.go' AND path NOT LIKE '%\\_test.go'").select(F.col("path").alias("target"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("place")).where("place <> ''").withColumn("last", F.element_at(F.split("place", "/"), -1))
    go = go.join(packages, "last").where("specifier = place OR endswith(specifier, concat('/', place))").where("path <> target")
    names = ["path", "specifier", "kind", "type_only", "bindings", "target"]
    return exact.select(*names).union(absolute.select(*names)).union(go.select(*names))


def domain_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables with columns and constraints, packages, endpoints, and what maps to, calls and depends on them."""
    sql = E.over(files.where("path LIKE '%.sql'"), E.ddl, E.DDL)
    log = sql.union(E.over(files.where(r"path RLIKE '\\.(xml|ya?ml)$' AND content LIKE '%databaseChangeLog%'"), E.liquibase, E.DDL)).where("action <> 'unknown'")

    def fold(frame):
        import pandas as pd

        frame = frame.sort_values(["path", "seq"])
        rows = []
        for (schema, table), t in E.fold_schema(list(frame[["action", "schema", "table", "name", "detail", "nullable"]].astype(object).where(frame.notna(), None).itertuples(index=False, name=None))).items():
            rows.append((schema, table, "view" if t["view"] else "table", None, t["sources"], None))
            rows += [(schema, table, "column", c, kind, None if n is None else bool(n)) for c, (kind, n) in t["columns"].items()]
            rows += [(schema, table, "constraint", c, detail, None) for c, detail in t["constraints"].items()]
        return pd.DataFrame(rows, columns=["schema", "table", "what", "name", "detail", "nullable"])

    # Definitions of all tables fold in one order, since a rename or a drop reaches across them; they are few.
    schema = log.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fold, "schema string, table string, what string, name string, detail string, nullable boolean").persist()
    full = F.concat_ws(".", "schema", "table")
    table_id = C.stable_id("table", full)
    nodes = _nodes(schema.where("what IN ('table', 'view')"), id=table_id, kind=F.col("what"), label=full, name=F.col("table"), text=full)
    cols = schema.where("what = 'column'")
    nodes = nodes.union(_nodes(cols, id=C.stable_id("column", full, "name"), kind=F.lit("column"), label=F.concat_ws(".", "table", "name"), name=F.col("name"), text=F.concat_ws(" ", F.concat_ws(".", "table", "name"), C.normalize_sql_type("detail"))))
    cons = schema.where("what = 'constraint'")
    nodes = nodes.union(_nodes(cons, id=C.stable_id("constraint", full, "name"), kind=F.lit("constraint"), label=F.col("name"), name=F.col("name"), text=F.concat_ws(" ", "name", "table", F.split("detail", ":")[0])))
    edges = _edges(cols, C.stable_id("column", full, "name"), table_id, 3).union(_edges(cons, C.stable_id("constraint", full, "name"), table_id, 3))
    keys = cons.where("detail LIKE '%→%'").withColumn("to", F.split("detail", "→")[1])
    edges = edges.union(_edges(keys, table_id, C.stable_id("table", "to"), 10))
    views = schema.where("what = 'view' AND detail <> ''").select(table_id.alias("id"), F.explode(F.split("detail", ",")).alias("source"))
    edges = edges.union(_edges(views, F.col("id"), C.stable_id("table", "source"), 10, 1))
    made = E.over(files.where(r"path RLIKE '(^|/)(package\\.json|Cargo\\.toml|tsconfig[^/]*\\.json)$'"), E.manifest, E.MANIFEST)
    packages = made.where("kind = 'package'").withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("path"))).where("n = 1")
    nodes = nodes.union(_nodes(packages, id=C.stable_id("package", "name"), kind=F.lit("package"), label=F.col("name"), name=F.col("name"), path=F.col("path"), text=F.col("name")))
    needs = packages.select("name", F.explode("dependencies").alias("dep")).join(packages.select(F.col("name").alias("dep")), "dep").where("name <> dep")
    edges = edges.union(_edges(needs, C.stable_id("package", "name"), C.stable_id("package", "dep"), 1))
    # A tsconfig that extends another one of the tree depends on it.
    base = made.where("kind = 'tsconfig' AND extends IS NOT NULL").join(files.select(F.col("path").alias("extends")), "extends", "left_semi")
    edges = edges.union(_edges(base, _file(), _file("extends"), 1))
    orms = E.over(files.where(C.language("path").isNotNull() | F.col("path").like("%.prisma")), E.orm, E.ORM)
    known = schema.where("what = 'table'").select(F.col("table").alias("t"), full.alias("full")).groupBy("t").agg(F.min("full").alias("full"))
    edges = edges.union(_edges(orms.join(known, F.element_at(F.split("table", r"\."), -1) == F.col("t")), _file(), C.stable_id("table", "full"), 2, 1))
    served = E.over(files.where(r"path RLIKE '\\.(json|ya?ml)$' AND (content LIKE '%openapi%' OR content LIKE '%swagger%')"), E.openapi, E.OPENAPI)
    called = E.over(files.where(C.language("path").isNotNull() & F.col("content").rlike(r"fetch\(|axios|http|requests\.|client\.|api\.")), E.http_calls, E.HTTP_CALLS)
    route = F.concat_ws(" ", "method", "url")
    nodes = nodes.union(_nodes(served, id=C.stable_id("endpoint", F.lit("defined"), route), kind=F.lit("endpoint"), label=route, path=F.col("path"), name=F.col("operation_id"), text=F.concat_ws(" ", route, "operation_id")).dropDuplicates(["id"]))
    reached = called.select("path", "method", F.col("url").alias("c")).join(served.select("method", F.col("url")).distinct(), "method").where(C.paths_match("c", "url"))
    edges = edges.union(_edges(reached, _file(), C.stable_id("endpoint", F.lit("defined"), route), 7, 1))
    outside = called.join(reached.select("path", "method", F.col("c").alias("url")), ["path", "method", "url"], "left_anti")
    nodes = nodes.union(_nodes(outside, id=C.stable_id("endpoint", F.lit("external"), route), kind=F.lit("endpoint"), label=route, text=route).dropDuplicates(["id"]))
    return nodes, edges.union(_edges(outside, _file(), C.stable_id("endpoint", F.lit("external"), route), 7, 1))


def build(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files (path, content); one edge for each pair and relation, of the least meta."""
    own = files.where(~C.is_noise("path"))
    nodes = _nodes(own, id=_file(), kind=F.lit("file"), label=F.col("path"), path=F.col("path"), source_hash=F.sha2("content", 256), text=F.col("path"))
    edges = None
    for n, e in (markdown_graph(own), code_graph(own), domain_graph(own)):
        nodes = nodes.unionByName(n)
        edges = e if edges is None else edges.unionByName(e)
    return nodes, edges.groupBy("from_id", "to_id", "edge_type").agg(F.min("meta").alias("meta"))
