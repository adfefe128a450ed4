"""Graph queries over the star schema's graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import graph as G
from .starschema import SQL_EDGES, SQL_NODES, SQL_RELATION, code, coded, graph, named, supplier_partners, table


def last_supplier(spark: SparkSession, sf_dir: str) -> int:
    return code("file", table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0])


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("id", named("id"))


def _affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.affected(*graph(spark, sf_dir, G.DEFAULT_TYPES), last_supplier(spark, sf_dir), name=named)


def g_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_affected(spark, sf_dir)).drop("omitted")


def g_affected_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _affected(spark, sf_dir).select("depth", "omitted").distinct()


def g_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.summary(*graph(spark, sf_dir))


def g_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(G.degrees(*graph(spark, sf_dir, G.DEPENDENCIES)))


def g_god_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(G.god_nodes(*graph(spark, sf_dir, G.DEPENDENCIES), name=named))


def g_barrel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(G.barrels(*graph(spark, sf_dir, G.DEPENDENCIES)))


def g_edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certain test and spec calls, by context."""
    types = G.relation_codes(["calls"])
    own = G.edge_filter(graph(spark, sf_dir, types)[1], types, True, G.context_codes(["test", "spec"]))
    return own.groupBy(C.context_name(C.meta_context("meta")).alias("context")).agg(F.count(F.lit(1)).alias("n"))


def g_meta_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's attributes, packed and unpacked again."""
    line = table(spark, sf_dir, "lineitem")
    context = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "R", 2).otherwise(3)
    meta = C.encode_meta(F.col("l_discount") > 0.05, context, F.col("l_discount") * 8)
    return line.select(meta.alias("meta")).groupBy("meta").agg(F.count(F.lit(1)).alias("n")).select(
        "meta", C.meta_inferred("meta").alias("inferred"), C.meta_context("meta").alias("context"), F.round(C.meta_similarity("meta"), 6).alias("similarity"), "n"
    )


def g_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes two forward hops from the urgent orders reach, by kind and depth."""
    nodes, edges = graph(spark, sf_dir, types := (0, 3, 7))
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(coded("task", "o_orderkey").alias("id"))
    seeds = nodes.where("kind = 'task'").join(urgent, "id", "left_semi")
    return G.khop(edges, seeds, 2, types).join(nodes.select("id", "kind"), "id").groupBy("kind", "depth").agg(F.count(F.lit(1)).alias("n"))


def g_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(G.trace(*graph(spark, sf_dir, G.TRACE_TYPES), last_supplier(spark, sf_dir), depth=2, name=named))


def g_expand_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(G.expand(*graph(spark, sf_dir, G.DEFAULT_TYPES), [last_supplier(spark, sf_dir)], depth=2, max_nodes=60, name=named)).drop("parent")


def g_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first supplier's file to the last's, over imports."""
    nodes, edges = graph(spark, sf_dir, (5,))
    ends = table(spark, sf_dir, "supplier").agg(F.min("s_suppkey").alias("a"), F.max("s_suppkey").alias("b")).first()
    files = nodes.where("kind = 'file'")
    return G.shortest_path(files, edges, code("file", ends["a"]), code("file", ends["b"]), 6, (5,)).agg((F.count(F.lit(1)) - 1).alias("hops"))


def g_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(G.explain(*graph(spark, sf_dir, G.DEPENDENCIES), last_supplier(spark, sf_dir), name=named))


def g_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three targets: a nation in another case, a requirement's marker, and a supplier's file by its tail."""
    nodes = _named(graph(spark, sf_dir)[0])
    ends = table(spark, sf_dir, "supplier").agg(F.min_by("s_name", "s_suppkey").alias("s")).first()
    customer = table(spark, sf_dir, "customer").agg(F.min_by("c_name", "c_custkey").alias("c")).first()
    nation = table(spark, sf_dir, "nation").agg(F.min_by("n_name", "n_nationkey").alias("n")).first()
    out = None
    for what, target in (("nation", nation["n"].lower()), ("customer", customer["c"]), ("supplier", ends["s"])):
        found = G.resolve(nodes, target).select(F.lit(what).alias("what"), "step", "id", "label", "kind")
        out = found if out is None else out.union(found)
    return out


def g_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by the orders of the first quarter of 1995, where only even customers are known; counts by state."""
    nodes, edges = graph(spark, sf_dir, (G.SATISFIES,))
    quarter = table(spark, sf_dir, "orders").where("o_orderdate < timestamp '1995-04-01'").select(coded("task", "o_orderkey").alias("id"))
    known = nodes.where("(kind = 'requirement' AND key % 2 = 0)").unionByName(nodes.where("kind = 'task'").join(quarter, "id", "left_semi").select(*nodes.columns))
    own = edges.where("edge_type = 0").join(quarter.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    return _named(G.coverage(known, own))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders of a while ago, newer and re-priced ones, and ones that are gone."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    base = orders.where("id % 10 <> 0")
    upserts = orders.where("id % 10 = 0 OR id % 7 = 0").withColumn("price", F.when(F.col("id") % 7 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return base, upserts, orders.where("id % 13 = 0").select("id")


def g_delta_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.delta_view(*_versions(spark, sf_dir))
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("price"))


def g_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, upserts, _ = _versions(spark, sf_dir)
    return G.reconcile(upserts, base, "id", ["status", "price"])


def g_union_prefer(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, upserts, _ = _versions(spark, sf_dir)
    return G.union_prefer(upserts, base, "id").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("price"))


def g_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_partners(spark, sf_dir, 5).select("a", "b", "n", "rank")


QUERIES = {f.__name__: f for f in (g_affected, g_affected_omitted, g_summary, g_degree, g_god_nodes, g_barrel, g_edge_filter, g_meta_codec, g_khop, g_trace, g_expand_bfs, g_shortest_path, g_explain, g_resolve, g_coverage, g_delta_view, g_reconcile, g_union_prefer, g_partners)}

_G = f"WITH {SQL_NODES},{SQL_EDGES}"
_WALK = "(0,1,2,5,6,7,8,9,10)"
_ROOT = "(SELECT sha256('file:' || max(s_suppkey)) FROM supplier)"
_CTX = "['runtime','type_only','test','spec','annotation','embedding']"
_LIVE = "live AS (SELECT e.* FROM edges e JOIN nodes a ON a.id = from_id JOIN nodes b ON b.id = to_id WHERE edge_type IN (1,5,6,7,8,9,10))"
_DEGREES = "half AS (SELECT from_id AS id, 1 AS o, 0 AS i FROM live UNION ALL SELECT to_id, 0, 1 FROM live), degrees AS (SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM half GROUP BY id)"
_BARRELS = "barrels AS (SELECT from_id AS id, count(*) FILTER (WHERE edge_type = 6) AS reexports, count(*) AS outgoing FROM edges JOIN nodes n ON n.id = from_id AND n.kind = 'file' WHERE edge_type IN (1,5,6,7,8,9,10) GROUP BY from_id HAVING reexports >= 2 AND 2 * reexports >= outgoing)"


def _level(d: int, before: str, visited: str) -> str:
    return f"""c{d} AS (SELECT from_id AS id, min(struct_pack(pos := f.pos, edge_type := edges.edge_type, meta := edges.meta)) AS via FROM edges JOIN (SELECT id, pos FROM {before}) f ON f.id = to_id
WHERE edge_type IN {_WALK} AND from_id NOT IN ({visited}) GROUP BY from_id),
r{d} AS (SELECT c.id, label, kind, via.edge_type AS edge_type, via.meta AS meta,
row_number() OVER (ORDER BY via.meta & 1, (via.meta >> 1) & 3, label, c.id) AS pos, count(*) OVER () AS n FROM c{d} c JOIN nodes USING (id)),
l{d} AS (SELECT * FROM r{d} WHERE pos <= 25)"""


_AFFECTED = f"""{_G}, l0 AS (SELECT {_ROOT} AS id, 0 AS pos), {_level(1, "l0", "SELECT id FROM l0")},
{_level(2, "l1", "SELECT id FROM l0 UNION ALL SELECT id FROM l1")},
walk AS (SELECT *, 1 AS depth FROM l1 UNION ALL SELECT *, 2 FROM l2)"""

_STEPS = f"""SELECT from_id AS a, to_id AS b, 0 AS back, edge_type, meta FROM edges WHERE edge_type IN {_WALK}
UNION ALL SELECT to_id, from_id, 1, edge_type, meta FROM edges WHERE edge_type IN {_WALK}"""


def _bfs(d: int, before: str, visited: str, used: str) -> str:
    return f"""b{d} AS (SELECT b AS id, min(struct_pack(pos, inferred := meta & 1, ctx := (meta >> 1) & 3, id := b, back, edge_type, meta)) AS via
FROM steps JOIN {before} f ON f.id = a JOIN nodes n ON n.id = b WHERE b NOT IN ({visited}) GROUP BY b),
e{d} AS (SELECT id, via, row_number() OVER (ORDER BY via) - 1 AS pos FROM b{d} QUALIFY row_number() OVER (ORDER BY via) <= 60 - {used})"""


_TRACE_RANK = "list_position([0,3,2,1,5,6,7,8,9,10], edge_type)"


def _trace(d: int, before: str, visited: str) -> str:
    return f"""t{d} AS (SELECT id, min(via) AS via FROM (
SELECT to_id AS id, struct_pack(pos, back := 0, rank := CAST({_TRACE_RANK} AS BIGINT), edge_type, meta) AS via FROM edges JOIN {before} f ON f.id = from_id WHERE edge_type IN (0,3,2,1,5,6,7,8,9,10)
UNION ALL SELECT from_id, struct_pack(pos, back := 1, rank := CAST(edge_type AS BIGINT), edge_type, meta) FROM edges JOIN {before} f ON f.id = to_id WHERE edge_type IN (0,2,1,5,6,7,8,9,10))
WHERE id NOT IN ({visited}) GROUP BY id),
u{d} AS (SELECT id, via, row_number() OVER (ORDER BY via.edge_type = 3, via.meta & 1, (via.meta >> 1) & 3, id) AS pos FROM t{d}
QUALIFY row_number() OVER (ORDER BY via.edge_type = 3, via.meta & 1, (via.meta >> 1) & 3, id) <= 25)"""


_VERSIONS = """WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders),
base AS (SELECT * FROM o WHERE id % 10 <> 0),
ups AS (SELECT id, status, CASE WHEN id % 7 = 0 THEN price + 1 ELSE price END AS price FROM o WHERE id % 10 = 0 OR id % 7 = 0),
gone AS (SELECT id FROM o WHERE id % 13 = 0)"""

ORACLE_SQL = {
    "g_affected": f"{_AFFECTED} SELECT id, label, kind, depth, {SQL_RELATION.format('edge_type')} AS relation, meta & 1 = 1 AS inferred, {_CTX}[((meta >> 1) & 7) + 1] AS context FROM walk",
    "g_affected_omitted": f"{_AFFECTED} SELECT depth, greatest(0, max(n) - 25) AS omitted FROM walk GROUP BY depth",
    "g_summary": f"""{_G} SELECT 'nodes' AS section, kind AS name, count(*) AS n FROM nodes GROUP BY kind
UNION ALL SELECT 'edges', {SQL_RELATION.format('edge_type')}, count(*) FROM edges GROUP BY edge_type
UNION ALL SELECT 'files', 'other', count(*) FROM nodes WHERE kind = 'file'""",
    "g_degree": f"{_G},{_LIVE},{_DEGREES} SELECT id, in_degree, out_degree, degree FROM degrees",
    "g_god_nodes": f"{_G},{_LIVE},{_DEGREES},{_BARRELS} SELECT id, label, kind, degree FROM degrees JOIN nodes USING (id) WHERE kind IN ('file','symbol') AND id NOT IN (SELECT id FROM barrels) ORDER BY degree DESC, label, id LIMIT 10",
    "g_barrel": f"{_G},{_BARRELS} SELECT id, reexports, outgoing FROM barrels",
    "g_edge_filter": f"{_G} SELECT {_CTX}[((meta >> 1) & 7) + 1] AS context, count(*) AS n FROM edges WHERE edge_type = 7 AND meta & 1 = 0 AND ((meta >> 1) & 7) IN (2,3) GROUP BY 1",
    "g_meta_codec": """WITH m AS (SELECT (CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS i, (CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 2 ELSE 3 END) AS c,
CAST(round(least(greatest(l_discount * 8, 0.0), 1.0) * 15) AS INTEGER) AS s FROM lineitem)
SELECT i + 2 * c + 16 * s AS meta, i AS inferred, c AS context, CASE WHEN s > 0 THEN round(s / 15.0::DOUBLE, 6) END AS similarity, count(*) AS n FROM m GROUP BY ALL""",
    "g_khop": f"""{_G}, s AS (SELECT id FROM nodes JOIN orders ON kind = 'task' AND key = o_orderkey WHERE o_orderpriority = '1-URGENT'),
h1 AS (SELECT DISTINCT to_id AS id FROM edges JOIN s ON from_id = s.id WHERE edge_type IN (0,3,7) AND to_id NOT IN (SELECT id FROM s)),
h2 AS (SELECT DISTINCT to_id AS id FROM edges JOIN h1 ON from_id = h1.id WHERE edge_type IN (0,3,7) AND to_id NOT IN (SELECT id FROM s UNION ALL SELECT id FROM h1)),
a AS (SELECT id, 0 AS depth FROM s UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2)
SELECT kind, depth, count(*) AS n FROM a JOIN nodes USING (id) GROUP BY ALL""",
    "g_trace": f"""{_G}, u0 AS (SELECT {_ROOT} AS id, 0 AS pos), {_trace(1, "u0", "SELECT id FROM u0")}, {_trace(2, "u1", "SELECT id FROM u0 UNION ALL SELECT id FROM u1")},
w AS (SELECT *, 1 AS depth FROM u1 UNION ALL SELECT *, 2 FROM u2)
SELECT id, label, kind, depth, {SQL_RELATION.format('via.edge_type')} AS relation, via.back = 1 AS incoming, via.meta AS meta FROM w JOIN nodes USING (id)""",
    "g_expand_bfs": f"""{_G}, steps AS ({_STEPS}), e0 AS (SELECT {_ROOT} AS id, 0 AS pos), {_bfs(1, "e0", "SELECT id FROM e0", "0")},
{_bfs(2, "e1", "SELECT id FROM e0 UNION ALL SELECT id FROM e1", "(SELECT count(*) FROM e1)")},
w AS (SELECT id, via, pos AS seq, 1 AS depth FROM e1 UNION ALL SELECT id, via, pos + (SELECT count(*) FROM e1), 2 FROM e2)
SELECT CAST(seq AS INTEGER) AS seq, id, depth, {SQL_RELATION.format('via.edge_type')} AS relation, via.back = 0 AS forward, via.meta AS meta FROM w""",
    "g_shortest_path": f"""{_G.replace("WITH", "WITH RECURSIVE", 1)}, both_ways AS (SELECT from_id AS a, to_id AS b FROM edges WHERE edge_type = 5 UNION SELECT to_id, from_id FROM edges WHERE edge_type = 5),
w AS (SELECT (SELECT sha256('file:' || min(s_suppkey)) FROM supplier) AS id, 0 AS d UNION SELECT b, d + 1 FROM w JOIN both_ways ON a = w.id WHERE d < 6)
SELECT coalesce(min(d), -1) AS hops FROM w WHERE id = (SELECT sha256('file:' || max(s_suppkey)) FROM supplier)""",
    "g_explain": f"""{_G}, x AS (SELECT 'dependencies' AS side, to_id AS id, edge_type, meta FROM edges WHERE from_id = {_ROOT} AND edge_type IN (1,5,6,7,8,9,10)
UNION ALL SELECT 'dependents', from_id, edge_type, meta FROM edges WHERE to_id = {_ROOT} AND edge_type IN (1,5,6,7,8,9,10)),
r AS (SELECT side, id, label, edge_type, row_number() OVER (PARTITION BY side ORDER BY meta & 1, (meta >> 1) & 7, label, id, edge_type) AS place, count(*) OVER (PARTITION BY side) AS total FROM x JOIN nodes USING (id))
SELECT side, CAST(place AS INTEGER) AS place, id, label, {SQL_RELATION.format('edge_type')} AS relation, total FROM r WHERE place <= 10""",
    "g_resolve": f"""WITH {SQL_NODES}
SELECT 'nation' AS what, 61 AS step, id, label, kind FROM nodes WHERE kind = 'table' AND lower(label) = (SELECT lower(arg_min(n_name, n_nationkey)) FROM nation) AND label <> lower(label)
UNION ALL SELECT 'customer', 20, id, label, kind FROM nodes WHERE kind = 'requirement' AND label = (SELECT arg_min(c_name, c_custkey) FROM customer)
UNION ALL SELECT 'supplier', 40, id, label, kind FROM nodes WHERE kind = 'file' AND path LIKE '%/' || (SELECT arg_min(s_name, s_suppkey) FROM supplier)""",
    "g_coverage": """WITH t AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-04-01')
SELECT sha256('requirement:' || c_custkey) AS id, c_name AS label, 'uncovered' AS state FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM t)
UNION ALL SELECT sha256('task:' || o_orderkey), CAST(o_orderkey AS VARCHAR), 'orphan_reference' FROM t WHERE o_custkey % 2 <> 0""",
    "g_delta_view": f"{_VERSIONS}, v AS (SELECT * FROM base WHERE id NOT IN (SELECT id FROM ups) AND id NOT IN (SELECT id FROM gone) UNION ALL SELECT * FROM ups WHERE id NOT IN (SELECT id FROM gone)) SELECT status, count(*) AS n, round(sum(price), 2) AS price FROM v GROUP BY status",
    "g_reconcile": f"""{_VERSIONS} SELECT coalesce(u.id, b.id) AS id, CASE WHEN u.id IS NULL THEN 'remove' ELSE 'upsert' END AS op FROM ups u FULL JOIN base b ON u.id = b.id
WHERE u.id IS NULL OR b.id IS NULL OR u.status <> b.status OR u.price <> b.price""",
    "g_union_prefer": f"{_VERSIONS}, v AS (SELECT * FROM ups UNION ALL SELECT * FROM base WHERE id NOT IN (SELECT id FROM ups)) SELECT status, count(*) AS n, round(sum(price), 2) AS price FROM v GROUP BY status",
    "g_partners": f"WITH {SQL_EDGES[:SQL_EDGES.index('edges AS (')].rstrip().rstrip(',')} SELECT a, b, n, CAST(rank AS INTEGER) AS rank FROM partner WHERE rank <= 5",
}
