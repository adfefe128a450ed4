"""Formats, repositories, communities' pages, the stored index and whole answers over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import communities, evaluation, search
from ..operators import graph as G
from .retrieval_queries import _FILES, _bm25, _file_links, _nations, _questions, _rounded, g_filegraph
from .starschema import SQL_EDGES, SQL_NODES, coded, graph, named, table
from .text_queries import _path


def f_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as bytes, from none to megabytes, and order dates as days."""
    own = table(spark, sf_dir, "orders")
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86_400
    size = (F.col("o_totalprice") * F.pow(F.lit(10.0), F.col("o_orderkey") % 4 - 2)).cast("long")
    return own.select("o_orderkey", C.format_bytes(size).alias("bytes"), C.format_day(seconds).alias("day"))


def f_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of pages' addresses and whether the addresses are tags themselves."""
    own = table(spark, sf_dir, "pages").select("url").distinct()
    return own.select("url", C.valid_tag("url").alias("valid"), C.default_tag("url").alias("tag"), C.valid_tag(C.default_tag("url")).alias("tag_valid"))


def f_wiki_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select(F.concat_ws(" / ", "p_type", "p_name", "p_brand").alias("name")).distinct()
    return own.select("name", C.wiki_slug("name").alias("slug"))


def f_specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether endpoints made of pages' paths tell their service."""
    own = table(spark, sf_dir, "pages").select(C.normalize_url_path("url").alias("path")).distinct()
    each = F.explode(F.array(F.col("path"), F.lit("/health"), F.lit("/{}"), F.lit("/contracts"), F.concat(F.lit("/login"), "path"))).alias("path")
    return own.select(each).distinct().select("path", C.is_specific("path").alias("specific"))


def f_redact_dsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that repeat a connection string, of both forms, made of customers."""
    own = table(spark, sf_dir, "customer").withColumn("pw", F.concat(F.lit("pw"), F.col("c_custkey"), F.lit("x")))
    address = F.concat(F.lit("postgres://user:"), "pw", F.lit("@host/db"))
    listed = F.concat(F.lit("host=h password='"), "pw", F.lit("' dbname=d"))
    dsn = F.when(F.col("c_custkey") % 2 == 0, address).otherwise(listed)
    return own.select("c_custkey", C.redact_dsn(F.concat(F.lit("no route to "), dsn), dsn).alias("message"))


def f_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be embedded of the star schema's nodes."""
    own = graph(spark, sf_dir)[0].select(named("id").alias("id"), "kind", "label", "path", F.col("label").alias("name"), F.col("label").alias("title"), F.lit("a body").alias("body"), F.lit("fresh").alias("state"))
    return own.select("id", C.embedding_text().alias("text"))


def g_requirement_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of urgent orders satisfy their customers' requirements; parts with one, and their files."""
    nodes, edges = graph(spark, sf_dir, (G.DEFINED_IN,))
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    made = urgent.where("o_custkey % 10 = 0").select(coded("symbol", "l_partkey").alias("from_id"), coded("requirement", "o_custkey").alias("to_id"), F.lit(0).alias("edge_type"), F.lit(0).alias("meta")).distinct()
    return G.with_requirement(nodes, edges.unionByName(made)).withColumn("id", named("id"))


def g_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as repositories of files and packages, passed on to what is defined in them; counts by kind."""
    nodes, edges = graph(spark, sf_dir, G.TAGGING)
    tag = F.when(F.col("kind") == "file", F.split("path", "/")[0]).when(F.col("kind") == "package", F.col("label"))
    return G.repositories(nodes, edges, tag).join(nodes.select("id", "kind"), "id").groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("n"))


def g_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges within the region ASIA, by type."""
    nodes, edges = graph(spark, sf_dir)
    tag = F.when(F.col("kind") == "file", F.split("path", "/")[0]).when(F.col("kind") == "package", F.col("label"))
    own = G.restricted(nodes, edges, G.repositories(nodes, edges, tag), "ASIA")[1]
    return own.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


def g_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files an undirected walk over imports reaches from the first supplier's."""
    nodes, edges = graph(spark, sf_dir, (G.IMPORTS,))
    first = table(spark, sf_dir, "supplier").agg(F.min("s_suppkey")).first()[0]
    start = nodes.where((F.col("kind") == "file") & (F.col("key") == first)).first()["id"]
    return spark.createDataFrame([(G.reachable(nodes.where("kind = 'file'"), edges, start, types=(5,)),)], "reached long")


def g_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports between nations, from both sides."""
    return communities.crossings(_file_links(spark, sf_dir)[0], _nations(spark, sf_dir))


def g_top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most connected files of each nation."""
    return communities.top_files(g_filegraph(spark, sf_dir), _nations(spark, sf_dir))


def s_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each word of the stored index: how many documents and occurrences it has."""
    stored = search.index(table(spark, sf_dir, "documents"), "doc_id")["postings"]
    return stored.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def s_bm25_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s_bm25_topk over an index that is stored first."""
    made = search.stored_index(table(spark, sf_dir, "documents"), "doc_id")
    return _rounded(search.bm25_stored(made["postings"], made["sizes"], _questions(spark, sf_dir)), "score")


def s_search_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer around three hits: the last order, the last part and the last supplier, with dependents."""
    nodes, edges = graph(spark, sf_dir, (*search.EXPANDED, *G.DEPENDENCIES))
    kinds = F.when(F.col("kind") == "task", 1).when(F.col("kind") == "symbol", 2).when(F.col("kind") == "file", 3)
    last = nodes.withColumn("rank", kinds).where("rank IS NOT NULL").groupBy("rank").agg(F.max_by("id", "key").alias("id"))
    return search.expanded(nodes, edges, last.select("rank", "id", (1 / F.col("rank")).alias("score")), True, name=named).select(named("id").alias("id"), "tier", "place", F.round("score", 6).alias("score"))


def b_hit_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every file, and every fiftieth requirement with its tasks, lies."""
    nodes, edges = graph(spark, sf_dir, (G.SATISFIES,))
    own = nodes.withColumn("name", F.col("label"))
    hits = own.where("kind = 'file' OR (kind = 'requirement' AND key % 50 = 0)").select(F.col("kind").alias("query_id"), F.lit(1).alias("rank"), "id")
    found = evaluation.hit_locations(own, edges, hits)
    return found.groupBy("query_id", "step", "path", "marker").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        f_formats, f_tags, f_wiki_slug, f_specific, f_redact_dsn, f_embedding_text, g_requirement_nodes, g_repositories, g_restricted, g_reachable, g_crossings,
        g_top_files, s_postings, s_bm25_stored, s_search_graph, b_hit_locations,
    )
}

_G = f"WITH {SQL_NODES},{SQL_EDGES}"
_TAGGED = """, t AS (SELECT id, CASE kind WHEN 'file' THEN string_split(path, '/')[1] WHEN 'package' THEN label END AS repo FROM nodes WHERE kind IN ('file', 'package')),
r AS (SELECT * FROM t UNION ALL SELECT from_id, min(repo) FROM edges JOIN t ON to_id = id WHERE edge_type = 3 GROUP BY from_id)"""
_SQL_WORDS = "trim(lower(regexp_replace(regexp_replace(label, '([\\p{Ll}0-9])(\\p{Lu})', '\\1 \\2', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')))"

ORACLE_SQL = {
    "f_formats": """WITH o AS (SELECT o_orderkey, o_orderdate, CAST(trunc(o_totalprice * pow(10.0::DOUBLE, o_orderkey % 4 - 2)) AS BIGINT) AS b FROM orders)
SELECT o_orderkey, CASE WHEN b >= 1048576 THEN format('{:.1f} MB', b / 1048576.0::DOUBLE) WHEN b >= 1024 THEN format('{:.1f} KB', b / 1024.0::DOUBLE) ELSE b || ' B' END AS bytes, strftime(o_orderdate, '%Y-%m-%d') AS day FROM o""",
    "f_tags": """WITH u AS (SELECT DISTINCT url, string_split(regexp_replace(url, '/+$', ''), '/')[-1] AS part FROM pages),
d AS (SELECT url, regexp_replace(CASE WHEN regexp_matches(part, '.\\.[^.]*$') THEN regexp_replace(part, '\\.[^.]*$', '') ELSE part END, '[^A-Za-z0-9._-]', '-', 'g') AS tag FROM u)
SELECT url, regexp_matches(url, '^[A-Za-z0-9._-]{1,64}$') AS valid, tag, regexp_matches(tag, '^[A-Za-z0-9._-]{1,64}$') AS tag_valid FROM d""",
    "f_wiki_slug": "WITH n AS (SELECT DISTINCT p_type || ' / ' || p_name || ' / ' || p_brand AS name FROM part) SELECT name, regexp_replace(lower(regexp_replace(name, '[^A-Za-z0-9]+', '-', 'g')), '^-+|-+$', '', 'g')[1:40] AS slug FROM n",
    "f_specific": f"""WITH p AS (SELECT DISTINCT {_path("url")} AS path FROM pages), x AS (SELECT DISTINCT unnest([path, '/health', '/{{}}', '/contracts', '/login' || path]) AS path FROM p),
s AS (SELECT path, list_filter(string_split(path, '/'), lambda s: s NOT IN ('', '{{}}')) AS own FROM x)
SELECT path, len(own) > 1 OR (len(own) = 1 AND own[1] NOT IN ('health', 'healthz', 'status', 'ping', 'metrics', 'ready', 'live', 'version', 'login', 'logout')) AS specific FROM s""",
    "f_redact_dsn": """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'no route to postgres://user:[redacted]@host/db' ELSE 'no route to host=h password=''[redacted]'' dbname=d' END AS message FROM customer""",
    "f_embedding_text": f"""{_G} SELECT id, CASE WHEN kind IN ('requirement', 'task') THEN label || '. a body' WHEN kind = 'symbol' THEN {_SQL_WORDS} WHEN kind = 'table' THEN 'table ' || {_SQL_WORDS} END AS text FROM nodes""",
    "g_requirement_nodes": f"""{_G}, s AS (SELECT DISTINCT sha256('symbol:' || l_partkey) AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' AND o_custkey % 10 = 0)
SELECT id, 'symbol' AS kind FROM s JOIN nodes USING (id) UNION ALL SELECT DISTINCT to_id, 'file' FROM edges JOIN s ON from_id = s.id JOIN nodes n ON n.id = to_id WHERE edge_type = 3""",
    "g_repositories": f"{_G}{_TAGGED} SELECT repo, kind, count(*) AS n FROM r JOIN nodes USING (id) GROUP BY ALL",
    "g_restricted": f"{_G}{_TAGGED}, k AS (SELECT id FROM r WHERE repo = 'ASIA') SELECT edge_type, count(*) AS n FROM edges WHERE from_id IN (SELECT id FROM k) AND to_id IN (SELECT id FROM k) GROUP BY edge_type",
    "g_reachable": f"""WITH RECURSIVE {SQL_NODES},{SQL_EDGES}, l AS (SELECT from_id AS a, to_id AS b FROM edges WHERE edge_type = 5 UNION SELECT to_id, from_id FROM edges WHERE edge_type = 5),
w AS (SELECT sha256('file:' || min(s_suppkey)) AS id FROM supplier UNION SELECT b FROM w JOIN l ON a = w.id) SELECT count(*) - 1 AS reached FROM w""",
    "g_crossings": f"""{_FILES}, x AS (SELECT m.community AS a, n.community AS b, count(*) AS links FROM fl JOIN mem m ON m.file = from_path JOIN mem n ON n.file = to_path WHERE edge_type = 5 AND m.community <> n.community GROUP BY ALL)
SELECT a AS community, 'depends on' AS side, b AS other, links FROM x UNION ALL SELECT b, 'used by', a, links FROM x""",
    "g_top_files": f"""{_FILES}, h AS (SELECT file, sum(weight) AS weight FROM (SELECT a AS file, weight FROM fg UNION ALL SELECT b, weight FROM fg) GROUP BY file),
z AS (SELECT community FROM mem GROUP BY community HAVING count(*) >= 3), p AS (SELECT community, file, weight, CAST(row_number() OVER (PARTITION BY community ORDER BY weight DESC, file) AS INTEGER) AS place FROM h JOIN mem USING (file) JOIN z USING (community))
SELECT community, place, file, weight FROM p WHERE place <= 5""",
    "s_postings": r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY term",
    "s_bm25_stored": f"WITH {_bm25()} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM lex",
    "s_search_graph": f"""{_G}, s AS (SELECT id, rank FROM (SELECT id, CASE kind WHEN 'task' THEN 1 WHEN 'symbol' THEN 2 WHEN 'file' THEN 3 END AS rank, key FROM nodes) WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rank ORDER BY key DESC) = 1),
h AS (SELECT to_id AS id, min(rank) + 1000 AS place FROM edges JOIN s ON from_id = s.id WHERE edge_type IN (0, 1, 2, 3) AND to_id NOT IN (SELECT id FROM s) GROUP BY to_id),
o AS (SELECT id, CASE WHEN rank = 1 THEN 0 ELSE 1 END AS tier, rank AS place, 1.0::DOUBLE / rank AS score FROM s UNION ALL SELECT id, 2, place, 0 FROM h),
f AS (SELECT DISTINCT to_id AS id FROM edges JOIN s ON from_id = s.id WHERE edge_type = 3),
e AS (SELECT from_id, to_id, meta % 2 AS inferred, (meta // 2) % 4 AS context FROM edges WHERE edge_type IN (1,5,6,7,8,9,10)),
d1 AS (SELECT id, row_number() OVER (ORDER BY t, id) AS n FROM (SELECT from_id AS id, min(struct_pack(inferred, context)) AS t FROM e WHERE to_id IN (SELECT id FROM s) AND from_id NOT IN (SELECT id FROM s) GROUP BY from_id)),
d2 AS (SELECT id, row_number() OVER (ORDER BY t, id) AS n FROM (SELECT from_id AS id, min(struct_pack(inferred, context)) AS t FROM e WHERE to_id IN (SELECT id FROM f) AND from_id NOT IN (SELECT id FROM f) GROUP BY from_id)),
b AS (SELECT id, min(place) AS place FROM (SELECT id, n + 2000 AS place FROM d1 WHERE n <= 15 UNION ALL SELECT id, n + 3000 FROM d2 WHERE n <= 15) WHERE id NOT IN (SELECT id FROM o) GROUP BY id ORDER BY place, id LIMIT 15),
z AS (SELECT * FROM o UNION ALL SELECT id, 2, place, 0 FROM b) SELECT id, tier, CAST(place AS INTEGER) AS place, round(score, 6) AS score FROM z WHERE id IN (SELECT id FROM nodes)""",
    "b_hit_locations": f"""{_G}, h AS (SELECT id, kind, label, path FROM nodes WHERE kind = 'file' OR (kind = 'requirement' AND key % 50 = 0)),
t AS (SELECT h.kind AS query_id, 1 AS step, NULL AS path, n.label AS marker FROM h JOIN edges ON to_id = h.id AND edge_type = 0 JOIN nodes n ON n.id = from_id WHERE h.kind = 'requirement' AND n.kind = 'task'),
u AS (SELECT kind AS query_id, 0 AS step, path, CASE kind WHEN 'requirement' THEN label END AS marker FROM h UNION ALL SELECT * FROM t)
SELECT query_id, step, path, marker, count(*) AS n FROM (SELECT DISTINCT * FROM u) GROUP BY ALL""",
}
