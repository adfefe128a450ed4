"""Retrieval, budgets, co-change, communities, memory and evaluation over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import budget, cochange, communities, evaluation, memory, search
from ..operators import graph as G
from ..operators.lineage import cut
from ..operators.sizes import small
from .starschema import SQL_EDGES, SQL_NODES, graph, named, table

_DOCS, _K = "documents", 20


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six words of every benchmark item."""
    words = F.slice(search.tokens("text"), 1, 6)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("text"))


def _rounded(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.round(column, 6))


def s_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.bm25(table(spark, sf_dir, _DOCS), _questions(spark, sf_dir), "doc_id", k=_K), "score")


def s_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every hundredth."""
    rows = table(spark, sf_dir, "embeddings")
    return _rounded(search.nearest(rows, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), _K), "distance")


def s_similar_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar vectors of every vector, from a similarity of 0.25 on."""
    return search.similar(table(spark, sf_dir, "embeddings"), 3, 0.25)


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A lexical list for every item and a vector list for every hundredth vector; documents stand for the vectors of their number."""
    lexical = search.bm25(table(spark, sf_dir, _DOCS), _questions(spark, sf_dir), "doc_id", k=_K)
    rows = table(spark, sf_dir, "embeddings")
    return lexical, search.nearest(rows, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), _K)


def s_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.fuse(*_lists(spark, sf_dir)), "score")


def _lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))


def s_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.overlay(search.fuse(*_lists(spark, sf_dir)), _lessons(spark, sf_dir)), "score")


def t_budget_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation that fit 400 tokens: system turns first, then users', then answers."""
    tier = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    items = table(spark, sf_dir, "conversations").withColumn("tier", tier)
    return budget.fit(items, "conv_id", "tier", "turn", "text", 400).select("conv_id", "turn", "tier", "cost", "used")


def t_fit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document that fit 300 tokens with a footer of 12."""
    lines = table(spark, sf_dir, _DOCS).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return budget.fit_lines(lines, "doc_id", "at", "line", 300, 12).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.max("used").alias("used"))


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("files"))  # a commit's files
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("at"))
    return orders.join(own, orders["commit"] == own["l_orderkey"]).select("commit", "at", "files")


def _last_order(spark: SparkSession, sf_dir: str):
    return F.lit(table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).first()[0])


def g_cochange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that were ordered together in the last 180 days, with counts."""
    return cochange.counts(cochange.recent(_commits(spark, sf_dir), None, now=_last_order(spark, sf_dir)))


def g_cochange_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 500 orders' pairs, at most three partners a part; counts of partners."""
    taken = cochange.capped(cochange.recent(_commits(spark, sf_dir), now=_last_order(spark, sf_dir)), 3)
    return taken.select(F.col("a").alias("part")).union(taken.select("b")).groupBy("part").agg(F.count(F.lit(1)).alias("partners"))


def _file_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links between files by path: imports, and files that share an order as pairs."""
    nodes, edges = graph(spark, sf_dir, (5, 6))
    files = nodes.where("kind = 'file'").select("id", "path")
    a, b = files.toDF("from_id", "from_path"), files.toDF("to_id", "to_path")
    links = edges.where("edge_type = 5").join(a, "from_id").join(b, "to_id").select("from_path", "to_path")
    return links, edges.where("edge_type = 6").join(a, "from_id").join(b, "to_id").select(F.col("from_path").alias("a"), F.col("to_path").alias("b"))


def g_filegraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.file_graph(*_file_links(spark, sf_dir))


def g_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.communities(g_filegraph(spark, sf_dir))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as communities, for operators that take a membership."""
    nodes = graph(spark, sf_dir)[0].where("kind = 'file'")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("community"))
    return nodes.join(supplier, "key").select(F.col("path").alias("file"), "community")


def g_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.cohesion(g_filegraph(spark, sf_dir), _nations(spark, sf_dir))


def g_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.surprises(_file_links(spark, sf_dir)[0], _nations(spark, sf_dir))


def g_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of suppliers over each one's closest partner, with the links that would open them."""
    from .starschema import supplier_partners

    links = supplier_partners(spark, sf_dir, 1).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    return communities.cycles(links).select("cycle", "size", F.array_join("nodes", ",").alias("nodes"), F.size("cut").alias("cuts"))


def m_reflect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lessons about users from their events, at the end of January 2024 with a half-life of a week."""
    outcome = F.when(F.col("event_type").isin("purchase", "signup"), "useful").when(F.col("event_type") == "error", "dead_end")
    signals = table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), F.col("ts").cast("timestamp").alias("at"), outcome.alias("outcome")).where("outcome IS NOT NULL")
    return memory.reflect(signals, F.lit("2024-02-01 00:00:00").cast("timestamp"), 7.0)


def m_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m_reflect(spark, sf_dir).groupBy("lesson", "leaning").agg(F.count(F.lit(1)).alias("n"))


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item's first eight words are what a question for them should find."""
    docs = table(spark, sf_dir, _DOCS).select("doc_id", F.lower("text").alias("text"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("own"))
    return docs.join(small(items), F.col("text").contains(F.col("own"))).select("query_id", F.col("doc_id").alias("id"))


def b_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = search.bm25(table(spark, sf_dir, _DOCS), _questions(spark, sf_dir), "doc_id", k=_K)
    out = evaluation.recall_mrr(ranked, _expected(spark, sf_dir))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def b_grep_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a grep for each item's first word of eight letters or more would show."""
    words = F.filter(F.split(F.regexp_replace("text", r"[^\p{L} ]", " "), " "), lambda w: F.char_length(w) >= 8)
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.get(words, F.lit(0)).alias("term")).where("term IS NOT NULL")
    return evaluation.grep_baseline(table(spark, sf_dir, _DOCS), terms, "doc_id")


def b_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the questions against those of the items, by conversation role's share."""
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "user", C.token_estimate("text")).otherwise(0)).alias("cost"), F.sum(C.token_estimate("text")).alias("baseline"))
    return own.select("conv_id", "cost", "baseline", F.round(evaluation.savings(F.col("cost"), F.col("baseline")), 6).alias("saved"))


def b_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.upper_median(table(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value")


def _importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir, (0, *G.DEPENDENCIES))
    together = edges.where("edge_type = 6").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))  # re-exports stand for co-changes
    return evaluation.importance(nodes, edges.where("edge_type <> 6"), together)


def e_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _importance(spark, sf_dir).withColumn("id", named("id"))


def e_top_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cut(_importance(spark, sf_dir).select("id", "importance"))
    return evaluation.top_percent(own.withColumn("id", named("id")), 0.5, own.count())


def e_coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, _DOCS).select(F.col("doc_id").alias("id"), F.size(F.split("text", "\n")).alias("importance"), C.token_estimate("text").alias("tokens"))
    return evaluation.coverage_curve(ranked, "tokens")


def e_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.enrichment_estimate(table(spark, sf_dir, _DOCS).select(C.token_estimate("text").alias("tokens")), "tokens", 2)


QUERIES = {
    f.__name__: f
    for f in (
        s_bm25_topk, s_knn, s_similar_to, s_rrf, s_overlay, t_budget_fit, t_fit_lines, g_cochange, g_cochange_capped, g_filegraph, g_communities, g_cohesion,
        g_surprise, g_scc, m_reflect, m_class_counts, b_recall_mrr, b_grep_tokens, b_savings, b_median, e_importance, e_top_percent, e_coverage_curve, e_cost,
    )
}

_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_EST = "CAST(ceil(length(coalesce({}, '')) / 3.5::DOUBLE) AS BIGINT)"


def _bm25(where: str = "true") -> str:
    return f"""qw AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK}[1:6]) AS term FROM benchmark WHERE {where}),
dt AS (SELECT doc_id, {_TOK} AS t FROM documents), sz AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM dt),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM dt) WHERE term IN (SELECT term FROM qw) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, doc_id AS id, sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) AS score
FROM tf JOIN df USING (term) JOIN qw USING (term), sz GROUP BY ALL),
lex AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, id, score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 20)"""


_COS = "round(1 - least(greatest(list_inner_product(q.e, c.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.e, c.e))), -1.0::DOUBLE), 1.0::DOUBLE), 9)"


def _knn(queries: str, rows: str = "true", k: int = 20) -> str:
    return f"""v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {rows}),
nn AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_COS} AS distance FROM v q, v c WHERE q.vec_id <> c.vec_id AND q.{queries}),
vec AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, id, distance FROM nn QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= {k})"""


_FUSED = f"WITH {_bm25()}, {_knn('vec_id % 100 = 0')}, fu AS (SELECT query_id, id, sum(part) AS score FROM (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS part FROM lex UNION ALL SELECT query_id, id, 0.1::DOUBLE / (60 + rank) FROM vec) GROUP BY ALL)"
_FILES = f"WITH {SQL_NODES},{SQL_EDGES}, fl AS (SELECT a.path AS from_path, b.path AS to_path, edge_type FROM edges JOIN nodes a ON a.id = from_id JOIN nodes b ON b.id = to_id WHERE edge_type IN (5,6)), fg AS (SELECT least(from_path, to_path) AS a, greatest(from_path, to_path) AS b, sum(CASE edge_type WHEN 5 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END) AS weight FROM fl WHERE from_path <> to_path GROUP BY ALL), mem AS (SELECT path AS file, s_nationkey AS community FROM nodes JOIN supplier ON key = s_suppkey WHERE kind = 'file')"
_SIGNALS = """WITH s AS (SELECT user_id AS node, ts AS moment, event_type = 'error' AS neg, pow(0.5::DOUBLE, greatest((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400e6::DOUBLE, 0) / 7.0::DOUBLE) >= 0.25 AS fresh FROM events WHERE event_type IN ('purchase','signup','error')),
g AS (SELECT node, count(*) FILTER (WHERE fresh AND NOT neg) AS useful, count(*) FILTER (WHERE fresh AND neg) AS negative, count(*) FILTER (WHERE NOT fresh) AS faded, max(struct_pack(moment, neg)) FILTER (WHERE fresh) AS newest FROM s GROUP BY node),
c AS (SELECT node, useful, negative, faded, CASE WHEN newest.neg THEN 'negative' WHEN NOT newest.neg THEN 'useful' END AS latest, CASE WHEN useful > 0 AND negative > 0 THEN 'contested' WHEN negative > 0 THEN 'dead_end' WHEN useful >= 2 THEN 'preferred' WHEN useful = 1 THEN 'tentative' END AS lesson FROM g),
r AS (SELECT *, CASE WHEN lesson = 'contested' THEN latest END AS leaning FROM c)"""
_IMPORTANCE = f"WITH {SQL_NODES},{SQL_EDGES}, h AS (SELECT from_id AS id, edge_type FROM edges WHERE edge_type <> 3 UNION ALL SELECT to_id, edge_type FROM edges WHERE edge_type <> 3), im AS (SELECT id, count(*) FILTER (WHERE edge_type NOT IN (0, 6)) AS degree, count(*) FILTER (WHERE edge_type = 0) AS requirements, count(*) FILTER (WHERE edge_type = 6) AS cochange, degree + 50 * requirements + cochange AS importance FROM h GROUP BY id)"

ORACLE_SQL = {
    "s_bm25_topk": f"WITH {_bm25()} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM lex",
    "s_knn": f"WITH {_knn('vec_id % 100 = 0')} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(distance, 6) AS distance FROM vec",
    "s_similar_to": f"WITH {_knn('vec_id >= 0', k=3)} SELECT query_id AS id, id AS other, CAST(round((1 - distance) * 15) AS INTEGER) AS similarity15 FROM vec WHERE 1 - distance >= 0.25",
    "s_rrf": f"{_FUSED} SELECT query_id, id, round(score, 6) AS score FROM fu",
    "s_overlay": f"{_FUSED}, l AS (SELECT doc_id AS id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id) SELECT query_id, id, round(score * CASE WHEN bad THEN 0.5::DOUBLE WHEN good THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM fu LEFT JOIN l USING (id)",
    "t_budget_fit": f"WITH t AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS tier, {_EST.format('text')} AS cost FROM conversations), u AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY conv_id ORDER BY tier, turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM t) SELECT conv_id, turn, tier, cost, used FROM u WHERE used <= 360",
    "t_fit_lines": f"""WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
c AS (SELECT doc_id, pos, sum({_EST.format('line')} + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
s AS (SELECT *, min(CASE WHEN pos > 1 AND (used > 270 OR (pos <> n AND used + 12 > 270)) THEN pos END) OVER (PARTITION BY doc_id) AS stop FROM c)
SELECT doc_id, count(*) AS kept, CAST(max(used) AS BIGINT) AS used FROM s WHERE stop IS NULL OR pos < stop GROUP BY doc_id""",
    "g_cochange": "WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 180 DAYS FROM orders)) SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS n FROM p x JOIN p y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY ALL",
    "g_filegraph": f"{_FILES} SELECT a, b, weight FROM fg",
    "g_cohesion": f"""{_FILES}, x AS (SELECT m.community AS ca, n.community AS cb, weight FROM fg JOIN mem m ON m.file = a JOIN mem n ON n.file = b),
h AS (SELECT ca AS community, CASE WHEN ca = cb THEN weight ELSE 0 END AS i, CASE WHEN ca <> cb THEN weight ELSE 0 END AS o FROM x UNION ALL SELECT cb, 0, weight FROM x WHERE ca <> cb),
s AS (SELECT community, sum(i) AS internal, sum(o) AS crossing FROM h GROUP BY community)
SELECT community, files, internal, crossing, round(internal / (internal + crossing), 2) AS cohesion, internal / (internal + crossing) < 0.3 AS fragile FROM s JOIN (SELECT community, count(*) AS files FROM mem GROUP BY community) USING (community)""",
    "g_surprise": f"""{_FILES}, x AS (SELECT DISTINCT from_path, to_path, m.community AS ca, n.community AS cb, string_split(from_path, '/')[1] AS da, string_split(to_path, '/')[1] AS db FROM fl JOIN mem m ON m.file = from_path JOIN mem n ON n.file = to_path WHERE edge_type = 5 AND m.community <> n.community),
l AS (SELECT least(ca, cb) AS lo, greatest(ca, cb) AS hi, count(*) AS links FROM x GROUP BY ALL), w AS (SELECT da, db, count(*) AS f FROM x GROUP BY ALL),
y AS (SELECT from_path, to_path, round(1 / (1 + links) + CASE WHEN x.da = x.db THEN 0 ELSE 1 / (1 + w.f) END, 3) AS score FROM x JOIN l ON lo = least(ca, cb) AND hi = greatest(ca, cb) JOIN w ON w.da = x.da AND w.db = x.db
LEFT JOIN w r ON r.da = x.db AND r.db = x.da WHERE NOT (x.da <> x.db AND w.f >= 10 AND w.f > 3 * coalesce(r.f, 0)))
SELECT from_path, to_path, score FROM y ORDER BY score DESC, from_path, to_path LIMIT 10""",
    "m_reflect": f"{_SIGNALS} SELECT node, useful, negative, faded, latest, lesson, leaning FROM r",
    "m_class_counts": f"{_SIGNALS} SELECT lesson, leaning, count(*) AS n FROM r GROUP BY ALL",
    "b_recall_mrr": f"""WITH {_bm25()}, ex AS (SELECT DISTINCT item_id AS query_id, doc_id AS id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)))
SELECT ex.query_id, round(count(*) FILTER (WHERE rank <= 5) / count(*), 6) AS recall_at_5, round(count(*) FILTER (WHERE rank <= 10) / count(*), 6) AS recall_at_10, round(coalesce(1 / min(rank), 0), 6) AS reciprocal_rank FROM ex LEFT JOIN lex ON lex.query_id = ex.query_id AND lex.id = ex.id GROUP BY ex.query_id""",
    "b_grep_tokens": rf"""WITH t AS (SELECT item_id AS query_id, list_filter(string_split(regexp_replace(text, '[^\p{{L}} ]', ' ', 'g'), ' '), lambda w: length(w) >= 8)[1] AS term FROM benchmark),
l AS (SELECT doc_id, {_EST.format('text')} AS whole, unnest(string_split(text, chr(10))) AS line FROM documents),
e AS (SELECT query_id, doc_id, count(*) AS lines, sum({_EST.format('line')} + 1) AS tokens, min(whole) AS whole FROM l JOIN t ON contains(line, term) WHERE term IS NOT NULL GROUP BY ALL)
SELECT query_id, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(tokens) AS BIGINT) AS line_tokens, count(*) AS files, CAST(sum(whole) AS BIGINT) AS file_tokens FROM e GROUP BY query_id""",
    "b_savings": f"WITH c AS (SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN {_EST.format('text')} ELSE 0 END) AS BIGINT) AS cost, CAST(sum({_EST.format('text')}) AS BIGINT) AS baseline FROM conversations GROUP BY conv_id) SELECT conv_id, cost, baseline, round(CASE WHEN baseline = 0 THEN 0 ELSE 1 - cost / baseline END, 6) AS saved FROM c",
    "b_median": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, value AS median FROM r WHERE pos = n // 2",
    "e_importance": f"{_IMPORTANCE} SELECT id, degree, requirements, cochange, importance FROM im",
    "e_top_percent": f"{_IMPORTANCE} SELECT id, importance FROM im QUALIFY row_number() OVER (ORDER BY importance DESC, id) <= (SELECT greatest(1, ceil(count(*) * 0.5::DOUBLE / 100)) FROM im)",
    "e_coverage_curve": f"WITH d AS (SELECT doc_id AS id, len(string_split(text, chr(10))) AS importance, {_EST.format('text')} AS tokens FROM documents), p AS (SELECT *, row_number() OVER (ORDER BY importance DESC, id) AS place, count(*) OVER () AS n FROM d), s AS (SELECT unnest([20, 50, 100]) AS share) SELECT share, count(*) AS files, CAST(sum(tokens) AS BIGINT) AS tokens FROM p, s WHERE place <= greatest(1, ceil(n * share / 100)) GROUP BY share",
    "e_cost": f"SELECT CAST(ceil(count(*) / 8) * 220 + sum({_EST.format('text')} + 18) AS BIGINT) AS input_tokens, CAST(count(*) * 134 AS BIGINT) AS output_tokens FROM documents",
}
