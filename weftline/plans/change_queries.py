"""Differences, repositories and streams over the tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import diff
from ..operators.lineage import shared_dir
from ..streaming import feeds
from .starschema import table


def _before(spark: SparkSession, sf_dir: str, until: str) -> DataFrame:
    """What each customer had ordered until a date."""
    return table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(until).cast("timestamp")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))


def g_report_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.changes(_before(spark, sf_dir, "1998-01-01"), _before(spark, sf_dir, "1998-07-01"), ["o_custkey"], ["orders"])


def g_top_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who entered and left the ten best customers between two dates."""
    top = lambda until: _before(spark, sf_dir, until).orderBy(F.desc("orders"), "o_custkey").limit(10)
    return diff.entered_left(top("1998-01-01"), top("2000-01-01"), "o_custkey")


def g_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a desired schema, customers as the live one: tables are nations, columns are keys."""
    want = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("table"), F.col("s_suppkey").alias("column"), (F.col("s_acctbal") > 0).cast("string").alias("type"))
    have = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("table"), F.col("c_custkey").alias("column"), (F.col("c_acctbal") > 0).cast("string").alias("type"))
    return diff.drift(want, have)


def g_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by nation against by thousand of balance: merged and split groups."""
    own = table(spark, sf_dir, "supplier")
    old = own.select(F.col("s_suppkey").alias("file"), F.col("s_nationkey").cast("long").alias("community"))
    new = own.select(F.col("s_suppkey").alias("file"), (F.col("s_suppkey") % 3).alias("community"))
    out = diff.moved(old, new)
    return out.select("kind", "community", F.array_join("parts", ",").alias("parts"))


def gl_merge_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each segment as a repository loaded twice; their nations are communities."""
    own = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("repo"), F.col("c_name").alias("id"), F.col("c_nationkey").cast("long").alias("community"))
    loads = own.withColumn("loaded", F.lit(1)).union(own.where("community < 20").withColumn("loaded", F.lit(2)))
    return diff.merge_repositories(loads)


def gl_cross_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between hosts: pages' paths are endpoints of their hosts, links with an API prefix are calls."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "://([^/]+)", 1)
    endpoints = pages.select(host.alias("repo"), F.lit("GET").alias("method"), C.normalize_url_path("url").alias("path")).distinct()
    calls = endpoints.select(F.concat(F.lit("web-"), "repo").alias("repo"), F.col("path").alias("caller"), "method", F.concat(F.lit("/api/v1"), "path").alias("path"))
    return diff.cross_links(calls, endpoints)


def ex_json_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation nodes as JSON records."""
    own = table(spark, sf_dir, "nation")
    return own.select(C.stable_id("table", "n_nationkey").alias("id"), F.to_json(F.struct(F.lit("table").alias("kind"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("schema"))).alias("json"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream. A stream reads a folder, so a table that is one file is named by a pattern."""
    path = f"{sf_dir}/events.parquet"
    return feeds.source(spark, path if _is_folder(spark, path) else f"{sf_dir}/event[s].parquet", spark.read.parquet(path).schema)


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def _once(stream: DataFrame, mode: str) -> DataFrame:
    return feeds.into_table(stream, mode, f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}")


def st_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type in six-hour windows, streamed."""
    own = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return _once(feeds.windowed(own, "event_type", "ts", "6 hours", None, "30 days"), "complete")


def st_session_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each type of event without a pause of ten minutes, streamed."""
    own = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return _once(feeds.bursts(own, "event_type", "ts", "10 minutes", "30 days"), "complete")


def st_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event for each user and type within the whole stream, counted by type."""
    own = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    kept = own.withWatermark("ts", "60 days").dropDuplicates(["user_id", "event_type"])
    return _once(kept.select("user_id", "event_type"), "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def st_upsert_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user, where errors remove the user; batches go through the versioned sink."""
    own = _events(spark, sf_dir).withColumn("op", F.when(F.col("event_type") == "error", "remove").otherwise("upsert"))
    at = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    sink = feeds.VersionedSink(f"{at}/table")
    query = own.writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return sink.read(spark, "user_id", ["ts", "event_id"], "op").select("user_id", "event_id", "event_type")


QUERIES = {f.__name__: f for f in (g_report_diff, g_top_diff, g_drift, g_moved, gl_merge_repos, gl_cross_links, ex_json_nodes, st_window_counts, st_session_burst, st_dedup, st_upsert_feed)}

_ORDERS = "SELECT o_custkey, count(*) AS orders FROM orders WHERE o_orderdate < TIMESTAMP '{}' GROUP BY o_custkey"
ORACLE_SQL = {
    "g_report_diff": f"""WITH o AS ({_ORDERS.format("1998-01-01")}), n AS ({_ORDERS.format("1998-07-01")})
SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, CASE WHEN o.o_custkey IS NULL THEN 'added' WHEN n.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.o_custkey = n.o_custkey WHERE o.orders IS DISTINCT FROM n.orders""",
    "g_top_diff": f"""WITH o AS (SELECT o_custkey FROM ({_ORDERS.format("1998-01-01")}) ORDER BY orders DESC, o_custkey LIMIT 10), n AS (SELECT o_custkey FROM ({_ORDERS.format("2000-01-01")}) ORDER BY orders DESC, o_custkey LIMIT 10)
SELECT o_custkey, 'entered' AS change FROM n WHERE o_custkey NOT IN (SELECT o_custkey FROM o) UNION ALL SELECT o_custkey, 'left' FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM n)""",
    "g_drift": """WITH w AS (SELECT CAST(s_nationkey AS VARCHAR) AS t, s_suppkey AS c, s_acctbal > 0 AS k FROM supplier), h AS (SELECT CAST(c_nationkey AS VARCHAR) AS t, c_custkey AS c, c_acctbal > 0 AS k FROM customer)
SELECT coalesce(w.t, h.t) AS "table", coalesce(w.c, h.c) AS "column", CASE WHEN h.t IS NULL THEN 'missing' WHEN w.t IS NULL THEN 'extra' ELSE 'different' END AS problem FROM w FULL JOIN h ON w.t = h.t AND w.c = h.c WHERE w.k IS DISTINCT FROM h.k""",
    "g_moved": """WITH s AS (SELECT CAST(s_nationkey AS BIGINT) AS o, s_suppkey % 3 AS n, count(*) AS c FROM supplier GROUP BY ALL), z AS (SELECT o, sum(c) AS t FROM s GROUP BY o), h AS (SELECT o, n, c / t AS share FROM s JOIN z USING (o)),
m AS (SELECT 'merged' AS kind, n AS community, list(o ORDER BY o) AS p FROM h WHERE share >= 0.5 GROUP BY n UNION ALL SELECT 'split', o, list(n ORDER BY n) FROM h WHERE share >= 0.3 GROUP BY o)
SELECT kind, community, array_to_string(p, ',') AS parts FROM m WHERE len(p) >= 2""",
    "gl_merge_repos": """WITH c AS (SELECT c_mktsegment AS repo, c_name, CAST(c_nationkey AS BIGINT) AS community FROM customer WHERE c_nationkey < 20), n AS (SELECT repo, max(community) + 1 AS n FROM c GROUP BY repo),
s AS (SELECT repo, coalesce(sum(n) OVER (ORDER BY repo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM n)
SELECT repo, sha256('repo:' || repo || ':' || c_name) AS id, CAST(community + shift AS BIGINT) AS community FROM c JOIN s USING (repo)""",
    "gl_cross_links": r"""WITH e AS (SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1) AS repo, '/' || array_to_string(list_filter(string_split(regexp_replace(regexp_extract(url, '^.*?://[^/]*(/.*)?$', 1), '[?#].*$', ''), '/'), lambda s: s <> ''), '/') AS path FROM pages)
SELECT DISTINCT 'web-' || c.repo AS from_repo, c.path AS caller, e.repo AS to_repo, e.path FROM e c JOIN e ON e.path = c.path OR (e.path <> '/' AND ends_with('/api/v1' || c.path, e.path) AND regexp_matches(('/api/v1' || c.path)[1:length('/api/v1' || c.path) - length(e.path)], '^/*((api|v[0-9]+)/*)+$'))""",
    "ex_json_nodes": """SELECT sha256('table:' || n_nationkey) AS id, '{"kind":"table","name":"' || n_name || '","schema":' || n_regionkey || '}' AS json FROM nation""",
    "st_window_counts": "SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS began, count(*) AS n FROM events GROUP BY ALL",
    "st_session_burst": """WITH e AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
b AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT event_type, min(ts) AS began, max(ts) + INTERVAL 10 MINUTES AS ended, count(*) AS n FROM b GROUP BY event_type, k""",
    "st_dedup": "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type",
    "st_upsert_feed": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'",
}
