"""Scalar functions over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import words as W
from .starschema import table


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


def s_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier parts of part names, brands and types, and of customers' names."""
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    camel = lambda c: F.regexp_replace(F.initcap(F.lower(c)), " ", "")
    names = part.select(F.col("p_brand").alias("name")).union(part.select(camel(F.col("p_type")))).union(part.select("p_name")).union(customer.select("c_name"))
    return names.distinct().select("name", F.array_join(C.identifier_tokens("name"), " ").alias("tokens"))


def s_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", C.without_stopwords("text").alias("kept"))


def s_seed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", C.seed_terms("text").alias("kept"))


def s_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", C.is_prose("text").alias("prose"), C.summary_weight("text").alias("weight"))


def s_dependents_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which questions ask for dependents; the question is built so that a third does."""
    text = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("What USES "), F.col("text"))).otherwise(F.col("text"))
    return _asked(spark, sf_dir).select("conv_id", "turn", C.asks_for_dependents(text).alias("asks"))


def t_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.token_estimate("text").alias("tokens"))


def f_embed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand").distinct().select(F.col("p_brand").alias("name"), C.embed_words("p_brand").alias("words"))


def f_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_type").distinct().select(F.col("p_type").alias("name"), C.slug("p_type").alias("slug"))


def f_sql_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of each spelling, over the parts' sizes as lengths."""
    spelled = table(spark, sf_dir, "part").select("p_size").distinct().select(F.explode(F.array(*[F.concat(F.lit(t), F.lit(" ("), F.col("p_size"), F.lit(")")) for t in ("Character Varying", "VARCHAR", "bpchar", "NUMERIC", "text")])).alias("spelled"))
    return spelled.select("spelled", C.normalize_sql_type("spelled").alias("plain"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("fix REQ-"), F.col("o_custkey"), F.lit(" and TASK-UI-"), F.col("o_orderkey"), F.lit("b, see ADR-7x REQ- TASK-a1"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("message"))


def x_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every marker of commit messages made from the orders."""
    own = _messages(spark, sf_dir).select("o_orderkey", F.posexplode(C.find_markers("message")).alias("place", "marker"))
    return own.select("o_orderkey", "place", "marker")


def _sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", 'token = "', 'auth_token = "').alias("text"))


def x_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sensitive(spark, sf_dir).select("doc_id", C.find_secret("text").alias("kind"))


def x_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sensitive(spark, sf_dir).select("doc_id", F.sha2(C.redact_secrets("text"), 256).alias("redacted_sha256"))


def x_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.snippet("text", 200).alias("snippet"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def x_url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of all pages and links, with numeric segments turned into parameters first."""
    both = table(spark, sf_dir, "pages").select(F.col("url").alias("raw")).union(_links(spark, sf_dir).select("href")).distinct()
    return both.select("raw", C.normalize_url_path(F.regexp_replace("raw", r"/([0-9]+)", "/:$1")).alias("path"))


def x_paths_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served paths with and without an API prefix, against the plain path."""
    own = table(spark, sf_dir, "pages").select(C.normalize_url_path("url").alias("path")).distinct()
    prefix = F.explode(F.array(F.lit(""), F.lit("/api"), F.lit("/api/v2"), F.lit("/apis"), F.lit("/v"))).alias("prefix")
    return own.select("path", prefix).select("path", "prefix", C.paths_match(F.concat("prefix", "path"), F.col("path")).alias("matches"))


def x_href_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each page links to each path."""
    return _links(spark, sf_dir).groupBy("page_id", C.normalize_url_path("href").alias("path")).agg(F.count(F.lit(1)).alias("n"))


def f_file_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context, language, noise and eligibility of paths made from the parts' numbers."""
    forms = ["src/m/f{}.ts", "src/m/f{}.spec.ts", "tests/f{}.py", "a/__tests__/f{}.js", "web/e2e/f{}.test.tsx", "spec/f{}.go", "img/f{}.PNG", "vendor/f{}.rs", "f{}.min.js", ".env.f{}", "docs/f{}.md", "f{}"]
    paths = F.explode(F.array(*[F.concat(F.lit(f.split("{}")[0]), F.col("p_partkey"), F.lit(f.split("{}")[1])) for f in forms])).alias("path")
    own = table(spark, sf_dir, "part").select(paths)
    return own.select("path", C.file_context("path").alias("context"), C.language("path").alias("language"), C.is_noise("path").alias("noise"), C.is_eligible("path").alias("eligible"))


QUERIES = {f.__name__: f for f in (s_tokenize, s_stopwords, s_seed_terms, s_prose, s_dependents_intent, t_estimate, f_embed_words, f_slug, f_sql_types, x_markers, x_secret_scan, x_redact, x_snippet, x_url_normalize, x_paths_match, x_href_edges, f_file_context)}

_list = lambda xs: "[" + ",".join(f"'{x}'" for x in xs) + "]"
_W = r"list_filter(string_split_regex(trim(text), '\s+'), lambda w: w <> '')"
_BARE = r"lower(regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))"
_STOP = f"list_filter({_W}, lambda w: NOT list_contains({_list(W.STOPWORDS)}, {_BARE}))"
_FILL = f"list_filter({_W}, lambda w: NOT list_contains({_list(W.FILLER)}, {_BARE}) AND {_BARE} <> '')"
_KEPT = f"CASE WHEN len({_W}) < 3 OR len({_STOP}) = 0 THEN text ELSE array_to_string({_STOP}, ' ') END"
_EDGE = "[^A-Za-z0-9_-]"
_NAMES = "|".join(W.CREDENTIAL_NAMES)
_LITERAL = rf"""(?i:{_NAMES})[A-Za-z0-9_"'' ]*\s*[=:]\s*("[^"\n ]{{8,}}"|''[^''\n ]{{8,}}''|`[^`\n ]{{8,}}`)"""
_TEXTS = """WITH d AS (SELECT doc_id, replace(text, 'token = "', 'auth_token = "') AS text FROM documents)"""
_TOKENS = {"AWS access key": "AKIA[A-Z0-9]{16}", "Google API key": "AIza[A-Za-z0-9_-]{35,}", "GitHub token": "(gh[pos]_[A-Za-z0-9_-]{30,}|github_pat_[A-Za-z0-9_-]{30,})", "API secret key": "sk-[A-Za-z0-9_-]{20,}", "Slack token": "xox[baprs][A-Za-z0-9_-]{17,}"}
_KIND = "CASE WHEN contains(text, '-----BEGIN') AND contains(text, 'PRIVATE KEY-----') THEN 'private key' " + " ".join(f"WHEN regexp_matches(text, '(^|{_EDGE}){p}($|{_EDGE})') THEN '{k}'" for k, p in _TOKENS.items()) + f" WHEN regexp_matches(text, '{_LITERAL}') THEN 'hard-coded credential' END"
_REDACT = "text"
for _p in _TOKENS.values():
    _REDACT = f"regexp_replace({_REDACT}, '(^|{_EDGE}){_p.replace('(', '(?:')}($|{_EDGE})', '\\1[REDACTED]\\2', 'g')"
_REDACT = rf"""regexp_replace({_REDACT}, '((?i:{_NAMES})[A-Za-z0-9_"'' ]*\s*[=:]\s*)"[^"\n ]{{8,}}"', '\1"[REDACTED]"', 'g')"""


def _path(raw: str) -> str:
    bare = f"CASE WHEN contains(trim({raw}), '://') THEN regexp_extract(trim({raw}), '^.*?://[^/]*(/.*)?$', 1) ELSE trim({raw}) END"
    kept = rf"list_filter(string_split(regexp_replace({bare}, '(?s)[?#].*$', ''), '/'), lambda s: s <> '')"
    return rf"'/' || array_to_string(list_transform({kept}, lambda s: CASE WHEN regexp_matches(s, '^[{{:]|^<.*>$|\$\{{') THEN '{{}}' ELSE s END), '/')"


_PARTS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(r, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')"
_INITCAP = "array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), '')"
_LINKS = """links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)"""

ORACLE_SQL = {
    "s_tokenize": f"""WITH n AS (SELECT p_brand AS name FROM part UNION SELECT {_INITCAP} FROM part UNION SELECT p_name FROM part UNION SELECT c_name FROM customer)
SELECT name, array_to_string(list_transform(regexp_extract_all(name, '[A-Za-z0-9]+'), lambda r: CASE WHEN contains({_PARTS}, ' ') THEN lower(r) || ' ' || lower({_PARTS}) ELSE lower(r) END), ' ') AS tokens FROM n""",
    "s_stopwords": f"SELECT conv_id, turn, {_KEPT} AS kept FROM conversations",
    "s_seed_terms": f"SELECT conv_id, turn, CASE WHEN len({_FILL}) = 0 THEN text ELSE array_to_string({_FILL}, ' ') END AS kept FROM conversations",
    "s_prose": rf"""WITH k AS (SELECT conv_id, turn, text AS whole, {_KEPT} AS text FROM conversations),
p AS (SELECT conv_id, turn, len({_W}) <> len({_W.replace("text", "whole")}) AND len({_W}) >= 3 AND len(list_filter({_W}, lambda w: regexp_matches(w, '[_/\\.:0-9]|\p{{Ll}}\p{{Lu}}'))) = 0 AS prose FROM k)
SELECT conv_id, turn, prose, CASE WHEN prose THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM p""",
    "s_dependents_intent": f"""WITH t AS (SELECT conv_id, turn, lower(CASE WHEN conv_id % 3 = 0 THEN 'What USES ' || text ELSE text END) AS text FROM conversations)
SELECT conv_id, turn, len(list_filter({_list(W.DEPENDENT_PHRASES)}, lambda p: contains(text, p))) > 0 AS asks FROM t""",
    "t_estimate": "SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 3.5::DOUBLE) AS BIGINT) AS tokens FROM documents",
    "f_embed_words": r"SELECT DISTINCT p_brand AS name, trim(lower(regexp_replace(regexp_replace(p_brand, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))) AS words FROM part",
    "f_slug": "SELECT DISTINCT p_type AS name, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part",
    "f_sql_types": """WITH s AS (SELECT DISTINCT p_size FROM part), t AS (SELECT * FROM (VALUES ('Character Varying','varchar'), ('VARCHAR','varchar'), ('bpchar','char'), ('NUMERIC','numeric'), ('text','text')) v(a, b))
SELECT a || ' (' || p_size || ')' AS spelled, b || '(' || p_size || ')' AS plain FROM s, t""",
    "x_markers": """WITH m AS (SELECT o_orderkey, ['REQ-' || o_custkey, 'TASK-UI-' || o_orderkey || 'b', 'ADR-7x'] AS k FROM orders)
SELECT o_orderkey, CAST(generate_subscripts(k, 1) - 1 AS INTEGER) AS place, unnest(k) AS marker FROM m""",
    "x_secret_scan": f"{_TEXTS} SELECT doc_id, {_KIND} AS kind FROM d",
    "x_redact": f"{_TEXTS} SELECT doc_id, sha256({_REDACT}) AS redacted_sha256 FROM d",
    "x_snippet": """WITH h AS (SELECT doc_id, text, text[1:200] AS head FROM documents), a AS (SELECT *, length(head) - position(chr(10) IN reverse(head)) AS cut FROM h)
SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN contains(head, chr(10)) AND strlen(head[1:cut]) > floor(strlen(head) / 2) THEN head[1:cut] ELSE head END AS snippet FROM a""",
    "x_url_normalize": f"""WITH {_LINKS}, r AS (SELECT url AS raw FROM pages UNION SELECT href FROM links), n AS (SELECT raw, regexp_replace(raw, '/([0-9]+)', '/:\\1', 'g') AS x FROM r)
SELECT raw, {_path("x")} AS path FROM n""",
    "x_paths_match": f"""WITH p AS (SELECT DISTINCT {_path("url")} AS path FROM pages), x AS (SELECT unnest(['', '/api', '/api/v2', '/apis', '/v']) AS prefix)
SELECT path, prefix, prefix IN ('', '/api', '/api/v2') AS matches FROM p, x""",
    "x_href_edges": f"WITH {_LINKS} SELECT page_id, {_path('href')} AS path, count(*) AS n FROM links GROUP BY 1, 2",
    "f_file_context": """WITH f AS (SELECT * FROM (VALUES ('src/m/f','.ts',0,'typescript',false,true), ('src/m/f','.spec.ts',3,'typescript',false,true), ('tests/f','.py',2,'python',false,true),
('a/__tests__/f','.js',2,'javascript',false,true), ('web/e2e/f','.test.tsx',2,'tsx',false,true), ('spec/f','.go',0,'go',false,true), ('img/f','.PNG',0,NULL,true,false), ('vendor/f','.rs',0,'rust',false,false),
('f','.min.js',0,'javascript',false,false), ('.env.f','',0,NULL,false,false), ('docs/f','.md',0,NULL,false,true), ('f','',0,NULL,false,false)) v(a, b, context, language, noise, eligible))
SELECT a || p_partkey || b AS path, context, language, noise, eligible FROM f, part""",
}
