"""The ten operators as queries over whole tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, lines, packing, quality, secretscan, simhash, substring, tokencount, topk
from . import toxicity as toxic
from .common import read


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment: benchmark items that documents hold."""
    found = decontamination.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.col("n_found").cast("long").alias("n_found"), F.round(F.col("n_found") / F.col("n_shingles"), 6).alias("containment"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.integer_vectors(read(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens: the pieces of a 32,000-piece vocabulary taken as a unigram model."""
    import public_tokenizers

    pieces, skipped = tokencount.model_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return tokencount.token_counts(read(spark, sf_dir, "documents"), pieces, skipped)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed, removed, kept_sha256: the sentences and spans that go, and the kept text's SHA-256."""
    out = substring.dedup_substrings(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_removed", F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"], r["end"])), ",").alias("removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.groups(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, keep."""
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secretscan.scan(read(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != secretscan.NOVEL)
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_topk, op3_token_counts, op4_packing, op5_substring_dedup,
        op6_line_dedup, op7_simhash, op8_quality, op9_secrets, op10_toxicity,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
i AS (SELECT item_id, row_number() OVER () AS item, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
iw AS (SELECT item_id, item, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM iw),
s AS (SELECT DISTINCT item_id, item, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS g FROM iw),
n AS (SELECT item, count(*) AS n_shingles FROM s GROUP BY item),
ds AS (SELECT DISTINCT doc_id, r, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS g FROM d, ks),
f AS (SELECT doc_id, item_id, r, item, count(*) AS n_found FROM ds JOIN s USING (k, g) GROUP BY doc_id, item_id, r, item),
b AS (SELECT doc_id, item_id, n_shingles, n_found, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_found / n_shingles DESC, n_shingles DESC) AS o
FROM f JOIN n USING (item) WHERE n_found >= ceil(0.8 * n_shingles - 1e-9))
SELECT doc_id, item_id, n_shingles, n_found, round(n_found / n_shingles, 6) AS containment FROM b WHERE o = 1""",
    "op2_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op6_line_dedup": rf"""
WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM l),
g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT doc_id, pos, line, g.key IS NOT NULL AND doc_id <> top AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
}
