"""A corpus pipeline: quality, line and near-duplicate filters, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and gives the documents that go on, of the same columns whatever their
names; the last gives the packed pieces. Stages decide on rows: rows of one doc_id with other texts, and rows
without a doc_id, are judged by their own texts. Null and empty texts are kept by the first two stages, one row of
them by the third, and packed as an end mark alone. An empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontamination, lines, nearcopies, packing, quality
from weftline.llm.common import read, saved


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier doesn't reject; a language without trusted text has no model and stays."""
    return quality.kept(docs, read(spark, sf_dir, "labels"))


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without the lines that many documents share; n_chars follows the text. Rows without a doc_id lose none."""
    out = lines.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a similarity of 0.8 in 5-word shingles: of the least doc_id; rows alike count once.

    The trie join of SimHash fingerprints and MinHash bands find the pairs, which are verified on the texts.
    """
    return nearcopies.kept(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item, with or without a doc_id."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in windows of 1024 ids."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", by_quality),
    ("line_dedup", without_shared_lines),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: The perplexity model and the tokenizer can't be told in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's documents are written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
