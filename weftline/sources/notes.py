"""Notes on how answers turned out: Markdown files with front matter, written one by one and read as a table."""

from __future__ import annotations

import hashlib
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOMES = ("useful", "dead_end", "corrected")


def write(folder: str, question: str, outcome: str, nodes: list[tuple[str, str]], at: int, answer: str = "", correction: str | None = None, kind: str = "query") -> str:
    """Write a note and give its id, ten hex characters of what was asked, how it went and which nodes it cites."""
    question, correction = question.strip(), (correction or "").strip()
    if not question:
        raise ValueError("a note has a question")
    if outcome not in OUTCOMES:
        raise ValueError(f"an outcome is one of {', '.join(OUTCOMES)}")
    if (outcome == "corrected") != bool(correction):
        raise ValueError("a corrected answer, and only that, has a correction")
    cited = sorted({i: " ".join(label.split()) for i, label in nodes}.items())
    own = hashlib.sha256("\n".join([question, outcome, *[i for i, _ in cited]]).encode()).hexdigest()[:10]
    moment = datetime.fromtimestamp(at, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = ["---", f"id: {own}", f"at: {moment}", f"type: {kind}", f"outcome: {outcome}", "nodes:", *[f"  - {i} {label}" for i, label in cited], "---", "", "## Question", "", question, "", "## Answer", "", answer.strip()]
    lines += ["", "## Correction", "", correction] if correction else []
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{own}.md.tmp", "w") as f:
        f.write("\n".join(lines) + "\n")
    os.replace(f"{folder}/{own}.md.tmp", f"{folder}/{own}.md")
    return own


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """(id, at, kind, outcome, nodes array<struct<id, label>>, question, answer, correction), and how many files couldn't be read."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.regexp_replace("value", "\r\n", "\n").alias("v"))
    front, body = F.regexp_extract("v", r"(?s)\A---\n(.*?)\n---\n", 1), F.regexp_extract("v", r"(?s)\A---\n.*?\n---\n(.*)", 1)
    field = lambda name: F.trim(F.regexp_extract(front, rf"(?m)^{name}:(.*)$", 1))
    part = lambda name: F.regexp_replace(F.regexp_extract(body, rf"(?s)## {name}\n\n(.*?)(?:\n## |\z)", 1), r"^\s+|\s+$", "")
    items = F.regexp_extract_all(front, F.lit(r"(?m)^  - (.*)$"), F.lit(1))
    nodes = F.transform(items, lambda x: F.struct(F.split(x, " ", 2)[0].alias("id"), F.coalesce(F.get(F.split(x, " ", 2), F.lit(1)), F.lit("")).alias("label")))
    at = F.try_to_timestamp(field("at"), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    found = rows.select(field("id").alias("id"), at.alias("at"), field("type").alias("kind"), field("outcome").alias("outcome"), nodes.alias("nodes"), part("Question").alias("question"), part("Answer").alias("answer"), F.nullif(part("Correction"), F.lit("")).alias("correction"))
    good = (F.col("id") != "") & F.col("at").isNotNull() & (F.col("kind") != "") & F.col("outcome").isin(*OUTCOMES) & (F.col("question") != "")
    return found.where(good), found.where(~F.coalesce(good, F.lit(False))).count()


def signals(notes: DataFrame) -> DataFrame:
    """(node, at, outcome): one for each node that a note cites, for reflection."""
    return notes.select(F.explode("nodes").alias("n"), "at", "outcome").select(F.col("n.id").alias("node"), "at", "outcome")
