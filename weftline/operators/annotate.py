"""Annotations: what people and agents concluded about nodes, as a JSON-lines file; notes that show beside answers."""

from __future__ import annotations

import hashlib
import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import graph

SCHEMA = "id string, target string, label string, note string, relation string, to string, outcome string, author string, model string, at string, source_hash string, confidence string, _bad string"
MAX_NOTE, MAX_LABEL, INLINE, INLINE_CHARS = 500, 120, 2, 160
OUTCOMES, AUTHORS = ("useful", "dead_end", "corrected"), ("agent", "user")


def make(spark: SparkSession, target: str, at: int, label: str | None = None, note: str | None = None, relation: str | None = None, to: str | None = None, outcome: str | None = None, author: str = "user", model: str | None = None, source_hash: str | None = None) -> dict:
    """A valid annotation; the same words about the same target have the same id."""
    label, note, relation, to, outcome = ((x or "").strip() or None for x in (label, note, relation, to, outcome))
    if not any((label, note, relation, outcome)):
        raise ValueError("an annotation says something: a label, a note, a relation or an outcome")
    for what, text, most in (("note", note, MAX_NOTE), ("label", label, MAX_LABEL)):
        if text and len(text) > most:
            raise ValueError(f"the {what} has {len(text)} characters, at most {most} are kept")
        kind = spark.createDataFrame([(text,)], "t string").select(C.find_secret("t")).first()[0] if text else None
        if kind:
            raise ValueError(f"the {what} looks like it holds a secret ({kind})")
    if (relation is None) != (to is None):
        raise ValueError("a relation needs what it leads to, and the other way round")
    if relation:
        graph.relation_codes([relation])
    if outcome and outcome not in OUTCOMES:
        raise ValueError(f"an outcome is one of {', '.join(OUTCOMES)}")
    if author not in AUTHORS:
        raise ValueError(f"an author is one of {', '.join(AUTHORS)}")
    words = "\n".join(x or "" for x in (target, label, note, relation, to, outcome))
    own = {"id": hashlib.sha256(words.encode()).hexdigest()[:10], "target": target, "label": label, "note": note, "relation": relation, "to": to, "outcome": outcome, "author": author, "model": model}
    own |= {"at": datetime.fromtimestamp(at, UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "source_hash": source_hash, "confidence": "INFERRED"}
    return {k: v for k, v in own.items() if v is not None}


def load(path: str) -> tuple[list[dict], int]:
    """Annotations of a file, and how many lines couldn't be read."""
    found, bad = [], 0
    if os.path.exists(path):
        with open(path) as f:
            for line in f:
                try:
                    row = json.loads(line)
                    found.append(row) if {"id", "target", "at"} <= row.keys() else None
                    bad += not {"id", "target", "at"} <= row.keys()
                except (ValueError, AttributeError):
                    bad += bool(line.strip())
    return found, bad


def save(path: str, rows: list[dict]) -> None:
    """Sorted by target, moment and id; replaced in one step."""
    with open(f"{path}.tmp", "w") as f:
        for r in sorted(rows, key=lambda r: (r["target"], r["at"], r["id"])):
            f.write(json.dumps(r, sort_keys=True, ensure_ascii=False) + "\n")
    os.replace(f"{path}.tmp", path)


def add(path: str, row: dict) -> None:
    rows, _ = load(path)
    save(path, [r for r in rows if r["id"] != row["id"]] + [row])


def remove(path: str, id_: str) -> bool:
    rows, _ = load(path)
    left = [r for r in rows if r["id"] != id_]
    save(path, left)
    return len(left) < len(rows)


def frame(spark: SparkSession, path: str) -> DataFrame:
    rows, _ = load(path)
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")][:-1]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMA.rsplit(",", 1)[0])


def graph_of(annotations: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of annotations with their state; relations are inferred edges of context 4, and dangling ones are left out."""
    from .memory import annotation_state

    own = annotation_state(annotations, nodes).withColumn("node", C.stable_id("annotation", "id"))
    made = own.select(F.col("node").alias("id"), F.lit("annotation").alias("kind"), F.coalesce("label", F.substring("note", 1, 60), F.concat_ws(" ", "relation", "to"), "outcome").alias("label"), "note", "author", "at", "state", "outcome", "target")
    there = own.where("state <> 'dangling'")
    meta = F.lit(1 | 4 << 1).cast("int").alias("meta")
    edges = there.select(F.col("target").alias("from_id"), F.col("node").alias("to_id"), F.lit(11).cast("int").alias("edge_type"), meta)
    code = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(graph.W.RELATIONS) for x in (r, i)]), F.lower(F.regexp_replace("relation", "-", "_")))
    said = there.where("relation IS NOT NULL").select(F.col("target").alias("from_id"), F.col("to").alias("to_id"), code.cast("int").alias("edge_type"), meta)
    return made, edges.union(said)


def inline(made: DataFrame) -> DataFrame:
    """(target, notes): each target's two newest fresh annotations in one line of at most 160 characters."""
    text = F.when(F.col("note").isNull(), F.coalesce("label", "outcome")).when(F.col("label") == F.substring("note", 1, 60), F.col("note")).otherwise(F.concat_ws(": ", "label", "note"))
    newest = Window.partitionBy("target").orderBy(F.desc("at"), "id")
    own = made.where("state = 'fresh'").withColumn("text", text).withColumn("place", F.row_number().over(newest)).where(F.col("place") <= INLINE)
    line = own.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " | ").alias("line"))
    return line.select("target", F.when(F.char_length("line") > INLINE_CHARS, F.concat(F.substring("line", 1, INLINE_CHARS), F.lit("…"))).otherwise(F.col("line")).alias("notes"))
