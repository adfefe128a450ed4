"""Summaries of files by a provider that is passed in: what is due, batches, retries, and the cache of results."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .lineage import write_text

SNIPPET, BATCH = 4000, 8
CACHE = "path string, content_hash string, lang string, summary string, model string, prompt_version int, _bad string"


class Provider(Protocol):
    model: str

    def summarise(self, files: list[tuple[str, str]], languages: list[str]) -> dict[str, dict[str, str]]:
        """{path: {language: summary}}; what is missing has failed."""


def content_hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def read_cache(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Cached summaries, and how many lines couldn't be read."""
    if not os.path.exists(path):
        return spark.createDataFrame([], CACHE).drop("_bad"), 0
    rows = spark.read.schema(CACHE).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad").cache()
    return rows.where("_bad IS NULL").drop("_bad"), rows.where("_bad IS NOT NULL").count()


def due(files: DataFrame, cache: DataFrame, languages: list[str]) -> DataFrame:
    """(path, content, langs): eligible files without a summary of what they hold now, and the languages that lack one."""
    own = files.where(C.is_eligible("path") & C.find_secret("content").isNull()).select("path", "content", F.sha2("content", 256).alias("content_hash"))
    want = own.select("*", F.explode(F.array(*[F.lit(x) for x in languages])).alias("lang"))
    missing = want.join(cache.select("path", "content_hash", "lang"), ["path", "content_hash", "lang"], "left_anti")
    return missing.groupBy("path", "content").agg(F.sort_array(F.collect_set("lang")).alias("langs"))


def status(files: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, state): up_to_date, stale (of other content) or pending."""
    own = files.where(C.is_eligible("path")).select("path", F.sha2("content", 256).alias("now"))
    had = cache.groupBy("path").agg(F.collect_set("content_hash").alias("hashes"))
    state = F.when(F.array_contains("hashes", F.col("now")), "up_to_date").when(F.col("hashes").isNotNull(), "stale").otherwise("pending")
    return own.join(had, "path", "left").select("path", state.alias("state"))


def run(todo: DataFrame, make: Callable[[], Provider], batch: int = BATCH) -> DataFrame:
    """(path, content_hash, lang, summary, model): batches of files of the same languages; what fails is tried alone."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for f in frames:
            rows = []
            for langs, own in f.assign(key=f["langs"].map(tuple)).groupby("key"):
                files = [(r.path, head_of(r.content)) for r in own.itertuples()]
                hashes = {r.path: content_hash(r.content) for r in own.itertuples()}
                found: dict = {}
                for i in range(0, len(files), batch):
                    try:
                        found |= provider.summarise(files[i : i + batch], list(langs))
                    except Exception:  # a provider's failure leaves the batch to the second pass
                        continue
                for one in [x for x in files if x[0] not in found]:
                    try:
                        found |= provider.summarise([one], list(langs))
                    except Exception:  # and a file that fails alone stays pending
                        continue
                rows += [(p, hashes[p], lang, s, provider.model) for p, by in found.items() if p in hashes for lang, s in by.items() if lang in langs]
            yield pd.DataFrame(rows, columns=["path", "content_hash", "lang", "summary", "model"])

    return todo.mapInPandas(work, "path string, content_hash string, lang string, summary string, model string")


def head_of(text: str, chars: int = SNIPPET) -> str:
    """The first characters, cut at the last newline if that is past half of them."""
    if len(text) <= chars:
        return text
    at = text[:chars].rfind("\n")
    return text[:at] if at > chars // 2 else text[:chars]


def write_cache(rows: DataFrame, path: str) -> None:
    """Sorted JSON lines, replaced in one step."""
    with open(f"{path}.tmp", "w") as f:
        for r in rows.orderBy("path", "lang").toLocalIterator():
            f.write(json.dumps(r.asDict(), sort_keys=True, ensure_ascii=False) + "\n")
    os.replace(f"{path}.tmp", path)


def prompt(files: list[tuple[str, str]], languages: list[str], words: int = 40) -> str:
    """The request for summaries of files (path, text) in all the languages at once, so the code is sent once."""
    out = (
        f"For each file below, say in one or two sentences of at most {words} words, in each of these languages: {', '.join(languages)}, "
        "what it does, which concepts of its domain it deals with, and what a developer might call them when looking for it. "
        "Write each language as its speakers would; don't quote code. Answer with JSON alone: a list with an object for each file, "
        '{"path": the path as given, "summaries": {language: text}}.\n'
    )
    return out + "".join(f"\n=== FILE: {path} ===\n{text}\n" for path, text in files)


class BadAnswer(ValueError):
    """An answer that isn't a JSON list."""


def parsed(answer: str, paths: list[str], languages: list[str]) -> tuple[dict[str, dict[str, str]], dict[str, str]]:
    """({path: {language: summary}}, {path: why it failed}) of an answer. A file that lacks a language fails whole.

    A language may be spelled with a region (pt-BR or PT for pt).
    """
    try:
        found = json.loads(answer.strip())
    except ValueError:
        raise BadAnswer("the answer is not JSON") from None
    if not isinstance(found, list):
        raise BadAnswer("the answer is not a list")
    made: dict[str, dict[str, str]] = {}
    for item in found:
        if isinstance(item, dict) and isinstance(item.get("summaries"), dict) and isinstance(item.get("path"), str):
            own = {k.lower(): v.strip() for k, v in item["summaries"].items() if isinstance(v, str) and v.strip()}
            fits = lambda lang: next((v for k, v in own.items() if k == lang or re.match(re.escape(lang) + "[-_]", k)), None)  # noqa: E731,B023
            made[item["path"]] = {lang: text for lang in languages if (text := fits(lang))}
    good = {p: made[p] for p in paths if len(made.get(p, {})) == len(languages)}
    return good, {p: "no answer for this file" if p not in made else "a requested language is missing" for p in paths if p not in good}


def within_budget(ranked: DataFrame, tokens: str, languages: int, budget_usd: float, price: tuple[float, float], key: str = "path") -> DataFrame:
    """The most important files (importance) whose summaries' running cost stays within the budget; a plan that stops there."""
    each = ((F.col(tokens) + 18 + F.lit(220 / BATCH)) * price[0] + (14 + 60 * languages) * price[1]) / 1e6
    upto = Window.orderBy(F.desc("importance"), key).rowsBetween(Window.unboundedPreceding, 0)  # a row for each file of a tree
    return ranked.withColumn("cost", F.sum(each).over(upto)).where(F.col("cost") <= budget_usd)


def write_state(spark: SparkSession, path: str, states: DataFrame, spent: dict) -> dict:
    """The counts of status() and what was spent, as a JSON file that is replaced in one step."""
    state = {"files": {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}, "spent": spent}
    write_text(spark, path, json.dumps(state, sort_keys=True, indent=1) + "\n")
    return state
