"""Lessons from signals about nodes: decay, classes, overlay flags; and annotations: freshness and lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_LIFE_DAYS, LEAST_WEIGHT = 90.0, 0.25
USEFUL, NEGATIVE = ("useful",), ("dead_end", "corrected")
MAX_NOTE = 500


def weight(at: Column, now: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """Half for each half-life of age; signals from the future are of age 0."""
    age = F.greatest((F.unix_micros(now) - F.unix_micros(at)) / F.lit(86_400e6), F.lit(0.0))
    return F.pow(F.lit(0.5), age / max(half_life, 0.001))


def reflect(signals: DataFrame, now: Column, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """(node, useful, negative, faded, latest, lesson, leaning) of signals (node, at, outcome).

    Faded signals count only as such. latest is the sign of the newest signal; of one moment, negative wins.
    """
    fresh = weight(F.col("at"), now, half_life) >= LEAST_WEIGHT
    useful, negative = F.col("outcome").isin(*USEFUL), F.col("outcome").isin(*NEGATIVE)
    newest = F.max(F.when(fresh & (useful | negative), F.struct("at", negative.alias("negative"))))
    out = signals.groupBy("node").agg(
        F.count_if(fresh & useful).alias("useful"), F.count_if(fresh & negative).alias("negative"), F.count_if(~fresh).alias("faded"), newest.alias("newest")
    )
    latest = F.when(F.col("newest.negative"), "negative").when(~F.col("newest.negative"), "useful")
    lesson = (
        F.when((F.col("useful") > 0) & (F.col("negative") > 0), "contested")
        .when(F.col("negative") > 0, "dead_end")
        .when(F.col("useful") >= 2, "preferred")
        .when(F.col("useful") == 1, "tentative")
    )
    return out.select("node", "useful", "negative", "faded", latest.alias("latest"), lesson.alias("lesson"), F.when(lesson == "contested", latest).alias("leaning"))


def lessons(reflected: DataFrame) -> DataFrame:
    """(id, good, bad) for the overlay: what to boost and what to lower; tentative nodes are left alone."""
    good = (F.col("lesson") == "preferred") | ((F.col("lesson") == "contested") & (F.col("leaning") == "useful"))
    bad = (F.col("lesson") == "dead_end") | ((F.col("lesson") == "contested") & (F.col("leaning") == "negative"))
    return reflected.select(F.col("node").alias("id"), F.coalesce(good, F.lit(False)).alias("good"), F.coalesce(bad, F.lit(False)).alias("bad"))


def render(lessons_: list[dict]) -> str:
    """Lessons (label, lesson, useful, negative, leaning) as Markdown, a section for each class."""
    times = lambda n: f"{n} time" + ("" if n == 1 else "s")
    told = {
        "preferred": ("Preferred", lambda r: f"useful {times(r['useful'])}"),
        "tentative": ("Tentative", lambda r: f"useful {times(r['useful'])}"),
        "contested": ("Contested", lambda r: f"useful {times(r['useful'])}, dead end or corrected {times(r['negative'])}; the latest says {'useful' if r['leaning'] == 'useful' else 'avoid'}"),
        "dead_end": ("Dead ends", lambda r: f"dead end or corrected {times(r['negative'])}"),
    }
    out = "# Lessons\n"
    for lesson, (title, tell) in told.items():
        own = [r for r in lessons_ if r["lesson"] == lesson]
        if own:
            out += f"\n## {title}\n\n" + "".join(f"- `{r['label'] or r['node']}`: {tell(r)}\n" for r in own)
    return out + ("" if lessons_ else "\nNo lessons yet.\n")


def annotation_state(annotations: DataFrame, nodes: DataFrame) -> DataFrame:
    """annotations (id, target, source_hash, ...) with state: dangling, stale or fresh by the target's hash now."""
    now = nodes.select(F.col("id").alias("target"), F.col("source_hash").alias("hash_now"))
    joined = annotations.join(now, "target", "left")
    state = F.when(F.col("hash_now").isNull(), "dangling").when(~F.col("hash_now").eqNullSafe(F.col("source_hash")), "stale").otherwise("fresh")
    return joined.withColumn("state", state).drop("hash_now")


def annotation_lint(annotations: DataFrame, max_chars: int = MAX_NOTE) -> DataFrame:
    """(id, problem) of annotations (id, target, note, state, relation): duplicates, stale, dangling, too long, secrets, relations to what isn't there.

    A relation is 'name:id' of another annotation; the column may be missing.
    """
    from ..functions.columns import find_secret

    key = ["target", F.lower("note")]
    twice = annotations.groupBy(F.col("target").alias("t"), F.lower("note").alias("n")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    duplicate = annotations.join(twice, (F.col("target") == F.col("t")) & (key[1] == F.col("n")), "left_semi").select("id", F.lit("duplicate").alias("problem"))
    problems = F.array_compact(F.array(
        F.when(F.col("state") == "stale", "stale"), F.when(F.col("state") == "dangling", "dangling"),
        F.when(F.char_length("note") > max_chars, "too_long"), F.when(find_secret("note").isNotNull(), "secret"),
    ))
    out = duplicate.union(annotations.select("id", F.explode(problems)))
    if "relation" in annotations.columns:
        to = annotations.where("relation IS NOT NULL").select("id", F.regexp_extract("relation", "[^:]*$", 0).alias("other"))
        out = out.union(to.join(annotations.select(F.col("id").alias("other")), "other", "left_anti").select("id", F.lit("broken_relation")))
    return out
