"""Files that change together: pairs within a commit, bounded before they are made, and greedy partner caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

MAX_COMMITS, MONTHS_DAYS, MIN_FILES, MAX_FILES, MAX_PARTNERS = 500, 180, 2, 200, 50


def recent(commits: DataFrame, max_commits: int | None = MAX_COMMITS, days: int | None = MONTHS_DAYS, min_files: int = MIN_FILES, max_files: int = MAX_FILES, now: Column | None = None) -> DataFrame:
    """Commits (commit, at, files) of the last days before now, the newest first, of few enough files."""
    if days is not None:
        commits = commits.where(F.col("at") >= (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {days} DAYS"))
    if max_commits is not None:
        commits = commits.orderBy(F.desc("at"), F.desc("commit")).limit(max_commits)
    return commits.where(F.size("files").between(min_files, max_files))


def pairs(commits: DataFrame) -> DataFrame:
    """(a, b, commit, at) with a < b, made inside a commit's row: no join, and at most its files squared by two."""
    files = F.array_sort("files")
    each = F.flatten(F.transform(files, lambda x: F.transform(F.filter(files, lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return commits.select("commit", "at", F.explode(each).alias("p")).select("p.a", "p.b", "commit", "at")


def counts(commits: DataFrame) -> DataFrame:
    """(a, b, n): in how many commits two files changed together."""
    return pairs(commits).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def capped(commits: DataFrame, cap: int = MAX_PARTNERS) -> DataFrame:
    """(a, b): pairs taken newest commit first and in path order, while both files have fewer than cap partners.

    The sequential rule in parallel rounds: a pair is taken when, among the undecided pairs of either end, its
    place is within what that end has left; it goes when an end has nothing left. The earliest undecided pair is
    always decided, so the rounds end, and a taken pair never depends on a later one.
    """
    ordered = pairs(commits).groupBy("a", "b").agg(F.max(F.struct("at", "commit")).alias("newest"))
    todo = cut(ordered.select("a", "b", F.col("newest.at").alias("at"), F.col("newest.commit").alias("commit")))
    taken = todo.select("a", "b").limit(0)
    first = [F.desc("at"), F.desc("commit"), "a", "b"]
    while True:
        used = taken.select(F.col("a").alias("f")).union(taken.select("b")).groupBy("f").agg(F.count(F.lit(1)).alias("used"))
        half = todo.select(F.col("a").alias("f"), "a", "b", "at", "commit").union(todo.select("b", "a", "b", "at", "commit"))
        placed = half.withColumn("place", F.row_number().over(Window.partitionBy("f").orderBy(*first))).join(used, "f", "left")
        room = F.lit(cap) - F.coalesce("used", F.lit(0))
        state = placed.groupBy("a", "b", "at", "commit").agg(F.bool_and(F.col("place") <= room).alias("take"), F.bool_or(room <= 0).alias("full"))
        state = cut(state)
        new = state.where("take AND NOT full").select("a", "b")
        todo, before = state.where("NOT (take OR full)").select("a", "b", "at", "commit"), state
        if not before.where("take OR full").limit(1).count():
            return taken
        taken = taken.union(new)
