"""Differences between two states: reports, schema drift, moved communities; and graphs of several repositories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MERGE, SPLIT = 0.5, 0.3
TOOL_TABLES = ("databasechangelog", "databasechangeloglock", "flyway_schema_history")


def changes(old: DataFrame, new: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(key..., change): added, removed or changed rows; one full join by key."""
    o, n = old.select(*key, F.struct(*fields).alias("o")), new.select(*key, F.struct(*fields).alias("n"))
    what = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return o.join(n, list(key), "full").select(*key, what.alias("change")).where("change IS NOT NULL")


def drift(desired: DataFrame, live: DataFrame) -> DataFrame:
    """(table, column, problem): columns (table, column, type) that a live schema lacks, has besides, or types otherwise."""
    own = lambda df: df.where(~F.lower("table").isin(*TOOL_TABLES))
    found = changes(own(desired), own(live), ["table", "column"], ["type"])
    names = F.when(F.col("change") == "removed", "missing").when(F.col("change") == "added", "extra").otherwise("different")
    return found.select("table", "column", names.alias("problem"))


def moved(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, community, parts): merged and split communities between memberships (file, community).

    Merged: a new community holds half of each of two old ones or more. Split: three tenths of an old one are in
    each of two new ones or more.
    """
    both = old.select("file", F.col("community").alias("old")).join(new.select("file", F.col("community").alias("new")), "file")
    shared = both.groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"))
    size = old.groupBy(F.col("community").alias("old")).agg(F.count(F.lit(1)).alias("size"))
    share = shared.join(size, "old").withColumn("share", F.col("n") / F.col("size"))
    merged = share.where(F.col("share") >= MERGE).groupBy("new").agg(F.sort_array(F.collect_list("old")).alias("parts"))
    split = share.where(F.col("share") >= SPLIT).groupBy("old").agg(F.sort_array(F.collect_list("new")).alias("parts"))
    out = merged.select(F.lit("merged").alias("kind"), F.col("new").alias("community"), "parts").union(split.select(F.lit("split"), "old", "parts"))
    return out.where(F.size("parts") >= 2)


def entered_left(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): what a top list gained and lost."""
    gained = new.select(key).join(old.select(key), key, "left_anti").select(key, F.lit("entered").alias("change"))
    return gained.union(old.select(key).join(new.select(key), key, "left_anti").select(key, F.lit("left")))


def merge_repositories(nodes: DataFrame, offset: str = "community") -> DataFrame:
    """Nodes (repo, loaded, id, community, ...) of several repositories: of a repeated tag the last loaded stays.

    Ids get their repository's tag; communities are moved past those of the repositories before, by tag.
    """
    last = nodes.groupBy("repo").agg(F.max("loaded").alias("loaded"))
    own = nodes.join(F.broadcast(last), ["repo", "loaded"], "left_semi")
    count = own.groupBy("repo").agg((F.max(offset) + 1).alias("n"))
    before = F.sum("n").over(Window.orderBy("repo").rowsBetween(Window.unboundedPreceding, -1))  # a row for each repository
    shift = count.select("repo", F.coalesce(before, F.lit(0)).alias("shift"))
    moved_ = own.join(F.broadcast(shift), "repo").withColumn(offset, (F.col(offset) + F.col("shift")).cast("long"))
    return moved_.withColumn("id", F.sha2(F.concat_ws(":", F.lit("repo"), "repo", "id"), 256)).drop("shift", "loaded")


def cross_links(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(from_repo, caller, to_repo, path): client calls that reach another repository's endpoint.

    An equi-join on method and the path's last segment; the whole paths are compared after it.
    """
    from ..functions.columns import paths_match

    last = lambda c: F.element_at(F.split(c, "/"), -1)
    c = calls.select(F.col("repo").alias("from_repo"), "caller", F.col("method").alias("m"), F.col("path").alias("called"), last("path").alias("tail"))
    e = endpoints.select(F.col("repo").alias("to_repo"), F.col("method").alias("m"), F.col("path").alias("path"), last("path").alias("tail"))
    found = c.join(e, ["m", "tail"]).where((F.col("from_repo") != F.col("to_repo")) & paths_match(F.col("called"), F.col("path")))
    return found.select("from_repo", "caller", "to_repo", "path").distinct()
