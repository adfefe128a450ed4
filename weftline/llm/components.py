"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, measured


def _saved(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The links, their number and a mark of the whole set. They join what is alike, so they are few beside the rows."""
    return measured(few(edges), "links", x=F.expr("bit_xor(xxhash64(u, v))"))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links between longs -> (u, v) with v the least node of u's component, for every node but the roots.

    Each round costs two shuffles of the links that are left and is written to the shared folder; rounds grow
    with the logarithm of the longest chain. Minima are combined before they are shuffled, and the joins on a
    node are plain equi-joins, which adaptive execution splits where a node has very many links. Self links
    and nulls are ignored; no links give no rows.
    """
    now, mark = _saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while mark["n"]:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = mark
        now, mark = _saved(small.union(least).distinct())
        if before == mark:
            break
    return now
