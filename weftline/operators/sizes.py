"""Broadcasts of a checked size, and shuffles whose tasks are."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that may be broadcast: a few tens of megabytes of ids, words or short vectors.
SMALL = 100_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; else as it is, and the join is planned by its statistics."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes of the files read, for each task of a spread shuffle: a million rows of the star schema's lines, about.
SPREAD_BYTES = 16 << 20


def tasks(df: DataFrame, weight: float = 1.0) -> int | None:
    """How many tasks what df reads should be dealt to, where each of its rows becomes weight rows; None if its size isn't known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= 1 << 56:  # rows that aren't of files
        return None
    least = min(df.sparkSession.sparkContext.defaultParallelism, size * weight / (SPREAD_BYTES / 64))
    return max(1, math.ceil(max(least, size * weight / SPREAD_BYTES)))


def spread(df: DataFrame, *by: Column | str, weight: float = 1.0) -> DataFrame:
    """df dealt by columns to as many tasks as its input's size asks for, whatever the session's number of them."""
    n = tasks(df, weight)
    return df.repartition(*by) if n is None else df.repartition(n, *by)
