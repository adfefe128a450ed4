"""Token budgets as running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

SHARE = 0.9
TIERS = {"target": 0, "seed": 1, "dependency": 2}


def fit(items: DataFrame, group: str, tier: str, position: str, text: str, budget: int) -> DataFrame:
    """items with cost and used, up to the first that would exceed nine tenths of the budget, by (tier, position)."""
    order = Window.partitionBy(group).orderBy(tier, position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = items.withColumn("cost", C.token_estimate(text)).withColumn("used", F.sum("cost").over(order))
    return out.where(F.col("used") <= int(budget * SHARE))


def fit_lines(lines: DataFrame, group: str, position: str, text: str, budget: int, footer: int) -> DataFrame:
    """Lines that fit, each costing its estimate and 1; the first always stays.

    The walk stops at the first line that leaves no room for the footer (unless it is the last), or none for itself.
    """
    limit = int(budget * SHARE)
    own = Window.partitionBy(group).orderBy(position)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(group)
    out = lines.withColumn("cost", C.token_estimate(text) + 1).withColumn("used", F.sum("cost").over(upto)).withColumn("place", F.row_number().over(own))
    out = out.withColumn("lines", F.count(F.lit(1)).over(whole))
    last = F.col("place") == F.col("lines")
    over: Column = (F.col("place") > 1) & ((F.col("used") > limit) | (~last & (F.col("used") + footer > limit)))
    stop = F.min(F.when(over, F.col("place"))).over(whole)
    return out.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("place") < F.col("stop"))).drop("stop")
