"""Retrieval quality and cost: recall, reciprocal rank, savings, medians, baselines, importance and coverage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .lineage import cut
from .sizes import small

REQUIREMENT_WEIGHT = 50
#: Approximate quantiles are off by at most one in so many rows.
ACCURACY = 10_000


def recall_mrr(ranked: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(query_id, recall_at_k..., reciprocal_rank): over expected (query_id, id) and ranked (query_id, id, rank)."""
    joined = expected.select("query_id", "id").distinct().join(ranked.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    return joined.groupBy("query_id").agg(
        *[(F.count_if(F.col("rank") <= k) / F.count(F.lit(1))).alias(f"recall_at_{k}") for k in ks],
        F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median): the element at half the count of the sorted values, exactly.

    Approximate quantiles of a known error bracket it; values below the bracket are counted, and only those within
    it, a few thousandths of a group, are put in order.
    """
    margin = 4 / ACCURACY
    bracket = F.percentile_approx(value, [0.5 - margin, 0.5 + margin], ACCURACY)
    ends = cut(df.where(F.col(value).isNotNull()).groupBy(group).agg(bracket.alias("x"), F.count(F.lit(1)).alias("n")))
    ends = small(ends.select(F.col(group).alias("g"), F.get("x", F.lit(0)).alias("lo"), F.get("x", F.lit(1)).alias("hi"), F.floor(F.col("n") / 2).alias("at")))
    placed = df.join(ends, F.col(group).eqNullSafe(F.col("g"))).where(F.col(value) <= F.col("hi"))
    counts = placed.groupBy(group, "at", F.when(F.col(value) >= F.col("lo"), F.col(value)).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(group).orderBy(F.asc_nulls_first("v")))
    return counts.withColumn("upto", upto).where("upto > at").groupBy(group).agg(F.min("v").alias("median"))


def savings(cost: Column, baseline: Column) -> Column:
    return F.when(baseline == 0, 0.0).otherwise(1 - cost / baseline)


def grep_baseline(docs: DataFrame, terms: DataFrame, id_column: str) -> DataFrame:
    """(query_id, lines, line_tokens, files, file_tokens): lines that hold a term (query_id, term), and their files whole."""
    lines = docs.select(F.col(id_column).alias("id"), C.token_estimate("text").alias("whole"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    hits = lines.join(small(terms), F.col("line").contains(F.col("term")))
    each = hits.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("lines"), F.sum(C.token_estimate("line") + 1).alias("tokens"), F.first("whole").alias("whole"))
    return each.groupBy("query_id").agg(F.sum("lines").alias("lines"), F.sum("tokens").alias("line_tokens"), F.count(F.lit(1)).alias("files"), F.sum("whole").alias("file_tokens"))


def importance(nodes: DataFrame, edges: DataFrame, cochanges: DataFrame) -> DataFrame:
    """(id, degree, requirements, cochange, importance) by node: links at either end, requirements weigh 50."""
    half = edges.select(F.explode(F.array("from_id", "to_id")).alias("id"), "edge_type")  # one pass over the edges
    pairs = cochanges.select(F.explode(F.array("a", "b")).alias("id"))
    every = half.select("id", (F.col("edge_type") != 0).cast("int").alias("d"), (F.col("edge_type") == 0).cast("int").alias("r"), F.lit(0).alias("c")).union(pairs.select("id", F.lit(0), F.lit(0), F.lit(1)))
    out = every.groupBy("id").agg(F.sum("d").alias("degree"), F.sum("r").alias("requirements"), F.sum("c").alias("cochange")).join(nodes.select("id"), "id", "left_semi")
    return out.withColumn("importance", F.col("degree") + REQUIREMENT_WEIGHT * F.col("requirements") + F.col("cochange"))


def top_percent(ranked: DataFrame, percent: float, total: int, key: str = "id") -> DataFrame:
    """The most important percent, rounded up, one at least; ties by key.

    Counts by importance tell which importance the last place has: rows above it need no order, and of its own
    rows the first by key are taken from a table in order of key. So no task holds more than a part of that table.
    """
    need = min(total, max(1, math.ceil(total * percent / 100)))
    levels = ranked.groupBy("importance").agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.desc_nulls_last("importance")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each distinct importance
    last = levels.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0))).where((F.col("before") < need) & (F.col("before") + F.col("n") >= need)).first()
    if last is None:
        return ranked.limit(0) if need <= 0 else ranked
    level = F.lit(last["importance"])
    over = ranked.where(F.col("importance").isNotNull() if last["importance"] is None else F.col("importance") > level)
    own, left = ranked.where(F.col("importance").eqNullSafe(level)), need - last["before"]
    return over.unionByName(own if left == last["n"] else first_rows(own, key, left))


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of the least keys, a large n too: whole ranges of keys, and of one range its first rows."""
    dealt = cut(df.repartitionByRange(key).withColumn("range", F.spark_partition_id()))
    before = 0
    for r in sorted(dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row for each task
        if before + r["n"] > n:
            whole, cut_one = dealt.where(F.col("range") < r["range"]), dealt.where(F.col("range") == r["range"])
            return whole.unionByName(cut_one.orderBy(key).limit(n - before)).drop("range")
        before += r["n"]
    return dealt.drop("range")


def coverage_curve(ranked: DataFrame, tokens: str, shares: tuple[int, ...] = (20, 50, 100), key: str = "id") -> DataFrame:
    """(share, files, tokens): what the most important share of files costs.

    Places come from sums by importance, so the ranking isn't drawn into one task; only files of an importance
    that a share cuts are put in order of key.
    """
    levels = ranked.groupBy("importance").agg(F.count(F.lit(1)).alias("n"), F.sum(tokens).alias("t"))
    above = Window.orderBy(F.desc("importance")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each distinct importance
    levels = cut(levels.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0))))
    total = levels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    need = {s: min(total, max(1, math.ceil(total * s / 100))) for s in shares}
    wanted = F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.lit(n).cast("long").alias("need")) for s, n in need.items()]))
    each = levels.select("*", wanted.alias("x")).select("importance", "n", "t", "before", "x.share", "x.need")
    whole = each.where("before + n <= need").select("share", F.col("n").alias("files"), F.col("t").alias("tokens"))
    part = small(each.where("before < need AND before + n > need").select("share", "importance", (F.col("need") - F.col("before")).alias("left")))
    own = ranked.join(part, "importance").withColumn("place", F.row_number().over(Window.partitionBy("share").orderBy(key))).where("place <= left")
    out = whole.union(own.select("share", F.lit(1).cast("long"), tokens))
    return out.groupBy("share").agg(F.sum("files").alias("files"), F.sum("tokens").alias("tokens"))


def enrichment_estimate(files: DataFrame, tokens: str, languages: int, batch: int = 8) -> DataFrame:
    """(input_tokens, output_tokens) of summarising files: 220 a batch, tokens and 18 a file; 14 and 60 a language."""
    n = F.count(F.lit(1))
    return files.agg((F.ceil(n / batch) * 220 + F.sum(F.col(tokens) + 18)).cast("long").alias("input_tokens"), (n * (14 + 60 * languages)).cast("long").alias("output_tokens"))


def break_even(spent: float, saving_per_query: float) -> int | None:
    return math.ceil(spent / saving_per_query) if saving_per_query > 0 else None


# US dollars a million tokens in and out; an unknown model counts as the cheapest.
PRICES = {"gemini-flash-lite-latest": (0.10, 0.40), "gemini-2.5-flash-lite": (0.10, 0.40), "gemini-2.5-flash": (0.30, 2.50)}
UNKNOWN_PRICE = (0.10, 0.40)


def cost(input_tokens: int, output_tokens: int, model: str, price_in: float | None = None, price_out: float | None = None) -> tuple[float, bool]:
    """Dollars for so many tokens, and whether the price is known: given, or in the table."""
    known = PRICES.get(model, UNKNOWN_PRICE)
    per = (known[0] if price_in is None else price_in, known[1] if price_out is None else price_out)
    return (input_tokens * per[0] + output_tokens * per[1]) / 1e6, model in PRICES or (price_in is not None and price_out is not None)


def format_usd(amount: float) -> str:
    return f"${amount:.4f}" if amount < 0.01 else f"${amount:.2f}"


#: What a change of the retrieval may cost: prose recall at 5 must rise, look-ups may lose little, searches slow little.
LEAST_GAIN, MOST_LOSS, MOST_SLOWER, GATE, GATE_LOSS, GATE_QUERIES = 15.0, 2.0, 1.2, 0.8, 5.0, 5


def gate(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """(kind, problem) of results (kind, queries, recall_at_5, ...) against a baseline: none means it passes.

    locate must reach a recall of 0.8 at 5, and no kind of five queries or more may lose 5 points.
    """
    low = now.where((F.col("kind") == "locate") & (F.col("recall_at_5") < GATE)).select("kind", F.lit("recall below 0.8").alias("problem"))
    both = now.alias("n").join(baseline.alias("b"), "kind").where(F.col("n.queries") >= GATE_QUERIES)
    lost = both.where((F.col("b.recall_at_5") - F.col("n.recall_at_5")) * 100 > GATE_LOSS + 1e-9).select("kind", F.lit("recall fell by more than 5 points"))
    return low.union(lost)


def accepts_summaries(before: dict, after: dict) -> list[str]:
    """Why summaries aren't accepted, from results {kind: {recall_at_5, mrr}, latency}: none means that they are."""
    out = []
    if (after["behavior"]["recall_at_5"] - before["behavior"]["recall_at_5"]) * 100 < LEAST_GAIN - 1e-9:
        out.append(f"recall of prose rose by less than {LEAST_GAIN:g} points")
    if (before["locate"]["mrr"] - after["locate"]["mrr"]) * 100 > MOST_LOSS + 1e-9:
        out.append(f"look-ups lost more than {MOST_LOSS:g} points")
    if after["latency"] > before["latency"] * MOST_SLOWER + 1e-9:
        out.append(f"searches take more than {MOST_SLOWER:g} times as long")
    return out


def accepts_memory(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, lost) of the kinds whose recall at 5 falls by more than 2 points with memory: none means acceptance."""
    both = before.select("kind", F.col("recall_at_5").alias("x")).join(after.select("kind", F.col("recall_at_5").alias("y")), "kind")
    return both.select("kind", F.round((F.col("x") - F.col("y")) * 100, 6).alias("lost")).where(F.col("lost") > MOST_LOSS + 1e-9)


def whole_file_baseline(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, files, tokens): what reading the expected files (query_id, id) whole costs."""
    own = expected.select("query_id", "id").distinct().join(files.select("id", C.token_estimate("text").alias("t")), "id")
    return own.groupBy("query_id").agg(F.count(F.lit(1)).alias("files"), F.sum("t").alias("tokens"))


def corpus_baseline(files: DataFrame) -> DataFrame:
    """(files, tokens) of reading everything."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum(C.token_estimate("text")).alias("tokens"))


def hit_locations(nodes: DataFrame, edges: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, rank, step, path, symbol, marker): where hits (query_id, rank, id) lie, in terms that a question names.

    A file is its path, a symbol its file's path and its name, a marker itself; then, one level on, the symbols and
    tasks that satisfy the marker. Tables, packages and endpoints are no places in code.
    """
    named = nodes.select("id", "kind", "label", "path", "name")
    markers = ["requirement", "task", "adr"]
    own = hits.select("query_id", "rank", "id").join(named, "id").where(F.col("kind").isin("file", "symbol", *markers))
    own = own.select("query_id", "rank", F.lit(0).alias("step"), "id", "kind", "label", "path", "name")
    by = edges.where("edge_type = 0").select(F.col("from_id").alias("by"), F.col("to_id").alias("id"))
    near = own.where(F.col("kind").isin(markers)).select("query_id", "rank", "id").join(by, "id").select("query_id", "rank", F.col("by").alias("id"))
    near = near.join(named, "id").where(F.col("kind").isin("symbol", "task")).select("query_id", "rank", F.lit(1).alias("step"), "id", "kind", "label", "path", "name")
    marker = F.when(F.col("kind").isin(markers), F.col("label"))
    path, symbol = F.when(~F.col("kind").isin(markers), F.col("path")), F.when(F.col("kind") == "symbol", F.coalesce("name", "label"))
    return own.union(near).select("query_id", "rank", "step", path.alias("path"), symbol.alias("symbol"), marker.alias("marker")).distinct()
