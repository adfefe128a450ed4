"""Structured Streaming: bursts of changes to cycles, idempotent upserts, and windowed counts."""

from __future__ import annotations

import contextlib
import fcntl
import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import folders, read_text, write_text


def source(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that is there now, through the stream, as a table in memory (for results of a bounded size)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def deduplicated(events: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Events whose keys weren't seen within the delay."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def bursts(events: DataFrame, key: str, at: str, quiet: str, delay: str) -> DataFrame:
    """(key, began, ended, n): runs of events without a pause of quiet between."""
    w = F.session_window(at, quiet)
    return events.withWatermark(at, delay).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def windowed(events: DataFrame, key: str, at: str, size: str, slide: str | None, delay: str) -> DataFrame:
    """(key, began, n): counts in tumbling or sliding windows."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, delay).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("began"), "n")


def latest(feed: DataFrame, key: str, order: list[str], op: str) -> DataFrame:
    """The newest row of each key of a change feed, without those whose newest is a removal."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return feed.withColumn("__n", F.row_number().over(newest)).where(f"__n = 1 AND {op} <> 'remove'").drop("__n", op)


class VersionedSink:
    """Applies each batch of a change feed once: a batch's rows go to a version of their own, then the manifest moves.

    A batch that is run again after a failure finds its version in the manifest and does nothing; one that
    failed half way leaves no trace that readers see. The manifest is replaced in one step.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def _manifest(self, spark: SparkSession) -> dict:
        text = read_text(spark, f"{self.path}/manifest.json")
        return json.loads(text) if text else {"batches": []}

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        manifest = self._manifest(spark)
        if batch_id in manifest["batches"] or batch.isEmpty():
            return
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id}")
        manifest["batches"].append(batch_id)
        write_text(spark, f"{self.path}/manifest.json", json.dumps(manifest))

    def read(self, spark: SparkSession, key: str, order: list[str], op: str) -> DataFrame:
        paths = [f"{self.path}/batch-{b}" for b in self._manifest(spark)["batches"]]
        return latest(spark.read.parquet(*paths), key, ["batch_id", *order], op)


# Folders whose changes are never worth a cycle.
IGNORED = (".git", ".specs/.index", ".models", "target", "node_modules")


def _ignore_pattern(line: str) -> tuple[str, bool] | None:
    """A regular expression for a line of an ignore file, and whether it takes paths back; None for what is none."""
    rule = line.rstrip()
    if not rule or rule.startswith("#"):
        return None
    back = rule.startswith("!")
    rule = rule[1:] if back else rule
    anchored = "/" in rule.rstrip("/")
    rule = rule.strip("/") if rule.endswith("/") else rule.lstrip("/")
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + "(?:/|$)", back


def relevant(path: Column, ignore: str = "") -> Column:
    """Whether a change at a path of the tree is worth a cycle, by the always ignored folders and an ignore file's text.

    The last rule that fits decides, as in git; a rule with ! takes paths back. A rule for a folder fits what is in it.
    """
    p = F.regexp_replace(path, r"\\\\", "/")
    folders = "|".join(re.escape(f) for f in IGNORED)
    out = F.lit(True)
    for line in ignore.splitlines():
        if rule := _ignore_pattern(line):
            out = F.when(p.rlike(rule[0]), F.lit(rule[1])).otherwise(out)
    return (p != "") & ~p.rlike(rf"^(?:{folders})(?:/|$)|(?:^|/)(?:node_modules|\.git)(?:/|$)") & out


class Watched(RuntimeError):
    """Another watcher has the tree."""


@contextlib.contextmanager
def sole_watcher(folder: str) -> Iterator[None]:
    """One watcher of a folder at a time on this machine; a second is refused at once."""
    with open(f"{folder}/watch.lock", "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            raise Watched(f"another watcher has {folder}") from None
        yield


def into_table(stream: DataFrame, mode: str, at: str) -> DataFrame:
    """All that is there now, through the stream, as a table in the folder at; nothing passes through the driver.

    In complete mode each batch's whole result replaces the one before; in append mode batches are added.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/table/{'whole' if mode == 'complete' else f'batch={n}'}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(stream.schema).parquet(f"{at}/table/whole" if mode == "complete" else f"{at}/table/*") if folders(spark, f"{at}/table") else None
    return spark.createDataFrame([], stream.schema) if found is None else found


def watch(stream: DataFrame, cycle: Callable[[DataFrame, int], None], checkpoint: str, quiet: str = "500 milliseconds"):
    """Run a cycle for each burst of changes; the checkpoint keeps a second run from repeating one."""
    return stream.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(processingTime=quiet).start()
