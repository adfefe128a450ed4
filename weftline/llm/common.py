"""What the operators share: reading tables, and cutting lineage with tables in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch takes to a Python worker; bounds a worker's memory on long texts.
BATCH_ROWS = 500


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names.

    A session on one machine (local master) may leave it unset and gets a folder of its own; a cluster may not.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage, and survives the loss of any executor.

    The table is removed when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame) -> DataFrame:
    """df in at most two partitions a core, for tables much smaller than the corpus: as many files and no more."""
    return df.coalesce(max(8, 2 * df.sparkSession.sparkContext.defaultParallelism))


def measured(df: DataFrame, name: str, **values: Column) -> tuple[DataFrame, dict]:
    """saved(df), and aggregates over it that the same job takes; n is the number of rows."""
    seen = Observation()
    out = saved(df.observe(seen, F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in values.items()]), name)
    return out, seen.get


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_ROWS rows, unless the session already asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


@contextlib.contextmanager
def wide_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of the usual size, for the jobs run within: those on narrow rows without texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lean(each: Callable) -> Callable:
    """each, for mapInArrow; when its task ends, the worker gives what was freed back to the system.

    Workers stay for the tasks of later stages, and allocators would keep the most that any task held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from each(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
                trim(0)

    return run


def byte_texts(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, one at a time; null as empty."""
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def texts(column: pa.ChunkedArray | pa.Array) -> Iterator[str]:
    """Each text, one at a time; null as empty."""
    for x in column:
        yield x.as_py() or ""


#: Ids that are broadcast for a semi or anti join (about 32 MB a million); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def id_set(ids: DataFrame) -> DataFrame:
    """The distinct longs of a column, saved once for several joins; marked for broadcast if they are few enough."""
    own, size = measured(few(ids.toDF("__id").where("__id IS NOT NULL").distinct()), "ids")
    return F.broadcast(own) if size["n"] <= BROADCAST_IDS else own


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs left_semi or left_anti by doc_id in an id_set. Null doc_ids match nothing."""
    return docs.join(ids, docs["doc_id"].cast("long") == ids["__id"], how)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): row is a hash of the text, which tells rows of one doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def row_set(rows: DataFrame) -> DataFrame:
    """The distinct (doc_id, row) of keyed rows, saved; marked for broadcast if they are few enough."""
    own, size = measured(few(rows.select("doc_id", "row").toDF("__id", "__row").distinct()), "rows")
    return F.broadcast(own) if size["n"] <= BROADCAST_IDS else own


def by_rows(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs left_semi or left_anti by doc_id (null is one of the ids) and text in a row_set."""
    same = docs["doc_id"].cast("long").eqNullSafe(rows["__id"]) & (F.xxhash64(docs["text"].cast("string")) == rows["__row"])
    return docs.join(rows, same, how)

