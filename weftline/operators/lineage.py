"""Tables and small files in the folder that the cluster shares: cut lineage, manifests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    A session on one machine (local master) may leave it unset and gets a folder of its own; a cluster may not.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _place(spark, path)
    return fs.exists(at)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text by whatever file system its path names; None if it isn't there."""
    at, fs = _place(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file in one step, by whatever file system its path names."""
    at, fs = _place(spark, path)
    new, _ = _place(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop, sc = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext
    rename = getattr(hadoop, "Options$Rename")
    options = sc._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(at), options)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder and what is in it, if it is there."""
    at, fs = _place(spark, path)
    fs.delete(at, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    at, fs = _place(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()) if fs.exists(at) else []


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again."""
    return placed(df)[1]


def placed(df: DataFrame) -> tuple[str, DataFrame]:
    """df as a table in the shared folder: where it is, and the table read again.

    Every executor can read it, so a lost one costs nothing but its tasks. The table goes when the session's JVM
    ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/round-{uuid.uuid4().hex}"
    at, fs = _place(spark, path)
    fs.deleteOnExit(at)
    df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)
