"""Git repositories as Spark data sources: files at a revision, commits with their paths, blame hunks, dirty files."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES = "path string, blob string, size long, content string"
COMMITS = "oid string, rank int, parent string, ts long, author string, message string, paths array<string>"
BLAME = "path string, oid string, author string, email string, ts long, line int"


def git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-c", "core.quotepath=off", "-C", repo, *args], input=data, capture_output=True, check=True).stdout


class _Slice(InputPartition):
    def __init__(self, rows: list) -> None:
        self.rows = rows


def _slices(rows: list, n: int) -> list[_Slice]:
    size = max(1, -(-len(rows) // max(1, n)))
    return [_Slice(rows[i : i + size]) for i in range(0, len(rows), size)] or [_Slice([])]


class _Files(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repo, self.revision, self.n = options["repo"], options.get("revision", "HEAD"), int(options.get("partitions", 8))

    def partitions(self) -> list[_Slice]:
        rows = []
        for line in git(self.repo, "ls-tree", "-r", "-l", "-z", self.revision).split(b"\0"):
            if line:
                head, path = line.split(b"\t", 1)
                mode, kind, blob, size = head.split()
                if kind == b"blob":
                    rows.append((path.decode("utf-8", "replace"), blob.decode(), int(size)))
        return _slices(rows, self.n)

    def read(self, partition: _Slice) -> Iterator[tuple]:
        if not partition.rows:
            return
        out = git(self.repo, "cat-file", "--batch", data="".join(f"{b}\n" for _, b, _ in partition.rows).encode())
        at = 0
        for path, blob, size in partition.rows:
            at = out.index(b"\n", at) + 1
            content = out[at : at + size]
            at += size + 1
            yield path, blob, size, None if b"\0" in content else content.decode("utf-8", "replace")


class _Commits(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repo, self.since, self.revision = options["repo"], options.get("since"), options.get("revision", "HEAD")

    def partitions(self) -> list[_Slice]:
        return [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        span = f"{self.since}..{self.revision}" if self.since else self.revision
        log = git(self.repo, "log", "--first-parent", "-m", "--root", "--name-only", "-z", "--format=%x01%H%x02%P%x02%ct%x02%an%x02%B%x02", span).decode("utf-8", "replace")
        for rank, part in enumerate(log.split("\x01")[1:]):
            oid, parents, ts, author, message, names = part.split("\x02", 5)
            paths = [p.strip("\n") for p in names.split("\0") if p.strip("\n")]
            yield oid, rank, (parents.split() or [None])[0], int(ts), author, message.strip(), paths


class _Blame(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repo, self.paths, self.revision = options["repo"], options["paths"].split("\n"), options.get("revision", "HEAD")

    def partitions(self) -> list[_Slice]:
        return [_Slice([p]) for p in self.paths]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for path in partition.rows:
            oid, line, seen = "", 0, {}
            for row in git(self.repo, "blame", "--line-porcelain", self.revision, "--", path).decode("utf-8", "replace").split("\n"):
                if row.startswith("\t"):
                    yield path, oid, seen.get("author"), seen.get("author-mail", "").strip("<>"), int(seen.get("author-time", 0)), line
                elif len(row.split()) >= 3 and len(row.split()[0]) == 40:
                    oid, line = row.split()[0], int(row.split()[2]) - 1
                elif " " in row:
                    seen[row.split(" ", 1)[0]] = row.split(" ", 1)[1]


def _source(name: str, schema_: str, reader_: type) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema_

        def reader(self, schema) -> DataSourceReader:
            return reader_(self.options)

    return Source


def register(spark: SparkSession) -> None:
    for name, schema, reader in (("git_files", FILES, _Files), ("git_commits", COMMITS, _Commits), ("git_blame", BLAME, _Blame)):
        spark.dataSource.register(_source(name, schema, reader))


def files(spark: SparkSession, repo: str, revision: str = "HEAD") -> DataFrame:
    """Blobs at a revision; content is null for binaries."""
    register(spark)
    return spark.read.format("git_files").option("repo", repo).option("revision", revision).load()


def commits(spark: SparkSession, repo: str, since: str | None = None, revision: str = "HEAD") -> DataFrame:
    """Commits newest first, each with the paths that it changed against its first parent; a root has all its own."""
    register(spark)
    reader = spark.read.format("git_commits").option("repo", repo).option("revision", revision)
    return (reader.option("since", since) if since else reader).load()


def blame(spark: SparkSession, repo: str, paths: list[str], first: int = 0, last: int | None = None) -> DataFrame:
    """(path, oid, author, email, ts, start, end): hunks that touch the 0-based inclusive lines."""
    register(spark)
    lines = spark.read.format("git_blame").option("repo", repo).option("paths", "\n".join(paths)).load().where(F.col("line") >= first)
    lines = lines if last is None else lines.where(F.col("line") <= last)
    from pyspark.sql import Window

    run = F.col("line") - F.row_number().over(Window.partitionBy("path", "oid").orderBy("line"))
    return lines.withColumn("run", run).groupBy("path", "oid", "author", "email", "ts", "run").agg(F.min("line").alias("start"), (F.max("line") + 1).alias("end")).drop("run")


def diff(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(path, change): added, modified and deleted files between two scans; a rename is both of the others."""
    if old is None:
        return new.select("path", F.lit("added").alias("change"))
    both = old.select("path", F.col("blob").alias("o")).join(new.select("path", F.col("blob").alias("n")), "path", "full")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "modified")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def dirty(spark: SparkSession, repo: str) -> DataFrame:
    """(path, content): modified and untracked files that aren't ignored, as they are on disk."""
    rows = []
    for line in git(repo, "status", "--porcelain", "-z", "-uall").decode("utf-8", "replace").split("\0"):
        path = line[3:]
        if path and "D" not in line[:2]:
            try:
                with open(f"{repo}/{path}", encoding="utf-8", errors="replace") as f:
                    rows.append((path, f.read()))
            except OSError:
                continue
    return spark.createDataFrame(rows, "path string, content string")


def changed_since(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files (path, content) whose content differs from the last look (path, hash); a first look counts."""
    hashed = now.withColumn("hash", F.sha2("content", 256))
    return hashed.join(before.select("path", "hash"), ["path", "hash"], "left_anti")


def with_working_tree(head: DataFrame, working: DataFrame) -> DataFrame:
    """(path, content): the working copy where there is one, else the committed one."""
    both = head.select("path", F.col("content").alias("h")).join(working.select("path", F.col("content").alias("w")), "path", "full")
    return both.select("path", F.coalesce("w", "h").alias("content"))
