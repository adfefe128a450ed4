"""A versioned store of tables: staged writes, one atomic manifest, single writer, compaction."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import tempfile
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .graph import should_compact
from .lineage import delete, folders, read_text, write_text

FORMAT = 1


class Busy(RuntimeError):
    """Another writer holds the store."""


class Store:
    """Tables under one folder that driver and executors share, by whatever file system its path names.

    A version lists the folder of each table; readers go by the manifest, so they see a version whole or not at
    all. A version that failed while it was staged is never listed. A manifest of another format is discarded
    with its tables, which are derived and can be built again.
    """

    def __init__(self, spark: SparkSession, path: str, wait: float = 30.0) -> None:
        self.spark, self.path, self.wait = spark, path, wait
        if "://" not in path:
            os.makedirs(path, exist_ok=True)

    def manifest(self) -> dict:
        text = read_text(self.spark, f"{self.path}/manifest.json")
        found = json.loads(text) if text else {}
        return found if found.get("format") == FORMAT else {"format": FORMAT, "version": 0, "tables": {}, "done": []}

    def _publish(self, manifest: dict) -> None:
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps(manifest))

    @contextlib.contextmanager
    def lock(self) -> Iterator[None]:
        """One writer at a time on this machine; waits, then raises Busy."""
        local = f"{self.path}/lock" if "://" not in self.path else f"{tempfile.gettempdir()}/weftline-{hashlib.sha256(self.path.encode()).hexdigest()[:16]}.lock"
        with open(local, "w") as f:
            until = time.monotonic() + self.wait
            while True:
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except BlockingIOError:
                    if time.monotonic() >= until:
                        raise Busy(f"another process has been writing to {self.path} for {self.wait:g} s") from None
                    time.sleep(0.05)
            yield

    def commit(self, tables: dict[str, DataFrame], batch: str | None = None) -> int:
        """Write tables as the next version; a batch that is done already changes nothing. The version."""
        with self.lock():
            now = self.manifest()
            if batch is not None and batch in now["done"]:
                return now["version"]
            version = now["version"] + 1
            staged = {}
            try:
                for name, df in tables.items():
                    staged[name] = f"{name}/v{version}"
                    df.write.mode("overwrite").parquet(f"{self.path}/{staged[name]}")
            except Exception:
                for place in staged.values():
                    delete(self.spark, f"{self.path}/{place}")
                raise
            done = [*now["done"], batch] if batch is not None else now["done"]
            self._publish({"format": FORMAT, "version": version, "tables": now["tables"] | staged, "done": done})
            return version

    def read(self, name: str) -> DataFrame | None:
        place = self.manifest()["tables"].get(name)
        return self.spark.read.parquet(f"{self.path}/{place}") if place else None

    def version(self) -> int:
        return self.manifest()["version"]

    def upsert(self, name: str, key: str, upserts: DataFrame, removed: DataFrame, batch: str | None = None) -> int:
        """Fold a delta over a table: kept beside it while small, rewritten with it from a twentieth on."""
        from .graph import delta_view

        base = self.read(name)
        if base is None:
            return self.commit({name: upserts.join(removed.select(key), key, "left_anti")}, batch)
        earlier, gone = self.read(f"{name}.delta"), self.read(f"{name}.removed")
        if earlier is not None:
            upserts = upserts.unionByName(earlier.join(upserts.select(key).union(removed.select(key)), key, "left_anti").select(*upserts.columns))
            removed = removed.select(key).union(gone.join(upserts.select(key), key, "left_anti").select(key)).distinct()
        if should_compact(upserts.count() + removed.count(), base.count()):
            empty = upserts.limit(0)
            return self.commit({name: delta_view(base, upserts, removed, key), f"{name}.delta": empty, f"{name}.removed": empty.select(key)}, batch)
        return self.commit({f"{name}.delta": upserts, f"{name}.removed": removed.select(key)}, batch)

    def view(self, name: str, key: str) -> DataFrame | None:
        """A table with its delta over it."""
        from .graph import delta_view

        base, delta, gone = self.read(name), self.read(f"{name}.delta"), self.read(f"{name}.removed")
        return base if base is None or delta is None else delta_view(base, delta, gone, key)

    def compact(self) -> list[str]:
        """Rewrite tables that have a delta with it, in one version; their names."""
        from .graph import delta_view

        names = [n for n in self.manifest()["tables"] if f"{n}.delta" in self.manifest()["tables"]]
        staged: dict[str, DataFrame] = {}
        for n in names:
            base, delta, gone = self.read(n), self.read(f"{n}.delta"), self.read(f"{n}.removed")
            if delta.isEmpty() and gone.isEmpty():
                continue
            staged |= {n: delta_view(base, delta, gone, gone.columns[0]), f"{n}.delta": delta.limit(0), f"{n}.removed": gone.limit(0)}
        if staged:
            self.commit(staged)
        return sorted(n for n in staged if "." not in n)

    def vacuum(self) -> list[str]:
        """Remove folders that no table of the newest version uses."""
        used, gone = set(self.manifest()["tables"].values()), []
        for name in folders(self.spark, self.path):
            for v in folders(self.spark, f"{self.path}/{name}"):
                if f"{name}/{v}" not in used:
                    delete(self.spark, f"{self.path}/{name}/{v}")
                    gone.append(f"{name}/{v}")
        return gone
