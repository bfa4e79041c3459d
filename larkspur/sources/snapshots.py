"""Manifests as a log of snapshots: a reader sees one whole version or the one before, never half a write.

root/data holds a folder of Parquet files per snapshot, under a name that is used once; root/commits holds one small JSON
file per version, created only after its folder is complete, and only if no other writer has created it. The newest
complete commit names the current folder. Each commit names the batch that it took in, so a batch that comes again
(a retried job, a replayed micro-batch) changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from .io import upsert

#: Attempts to commit while other writers commit too.
TRIES = 10


class Conflict(RuntimeError):
    """Another writer has created the commit."""


class SnapshotLog:
    """A manifest under `root`, in any file system that Spark writes to. key: the columns that name a row; version: the
    column whose largest value wins among rows of one key (None: rows of a later commit win, and inside one batch the
    largest row)."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], version: str | None = None):
        self.spark, self.root, self.key, self.version = spark, root.rstrip("/"), key, version

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self) -> list[str]:
        fs, at = self._fs(f"{self.root}/commits")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _load(self, name: str) -> dict | None:
        fs, at = self._fs(f"{self.root}/commits/{name}")
        stream = fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except json.JSONDecodeError:
            return None  # its writer was stopped before the file was whole
        return found if isinstance(found, dict) and "data" in found else None

    def commits(self) -> list[dict]:
        """All complete commits, oldest first: number, data, batch, rows of nothing else."""
        return [c for c in (self._load(n) for n in self._names() if n.endswith(".json")) if c]

    def latest(self) -> dict | None:
        """The newest complete commit; only as many files are read as are needed to find it."""
        return next((c for c in (self._load(n) for n in reversed(self._names()) if n.endswith(".json")) if c), None)

    def read(self, number: int | None = None) -> DataFrame | None:
        """The newest snapshot, or that of a commit; None before the first."""
        found = self.latest() if number is None else next((c for c in self.commits() if c["number"] == number), None)
        return None if found is None else self.spark.read.parquet(f"{self.root}/data/{found['data']}")

    def _create(self, number: int, data: str, batch: str) -> None:
        fs, at = self._fs(f"{self.root}/commits/{number:012d}.json")
        text = json.dumps({"number": number, "batch": batch, "data": data})
        try:
            out = fs.create(at, False)
        except Exception as e:
            raise Conflict(str(at)) from e
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _next(self) -> int:
        """The number after all commit files, whole or not."""
        return max((int(n[:12]) for n in self._names() if n[:12].isdigit()), default=-1) + 1

    def commit(self, new: DataFrame, batch: str) -> int | None:
        """Merge rows into the manifest and return the commit's number, or None if the batch is in already. The rows are
        written under a name of their own; if another writer commits first, the merge is made again on its snapshot."""
        for _ in range(TRIES):
            # the number first: whatever is committed after this makes the attempt fail
            number = self._next()
            if any(c["batch"] == batch for c in self.commits()):
                return None
            base, data = self.read(), f"{number:012d}-{uuid.uuid4().hex}"
            empty = new.limit(0) if base is None else base
            upsert(empty, new, self.key, self.version).write.parquet(f"{self.root}/data/{data}")
            try:
                self._create(number, data, batch)
            except Conflict:
                self._remove(f"{self.root}/data/{data}")
                continue
            return number
        raise Conflict(f"{self.root}: {TRIES} attempts to commit")

    def _remove(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete folders that no one of the newest `keep` commits names, such as those of killed writers; to be called when
        no other writer is at work. The commits stay, so replayed batches are still known."""
        named = {c["data"] for c in self.commits()[-keep:]}
        fs, at = self._fs(f"{self.root}/data")
        gone = [n for n in (s.getPath().getName() for s in fs.listStatus(at)) if n not in named] if fs.exists(at) else []
        for name in gone:
            self._remove(f"{self.root}/data/{name}")
        return sorted(gone)
