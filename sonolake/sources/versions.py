"""Tables with versions: folders of Parquet files and a log of commits, one small JSON file for each version.

A writer first writes its files to a folder of its own, which nobody reads, and then puts the log file of the next version, which
exactly one writer can do. One that finds the number taken looks again: an append takes the next number, anything that replaces
rows fails unless the table is as it was read. A commit may carry a token (an application and its batch); a token that the log has
already is not committed again, so a repeated batch adds nothing. Old versions stay readable until they are vacuumed.

On HDFS and the like the log file is put by a rename that fails where there is one; on the local file system by a hard link.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ATTEMPTS = 50


class Conflict(RuntimeError):
    """Another writer changed the table since it was read."""


@dataclass(frozen=True)
class Commit:
    version: int
    operation: str
    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    token: str | None = None
    rows: int | None = None


class _Files:
    """The file system of a path, by the driver's JVM."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.at = self._path(path)
        self.system = self.at.getFileSystem(self.conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        at = self._path(path)
        return sorted(f.getPath().getName() for f in self.system.listStatus(at)) if self.system.exists(at) else []

    def read(self, path: str) -> str:
        stream = self.system.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.system.create(self._path(path), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def put_if_absent(self, path: str, text: str) -> bool:
        """Whether the file was put; never replaces one."""
        draft = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.draft"
        self.write(draft, text)
        try:
            if self.system.getUri().getScheme() == "file":
                local = lambda p: self._path(p).toUri().getPath()
                try:
                    os.link(local(draft), local(path))
                except FileExistsError:
                    return False
                return True
            options = self.jvm.org.apache.hadoop.fs.Options.Rename
            plain = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at.toUri(), self.conf)
            none = self.jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 1)
            none[0] = options.NONE
            try:
                plain.rename(self._path(draft), self._path(path), none)
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    return False
                raise
            return True
        finally:
            self.system.delete(self._path(draft), False)

    def delete(self, path: str) -> None:
        self.system.delete(self._path(path), True)


def log(spark: SparkSession, path: str) -> list[Commit]:
    """All commits of a table in order; none where there is no table."""
    files = _Files(spark, path)
    found = [n for n in files.names(f"{path}/_log") if n.endswith(".json") and not n.startswith(".")]
    return [Commit(**json.loads(files.read(f"{path}/_log/{n}"))) for n in found]


def folders(commits: list[Commit], version: int | None = None) -> list[str]:
    """The folders that make up a version (the latest one unless told)."""
    there: list[str] = []
    for c in commits:
        if version is not None and c.version > version:
            break
        there = [x for x in there if x not in set(c.removed)] + c.added
    return there


def commit(spark: SparkSession, path: str, operation: str, change: Callable[[list[Commit]], tuple[list[str], list[str]]], token: str | None = None, rows: int | None = None) -> int:
    """Puts the next version; change(commits) gives the folders added and removed, or raises Conflict. The version's number."""
    files = _Files(spark, path)
    for _ in range(ATTEMPTS):
        known = log(spark, path)
        if token is not None and (done := [c.version for c in known if c.token == token]):
            return done[0]
        added, removed = change(known)
        new = Commit(known[-1].version + 1 if known else 0, operation, added, removed, token, rows)
        if files.put_if_absent(f"{path}/_log/{new.version:020d}.json", json.dumps(new.__dict__)):
            return new.version
    raise Conflict(f"{path}: {ATTEMPTS} attempts at a version")


def _written(rows: DataFrame, path: str) -> tuple[str, int]:
    name, seen = f"data/{uuid.uuid4().hex}", Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/{name}")
    return name, seen.get["n"]


def append(rows: DataFrame, path: str, token: str | None = None) -> int:
    """Adds rows as a new version; with a token that is there already nothing is written."""
    spark = rows.sparkSession
    if token is not None and (done := [c.version for c in log(spark, path) if c.token == token]):
        return done[0]
    name, n = _written(rows, path)
    return commit(spark, path, "append", lambda _: ([name], []), token, n)


def replace(rows: DataFrame, path: str, read: int | None = None, token: str | None = None) -> int:
    """Rows instead of all that is there. With `read`, only if that is still the latest version (-1: no table)."""
    spark = rows.sparkSession
    name, n = _written(rows, path)

    def change(known: list[Commit]) -> tuple[list[str], list[str]]:
        latest = known[-1].version if known else -1
        if read is not None and read != latest:
            raise Conflict(f"{path}: read at version {read}, now at {latest}")
        return [name], folders(known)

    return commit(spark, path, "replace", change, token, n)


def upsert(changes: DataFrame, path: str, key: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = 64, token: str | None = None) -> int:
    """Merges changes into a table that lies in buckets of a key's hash; merge(old rows or None, changes) gives the new rows.

    Only buckets that the changes touch are read and written. Fails if another writer has changed one of them meanwhile.
    """
    spark, bucket = changes.sparkSession, F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")
    known = log(spark, path)
    if token is not None and (done := [c.version for c in known if c.token == token]):
        return done[0]
    touched = {f"bucket={r.bucket}" for r in changes.select(bucket).distinct().collect()}  # one row a bucket at most
    old = [f for f in folders(known) if f.rsplit("/", 1)[-1] in touched]
    rows = merge(spark.read.option("mergeSchema", True).parquet(*(f"{path}/{f}" for f in old)) if old else None, changes)
    name = f"data/{uuid.uuid4().hex}"
    rows.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{path}/{name}")
    written = [f"{name}/{n}" for n in _Files(spark, path).names(f"{path}/{name}") if n.startswith("bucket=")]

    def change(now: list[Commit]) -> tuple[list[str], list[str]]:
        there = [f for f in folders(now) if f.rsplit("/", 1)[-1] in touched]
        if there != old:
            raise Conflict(f"{path}: another writer changed a bucket")
        return written, old

    return commit(spark, path, "upsert", change, token)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """Rows of a version under the union of its columns; None where there is no table or no such version."""
    known = log(spark, path)
    if not known or (version is not None and version not in {c.version for c in known}):
        return None
    names = folders(known, version)
    return spark.read.option("mergeSchema", True).parquet(*(f"{path}/{n}" for n in names)) if names else None


def latest(spark: SparkSession, path: str) -> int:
    """The latest version; -1 where there is no table."""
    known = log(spark, path)
    return known[-1].version if known else -1


def history(spark: SparkSession, path: str) -> DataFrame:
    """version, operation, n_folders (of that version), rows (written), token of each commit."""
    known = log(spark, path)
    rows = [(c.version, c.operation, len(folders(known, c.version)), c.rows, c.token) for c in known]
    return spark.createDataFrame(rows, "version long, operation string, n_folders long, rows long, token string")


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes folders that the latest version does not have, of old versions and of writers that failed (none may be at work)."""
    files, kept = _Files(spark, path), set(folders(log(spark, path)))
    gone = [n for n in files.names(f"{path}/data") if not any(f == f"data/{n}" or f.startswith(f"data/{n}/") for f in kept)]
    for n in gone:
        files.delete(f"{path}/data/{n}")
    return len(gone)
