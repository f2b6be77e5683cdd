"""Single objects (audio files and the like) written, copied and moved by executors, with manifests; no bytes go through the driver.

Objects are named by URI on any file system that pyarrow reaches from all machines (file, hdfs, s3, gs). A target gets its name once
it is whole.
"""

from __future__ import annotations

import errno
import hashlib
import os
import re
import uuid
import wave
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sonolake.sources import tables, versions

CHUNK = 1 << 20
_DONE = ("copied", "re-encoded")
MANIFEST = "source string, target string, size long, sha256 string, status string, error string"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path on it; also for file:/x, as Spark names files."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def _draft(path: str) -> str:
    folder, _, name = path.rpartition("/")
    return f"{folder}/.{name}.{uuid.uuid4().hex}"


def _to_existing(system: fs.FileSystem, path: str, act: Callable[[], pa.NativeFile | None]) -> pa.NativeFile | None:
    """What act() gives, which puts something at a path; its folder is made once that turns out to be missing, not asked for each time."""
    try:
        return act()
    except FileNotFoundError:
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return act()


def _created(system: fs.FileSystem, path: str) -> pa.NativeFile:
    return _to_existing(system, path, lambda: system.open_output_stream(path))


@contextmanager
def drafts(root: str) -> Iterator[str]:
    """The path of a folder next to `root` for the drafts of one task, which goes when the task ends."""
    system, path = place(f"{root.rstrip('/')}.drafts/{uuid.uuid4().hex}")
    try:
        yield path
    finally:
        if system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir(path)


def put(uri: str, data: bytes, own: str | None = None) -> None:
    """With `own`, a folder of this task alone (see drafts()), the draft is made there: tasks that put objects into one folder then
    wait for each other at an object's entry alone, not at its draft's as well."""
    system, path = place(uri)
    draft = _draft(path) if own is None else f"{own}/draft"
    with _created(system, draft) as out:
        out.write(data)
    _to_existing(system, path, lambda: system.move(draft, path))


def get(uri: str) -> bytes:
    system, path = place(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def copy(source: str, target: str) -> None:
    """Byte for byte, a chunk at a time."""
    (own, a), (other, b) = place(source), place(target)
    with own.open_input_stream(a) as f:
        draft = _draft(b)
        with _created(other, draft) as out:
            while chunk := f.read(CHUNK):
                out.write(chunk)
    other.move(draft, b)


def rename_later(source: str, target: str) -> bool:
    """As copy(), for a source that is deleted afterwards: on one local file system the target is a second name of the same bytes (True)."""
    (own, a), (other, b) = place(source), place(target)
    if isinstance(own, fs.LocalFileSystem) and isinstance(other, fs.LocalFileSystem) and not os.path.islink(a):
        try:
            _to_existing(other, b, lambda: os.link(a, b))
            return True
        except FileNotFoundError:  # there is no source
            raise
        except FileExistsError:
            if os.path.samefile(a, b):  # of a run that failed before its commit
                return True
        except OSError:  # another device, or no second names there
            pass
    copy(source, target)
    return False


def digest(uri: str) -> tuple[int, str]:
    """(size, SHA-256) of an object."""
    system, path = place(uri)
    seen, size = hashlib.sha256(), 0
    with system.open_input_stream(path) as f:
        while chunk := f.read(CHUNK):
            seen.update(chunk)
            size += len(chunk)
    return size, seen.hexdigest()


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Small rows that stand for much work each, dealt by keys to four tasks for each core (otherwise they fit into one or two)."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def _length(base: tuple[fs.FileSystem, str] | None, name: str | None) -> int | None:
    if not name or (base and not {"", ".", ".."}.isdisjoint(name.split("/"))):  # below a folder only plain names are objects
        return None
    try:
        system, path = (base[0], f"{base[1].rstrip('/')}/{name}") if base else place(name)
        found = system.get_file_info(path)
    except ValueError:  # no name that a file system could have
        return None
    except OSError as e:
        if e.errno in (errno.ENAMETOOLONG, errno.ENOTDIR, errno.EINVAL):
            return None
        raise
    return found.size if found.type == fs.FileType.File else None


def length_of(uri: Column, root: str | None = None) -> Column:
    """The length of the object of a URI (with a root: of a name below it); null where there is none.

    Each task asks for the objects of its rows, so the work goes by the rows and no list of a folder goes through the driver.
    """

    def run(uris: pd.Series) -> pd.Series:
        base = None if root is None else place(root)
        return pd.Series([_length(base, u) for u in uris], dtype="Int64")

    return F.pandas_udf(run, LongType()).asNondeterministic()(uri)  # asked once for each row


def listing(spark: SparkSession, root: str) -> DataFrame:
    """uri, name (below the root) and length of every object below a folder; the objects are not read.

    The driver holds the list: for folders of few objects. Whether known objects are there says length_of().
    """
    if not tables.exists(spark, root):
        return spark.createDataFrame([], "uri string, name string, length long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.substring_index("path", root.rstrip("/").split(":", 1)[-1].replace("//", "") + "/", -1)
    return files.select(F.col("path").alias("uri"), below.alias("name"), "length")


def _value(v: pa.Scalar):
    """A row's value; an array of numbers as a NumPy array."""
    listed = v.is_valid and pa.types.is_list(v.type) and pa.types.is_floating(v.type.value_type)
    return v.values.to_numpy(zero_copy_only=False) if listed else v.as_py()


def write_objects(rows: DataFrame, root: str, content: Callable[[dict], bytes | None] | None = None, deal: bool = True) -> DataFrame:
    """Puts each (name, content) below a folder; name, size, sha256 of what was put (a table next to the folder).

    With `content`, the bytes of a row are made from its columns in the task that puts them, one object at a time (None: no
    object), and rows are dealt to all tasks (unless told not to, as for large rows); else they are a column, and rows stay where
    they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with drafts(root) as own:
            for batch in batches:
                yield put_all(batch, own)

    def put_all(batch: pa.RecordBatch, own: str) -> pa.RecordBatch:
        names, sizes, hashes = [], [], []
        for values in zip(*batch.columns, strict=True):
            row = {c: _value(v) for c, v in zip(batch.schema.names, values, strict=True)}
            if (data := row["content"] if content is None else content(row)) is not None:
                put(f"{root}/{row['name']}", data, own)
                names.append(row["name"])
                sizes.append(len(data))
                hashes.append(hashlib.sha256(data).hexdigest())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string())], names=["name", "size", "sha256"])

    known = rows.where("name is not null")
    known = known.where("content is not null").select("name", "content") if content is None else spread(known, "name") if deal else known
    versions.append(known.mapInArrow(run, "name string, size long, sha256 string"), f"{root.rstrip('/')}.objects")
    return versions.read(rows.sparkSession, f"{root.rstrip('/')}.objects")


def _copied(source: str, target: str, copier: Callable[[str, str], bool | None]) -> tuple:
    """One row of the manifest. What cannot be copied as it is but decodes is put as a waveform of one channel."""
    try:
        try:
            same = copier(source, target)  # True: a second name, which has no bytes of its own to compare
            size, own = digest(target)
            if same is not True and (size, own) != digest(source):
                raise OSError("the copy differs")
            return size, own, "copied", None
        except FileNotFoundError:
            return None, None, "missing", "no object"
        except OSError:
            rate, x = tables.decode_wav(get(source))
            put(target, tables.encode_wav(x, rate))
            return *digest(target), "re-encoded", None
    except (OSError, EOFError, ValueError, wave.Error) as e:
        return None, None, "failed", str(e)[:200]


def copy_objects(plan: DataFrame, manifest: str, move: bool = False, copier: Callable[[str, str], bool | None] | None = None) -> DataFrame:
    """Copies each (source, target) that the manifest does not have yet; the manifest's rows of the plan.

    The manifest is a versioned table, committed after all copies are whole. A move deletes sources only then, so a run that fails
    before is repeated; sources left by one that failed after are deleted by the next run. A repeated copy or move does nothing.
    Objects that were missing or failed are tried again.
    """
    spark = plan.sparkSession
    copier = copier or (rename_later if move else copy)
    plan = spread(plan.where("source is not null and target is not null").select("source", "target"), "source", "target").distinct()

    def finished() -> DataFrame | None:
        known = versions.read(spark, manifest)
        return None if known is None else known.where(F.col("status").isin(*_DONE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_copied(a, b, copier) for a, b in zip(batch.column("source").to_pylist(), batch.column("target").to_pylist(), strict=True)]
            kinds = [pa.int64(), *[pa.string()] * 3]
            columns = [pa.array(c, k) for c, k in zip(list(zip(*found, strict=True)) or [[]] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("target"), *columns], names=[c.split()[0] for c in MANIFEST.split(", ")])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for uri in batch.column("source").to_pylist():
                system, path = place(uri)
                there = system.get_file_info(path).type == fs.FileType.File
                if there:
                    with suppress(FileNotFoundError):  # a source of two targets may come to two tasks at once
                        system.delete_file(path)
                gone.append(there)
            yield pa.RecordBatch.from_arrays([batch.column("source"), pa.array(gone, pa.bool_())], names=["source", "gone"])

    done = finished()
    todo = plan if done is None else plan.join(done, ["source", "target"], "left_anti")  # stays dealt to all tasks, as does the report
    versions.append(todo.mapInArrow(run, MANIFEST), manifest)
    last = F.max(F.struct(F.col("status").isin(*_DONE).alias("good"), "size", "sha256", "status", "error")).alias("r")
    known = versions.read(spark, manifest)
    report = known.join(plan, ["source", "target"]).groupBy("source", "target").agg(last).select("source", "target", "r.size", "r.sha256", "r.status", "r.error")
    if move:
        whole = known.where(F.col("status").isin(*_DONE)).select("source", "target")  # the report's hashes need not be dealt for this
        plan.join(whole, ["source", "target"], "left_semi").select("source").mapInArrow(remove, "source string, gone boolean").write.format("noop").mode("overwrite").save()
    return report
