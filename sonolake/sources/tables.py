"""Readers and writers of zone tables, event archives, snapshots and waveforms."""

from __future__ import annotations

import hashlib
import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from sonolake.operators.zones import append_evolving, pending, since
from sonolake.sources import versions
from sonolake.sources.observations import HOT_EVENT


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is at a path (a pattern may be given), on whichever file system it names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def _glob(spark: SparkSession, path: str) -> list[str]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return [] if found is None else sorted(f.getPath().toString() for f in found)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A metadata table: header, all text, values over several lines, doubled quotes."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Archived hot events and the file each came from; an archive that is not there is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{HOT_EVENT}, file string")
    return spark.read.schema(HOT_EVENT).option("mode", "PERMISSIVE").json(path).withColumn("file", F.col("_metadata.file_path"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.option("mergeSchema", True).parquet(path) if exists(spark, path) else None


def append(rows: DataFrame, path: str) -> None:
    """Adds files; readers merge the schemas (nothing that is there is rewritten)."""
    rows.write.mode("append").parquet(path)


def append_text(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """What is at a path and the new rows as one text table, columns united, gaps empty."""
    old = read_parquet(spark, path)
    return append_evolving(old, rows) if old is not None else append_evolving(rows, rows.limit(0))


def export_csv(rows: DataFrame, path: str, first: tuple[str, ...] = ()) -> None:
    """CSV with the priority columns first, then the others as they come. Each list of columns has a folder of its own."""
    order = [c for c in first if c in rows.columns] + [c for c in rows.columns if c not in first]
    folder = hashlib.md5("\n".join(order).encode()).hexdigest()[:12]
    rows.select(*(F.col(f"`{c}`") for c in order)).write.mode("append").option("header", True).option("escape", '"').csv(f"{path}/columns={folder}")


def read_exports(spark: SparkSession, path: str) -> DataFrame | None:
    """All that was exported to a path under the union of its columns; what a row lacks is null."""
    out = None
    for folder in _glob(spark, f"{path}/columns=*"):
        part = read_csv(spark, folder)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write_snapshot(rows: DataFrame, path: str) -> int:
    """A new version of a table in place of the last one; old versions stay readable, and writers at once get versions of their own."""
    return versions.replace(rows, path)


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, int] | None:
    """(rows, version) of the latest version or of one that is named."""
    at = versions.latest(spark, path) if version is None else version
    rows = versions.read(spark, path, at)
    return None if rows is None else (rows, at)


def sync_snapshot(spark: SparkSession, source: str, target: str) -> int | None:
    """A snapshot of a zone's table; nothing for a table that is missing or empty."""
    rows = read_parquet(spark, source)
    return None if rows is None or rows.isEmpty() else write_snapshot(rows, target)


def inspect(spark: SparkSession, bucket: str, table: str = "snapshots") -> dict:
    """status (ok, missing_bucket, no_table, error), version, rows, cols, columns of a zone's table."""
    empty = {"version": None, "rows": None, "cols": None, "columns": []}
    try:
        if not exists(spark, bucket):
            return {"status": "missing_bucket", **empty}
        if (found := read_snapshot(spark, f"{bucket}/{table}")) is None:
            return {"status": "no_table", **empty}
        df, version = found
        return {"status": "ok", "version": version, "rows": df.count(), "cols": len(df.columns), "columns": df.columns}
    except Exception as e:  # a report on tables of unknown state names the failure
        return {"status": "error", **empty, "error": str(e)[:200]}


def read_checkpoint(spark: SparkSession, path: str) -> str | None:
    """The start of the last run that ended well."""
    found = read_snapshot(spark, path)
    return found[0].first()["started"] if found else None


def write_checkpoint(spark: SparkSession, path: str, started: str) -> None:
    write_snapshot(spark.createDataFrame([(started,)], "started string").coalesce(1), path)


def ingest_since(rows: DataFrame, time: str, key: str, target: str, checkpoint: str, started: str) -> None:
    """Appends rows not older than the last run's start whose key is not there yet.

    This run's start is kept once the rows are written, also when there were none; a run that fails before is repeated without doubling rows.
    """
    spark = rows.sparkSession
    fresh = since(rows, time, read_checkpoint(spark, checkpoint)).dropDuplicates([key])
    if (old := read_parquet(spark, target)) is not None:
        fresh = pending(fresh, old, key)
    append(fresh, target)
    write_checkpoint(spark, checkpoint, started)


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(sample rate, mono samples in -1 .. 1) of PCM of any width; channels are averaged."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, raw = w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())
        rate = w.getframerate()
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) - ((b[:, 2] >> 7) << 24)) / 2.0**23
    else:
        x = np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)
    return rate, x if channels == 1 else x.reshape(-1, channels).mean(axis=1)


def encode_wav(x: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


@F.pandas_udf(StructType([StructField("sample_rate", IntegerType()), StructField("samples", ArrayType(DoubleType()))]))
def decoded(content: pd.Series) -> pd.DataFrame:
    """sample_rate and samples of WAV bytes; nulls for what does not decode."""
    found: list[tuple] = []
    for data in content:
        try:
            found.append(decode_wav(data))
        except (TypeError, wave.Error, EOFError, ValueError):
            found.append((None, None))
    return pd.DataFrame(found, columns=["sample_rate", "samples"]).astype({"sample_rate": "Int32"})


def read_waves(spark: SparkSession, path: str) -> DataFrame:
    """path, sample_rate, samples of every WAV file below a path; files that do not decode have nulls."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path)
    return files.select("path", decoded("content").alias("w")).select("path", "w.*")
