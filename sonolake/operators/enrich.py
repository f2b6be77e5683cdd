"""From landing rows and their audio objects to rows of the trusted zone, in one pass over the objects."""

from __future__ import annotations

import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolake.functions import dsp
from sonolake.operators import zones
from sonolake.sources import objects, tables, versions

#: Fixed value: the version that rows of the trusted zone name.
PROCESSING_VERSION = "2.0.0"
_FOUND = {"duration": "double", "peak_frequency_hz": "double", "peak_time_s": "double", "peak_amplitude": "double", "peak_rms": "double", "all_peak_frequencies_hz": "string", "reason": "string"}
REASONS = ("no audio_path", "no object", "does not decode", "too short", "no frequency")


def _listen(uri: str | None) -> dict:
    if not uri:
        return {"reason": "no audio_path"}
    try:
        rate, x = tables.decode_wav(objects.get(uri))
    except (FileNotFoundError, OSError):
        return {"reason": "no object"}
    except (wave.Error, EOFError, ValueError):
        return {"reason": "does not decode"}
    if len(x) < rate:
        return {"reason": "too short"}
    found = dsp.peak_frequency(dsp.normalise(x), rate)
    if found["peak_frequency_hz"] <= 0:
        return {"reason": "no frequency"}
    return {k: found[k] for k in ("peak_frequency_hz", "peak_time_s", "peak_amplitude", "peak_rms")} | {"duration": len(x) / rate, "all_peak_frequencies_hz": found["peaks_hz"]}


def with_sound(rows: DataFrame, root: str) -> DataFrame:
    """Rows with duration, peak frequency, time, amplitude and loudness of its window, its strongest peaks, and the reason why a row has none.

    A task reads the objects of its rows at `audio_path` below `root`, one at a time. Columns of these names are replaced.
    """
    rows = rows.drop(*_FOUND)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [_listen(f"{root}/{p.strip()}" if isinstance(p, str) and p.strip() else None) for p in frame["audio_path"]]
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(found, columns=list(_FOUND)).replace({np.nan: None})], axis=1)

    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism  # few small rows stand for much work
    return rows.repartition(tasks, "audio_path").mapInPandas(run, f"{kinds}, {', '.join(f'{c} {k}' for c, k in _FOUND.items())}")


def enriched(rows: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(trusted rows, rejected rows with their reason): trusted rows have landing_path, where the object is, and audio_path, where it goes."""
    return parted(with_sound(rows, root))


def parted(heard: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As enriched(), of rows with sound."""
    hz = F.rint("peak_frequency_hz").cast("long").cast("string")
    path = F.concat(F.lit("audio/"), hz, F.lit("/"), "uuid", F.lit("-"), hz, F.lit(".wav"))
    good = heard.where("reason is null").withColumn("landing_path", F.trim("audio_path")).withColumns({"audio_path": path, "processing_version": F.lit(PROCESSING_VERSION)})
    return good.drop("reason"), heard.where("reason is not null")


def to_trusted(rows: DataFrame, landing: str, trusted: str, manifest: str) -> tuple[DataFrame, DataFrame]:
    """Enriches landing rows and copies their objects to the trusted zone; (trusted rows with audio_size, rejected rows).

    Rows whose object could be neither copied nor encoded again are rejected with that reason.
    """
    good, bad = parted(versioned(with_sound(rows, landing), f"{manifest}-rows"))  # objects are read once, for good and rejected rows alike
    plan = good.select(F.concat(F.lit(f"{landing}/"), "landing_path").alias("source"), F.concat(F.lit(f"{trusted}/"), "audio_path").alias("target"))
    copied = objects.copy_objects(plan, manifest).select(F.col("target").alias("_target"), F.col("size").alias("audio_size"))
    out = good.drop("audio_size").withColumn("_target", F.concat(F.lit(f"{trusted}/"), "audio_path")).join(copied, "_target", "left").drop("_target")
    lost = out.where("audio_size is null").drop("audio_size", "audio_path", "processing_version").withColumn("reason", F.lit("not copied"))
    return out.where("audio_size is not null").drop("landing_path"), bad.unionByName(lost.withColumnRenamed("landing_path", "audio_path"), allowMissingColumns=True)


def versioned(rows: DataFrame, path: str) -> DataFrame:
    """Rows as a written table, so that what follows does not work them out again."""
    version = versions.replace(rows, path)
    return versions.read(rows.sparkSession, path, version)


def to_landing(events: DataFrame, root: str, manifest: str) -> tuple[DataFrame, DataFrame]:
    """(landing rows, rejected events with their reason) of good messages (audio_path, bucket, timestamp): the raw object moves to
    the place that its peak frequency names, within its bucket below `root`."""
    rows = events.select(zones.uuid_of_path(F.col("audio_path")).alias("uuid"), "bucket", "timestamp", "device", F.col("audio_path").alias("raw"), F.concat_ws("/", "bucket", "audio_path").alias("audio_path"))
    heard = versioned(with_sound(rows, root), f"{manifest}-heard")
    hz = F.rint("peak_frequency_hz").cast("long").cast("string")
    path = F.concat(F.lit("audio/hot-path/"), hz, F.lit("/"), "uuid", F.lit("-"), hz, F.lit(".wav"))
    good = heard.where("reason is null").withColumn("audio_path", path).withColumn("_target", F.concat(F.lit(f"{root}/"), "bucket", F.lit("/"), "audio_path"))
    moved = objects.copy_objects(good.select(F.concat(F.lit(f"{root}/"), "bucket", F.lit("/"), "raw").alias("source"), F.col("_target").alias("target")), manifest, move=True)
    out = good.join(moved.select(F.col("target").alias("_target"), F.col("size").alias("audio_size")), "_target", "left")
    blank = lambda c: F.lit("").alias(c)
    landing = out.where("audio_size is not null").select(
        "uuid", F.col("uuid").alias("source_id"), F.coalesce(F.nullif(F.trim("timestamp"), F.lit("")), F.lit("")).alias("time_recorded"), "duration", "audio_size", "audio_path",
        F.lit("wav").alias("audio_format"), F.lit("hot-path").alias("source"), "peak_frequency_hz", blank("tags"), blank("description"), blank("category"),
    )
    lost = out.where("audio_size is null").withColumn("reason", F.lit("not copied"))
    names = ["uuid", "raw", "reason"]
    return landing, heard.where("reason is not null").select(*names).unionByName(lost.select(*names))
