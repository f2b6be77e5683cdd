"""The zone batches end to end: what the next zone gets from the tables of the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sonolake.functions.clean import blank_to_null, to_number
from sonolake.operators import features, zones
from sonolake.plans import kpi
from sonolake.sources import objects, tables
from sonolake.sources.observations import with_internal_names

#: Columns of a candidate report, of which those that a table has are shown.
CANDIDATE = ("uuid", "source_id", "category", "source", "symmetry_score", "pattern_stability_score", "combined_score", "peak_frequency_hz", "audio_path")


def existing(df: DataFrame, *columns: str) -> DataFrame:
    """The listed columns that are there, in the order listed."""
    return df.select(*(F.col(f"`{c}`") for c in columns if c in df.columns))


def preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of an order."""
    return df.orderBy(*order).limit(n)


def positive_peak(df: DataFrame, column: str = "peak_frequency_hz") -> DataFrame:
    """Rows whose peak is a number above 0."""
    return df.where(to_number(F.col(column)) > 0)


def archived_events(archive: DataFrame) -> DataFrame:
    """uuid, device, event_time of archived events (as read by tables.read_events): the id is the audio path's, else the archive file's."""
    of_file = F.nullif(F.regexp_extract("file", r"([^/]+)\.json$", 1), F.lit(""))
    uuid = F.coalesce(zones.uuid_of_path(F.trim("audio_path")), of_file)
    return archive.select(uuid.alias("uuid"), blank_to_null(F.col("device")).alias("device"), blank_to_null(F.col("timestamp")).alias("event_time")).where(F.length("uuid") > 0)


def trusted_batch(landing: DataFrame, events: DataFrame, trusted: DataFrame | None) -> DataFrame:
    """Landing rows to be enriched: trimmed, with id and path, the latest of each id, the event's device and time, not in the trusted zone yet."""
    rows = zones.required_keys(zones.trim_all(with_internal_names(landing)), "uuid", "audio_path")
    rows = zones.merge_events(zones.latest(rows, ["uuid"], "time_recorded", "source_id"), events)
    return rows if trusted is None or "uuid" not in trusted.columns else zones.pending(rows, trusted)


#: Fixed value: the version that rows of the last zone name.
FEATURE_VERSION = "1.0.0"


def exploitation_batch(trusted: DataFrame, waves: DataFrame, done: DataFrame | None, samples: Column | None = None) -> DataFrame:
    """Trusted rows that the last zone lacks, with the spectral features of their waveforms; rows without a waveform have nulls.

    The harmonic ratio goes by the peak that the row has, not by one found again. Features are worked out once for each key and
    peak in one pass over the waveforms; of several waveforms with one key those with the smallest features count.
    With `samples`, an expression over the other columns of `waves`, samples are made where features are worked out, and only keys
    and those columns are shuffled; a column of samples is shuffled with its rows where the keys are too many for a broadcast.
    """
    rows = zones.required_keys(zones.trim_all(with_internal_names(trusted)), "uuid", "audio_path")
    if done is not None and "uuid" in done.columns:
        rows = zones.pending(rows, done)
    new = [*features.FEATURES, "harmonic_energy_ratio", "mfccs"]
    rows = rows.drop(*new, "audio_seconds").withColumn("_peak", F.coalesce(to_number(F.col("peak_frequency_hz")), F.lit(0.0)))
    peaks = rows.select("uuid", F.col("_peak").alias("base_hz")).distinct()
    heard = waves.join(peaks, "uuid")
    if samples is not None:
        heard = objects.spread(heard, "uuid").withColumn("samples", samples)
    own = features.spectral_of(heard).groupBy("uuid", F.col("base_hz").alias("_peak"))
    own = own.agg(F.min(F.struct(F.col("seconds").alias("audio_seconds"), *new)).alias("f")).select("uuid", "_peak", "f.*")
    return rows.join(own, ["uuid", "_peak"], "left").drop("_peak")


def finished(batch: DataFrame) -> DataFrame:
    """Rows of a batch for the last zone: those with audio of at least a second, and the version of the features."""
    return batch.where("audio_seconds >= 1").drop("audio_seconds").withColumn("feature_version", F.lit(FEATURE_VERSION))


def run_and_append(spark: SparkSession, make: Callable[[DataFrame | None], DataFrame], path: str) -> int:
    """Appends a batch to the table at a path, given what is there; the number of rows added. A second run adds none."""
    added = Observation()
    tables.append(make(tables.read_parquet(spark, path)).observe(added, F.count(F.lit(1)).alias("n")), path)
    return added.get["n"]


def sync_all(spark: SparkSession, zones_of: dict[str, tuple[str, str]]) -> dict[str, int | None]:
    """A snapshot of each zone's table (name: source, target); None where there is nothing to take."""
    return {name: tables.sync_snapshot(spark, source, target) for name, (source, target) in zones_of.items()}


def best_candidates(obs: DataFrame, n: int = 10) -> DataFrame:
    """The best candidates with the report's columns that the table has, ranked."""
    score = (to_number(F.col("symmetry_score")) + to_number(F.col("pattern_stability_score"))) / 2
    best = preview(obs.withColumn("combined_score", score).where("combined_score is not null").withColumn("_down", -F.col("combined_score")), n, "_down", "uuid")
    ranked = kpi.ranked(best, n, F.desc("combined_score"), "uuid")
    return existing(ranked, "rank", *CANDIDATE)


#: The menu of KPIs by their keys.
CATALOGUE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "1": kpi.top_mode_share, "2": best_candidates, "3": kpi.cluster_top_categories, "4": kpi.closest_pairs_unique, "5": kpi.processing_time,
    "6": kpi.complex_categories, "7": kpi.bright_dark_categories,
}


def run_all(obs: DataFrame) -> dict[str, DataFrame]:
    """Every KPI of the catalogue over one table."""
    return {name: make(obs) for name, make in CATALOGUE.items()}


def event_id(*parts: str):
    """An id that depends on the parts alone, so that a repeated run gives the same one."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 32)
