"""Schemas of the zone tables, and an observation view over the events table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Boundary names with characters that table formats reject, and their names here.
ALIASES = {"time_recorded/added": "time_recorded", "processing_time(seconds)": "processing_time_seconds", "feature_processing_time(seconds)": "feature_processing_time_seconds"}

LANDING = "uuid string, source_id string, time_recorded string, duration double, audio_size long, audio_path string, audio_format string, source string, peak_frequency_hz double, tags array<string>, description string, category string"
HOT_EVENT = "audio_path string, bucket string, timestamp string, sample_rate int, duration int, device string"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_internal_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in ALIASES.items() if k in df.columns})


def with_boundary_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({v: k for k, v in ALIASES.items() if v in df.columns})


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    first = lambda *pairs: reduce(lambda c, p: c.when(e % p[0] == 0, p[1]), pairs[1:], F.when(e % pairs[0][0] == 0, pairs[0][1]))
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("ev-"), F.lpad(e.cast("string"), 8, "0")).alias("uuid"),
        F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("source_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time_recorded"),
        F.expr("case event_type when 'view' then 'warm-path' when 'click' then 'hot-path' when 'purchase' then 'Freesound' when 'signup' then ' ESC-50 ' when 'error' then '-' end").alias("source"),
        first((41, "-"), (43, "nan"), (47, "None"), (53, ""), (61, F.lit(None).cast("string"))).otherwise(F.concat(F.lit(" cat_"), F.lpad((k % 17).cast("string"), 2, "0"))).alias("category"),
        first((37, "None"), (59, ""), (67, "nan")).otherwise((F.col("value") * 10).cast("string")).alias("peak_frequency_hz"),
        ((e * 7919) % 1000 / F.lit(1000.0)).alias("symmetry_score"),
        ((e * 104729) % 1000 / F.lit(1000.0)).alias("pattern_stability_score"),
        F.col("value").alias("processing_time_seconds"), (F.col("value") / 10).alias("spectral_entropy"), (F.col("value") * 20).alias("spectral_centroid_hz"),
    )
