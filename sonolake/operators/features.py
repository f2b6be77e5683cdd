"""Acoustic features as one map over waveform rows; a row that fails keeps null features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from sonolake.functions import dsp

FEATURES = ("spectral_centroid_hz", "spectral_bandwidth_hz", "spectral_rolloff_hz", "spectral_flatness", "signal_energy", "spectral_entropy", "zero_crossing_rate", "loudness")
PEAK = ("peak_frequency_hz", "peak_time_s", "peak_amplitude", "peak_rms")


def with_features(waves: DataFrame) -> DataFrame:
    """uuid, the spectral features, peak and its window's strongest peaks, harmonic ratio and MFCC means of (uuid, samples, sample_rate) rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for uuid, samples, rate in zip(frame["uuid"], frame["samples"], frame["sample_rate"], strict=True):
                row: dict = dict.fromkeys(("uuid", *FEATURES, *PEAK, "peaks_hz", "harmonic_energy_ratio", "mfccs")) | {"uuid": uuid}
                try:
                    x = dsp.normalise(np.asarray(samples, float))
                    if x.ndim != 1:
                        raise ValueError("no samples")
                    row |= dsp.spectral(x, int(rate)) | dsp.peak_frequency(x, int(rate))
                    row |= {"harmonic_energy_ratio": dsp.harmonic_ratio(x, int(rate), row["peak_frequency_hz"]), "mfccs": dsp.mfcc_mean(x, int(rate))}
                except (TypeError, ValueError):
                    pass  # null features; the row stays
                rows.append(row)
            yield pd.DataFrame(rows, columns=["uuid", *FEATURES, *PEAK, "peaks_hz", "harmonic_energy_ratio", "mfccs"])

    kinds = ", ".join(f"{c} {'string' if c == 'peaks_hz' else 'double'}" for c in (*FEATURES, *PEAK, "peaks_hz", "harmonic_energy_ratio"))
    return waves.where("uuid is not null and uuid <> ''").select("uuid", "samples", "sample_rate").mapInPandas(run, f"uuid string, {kinds}, mfccs array<double>")


def spectral_of(waves: DataFrame) -> DataFrame:
    """uuid, base_hz, seconds, the spectral features, MFCC means and the harmonic ratio at base_hz of (uuid, samples, sample_rate, base_hz)
    rows, in one pass over the samples; what fails has nulls."""
    names = ["uuid", "base_hz", "seconds", *FEATURES, "harmonic_energy_ratio", "mfccs"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for uuid, samples, rate, base in zip(frame["uuid"], frame["samples"], frame["sample_rate"], frame["base_hz"], strict=True):
                row: dict = dict.fromkeys(names) | {"uuid": uuid, "base_hz": base}
                try:
                    x = dsp.normalise(np.asarray(samples, float))
                    if x.ndim != 1:
                        raise ValueError("no samples")
                    row |= {"seconds": len(x) / int(rate)} | dsp.spectral(x, int(rate))
                    row |= {"harmonic_energy_ratio": dsp.harmonic_ratio(x, int(rate), base), "mfccs": dsp.mfcc_mean(x, int(rate))}
                except (TypeError, ValueError, ZeroDivisionError):
                    pass  # null features; the row stays
                rows.append(row)
            yield pd.DataFrame(rows, columns=names)

    kinds = ", ".join(f"{c} double" for c in names[1:-1])
    return waves.select("uuid", "samples", "sample_rate", F.col("base_hz").cast("double").alias("base_hz")).mapInPandas(run, f"uuid string, {kinds}, mfccs array<double>")


def long_enough(waves: DataFrame) -> DataFrame:
    """Waveforms of at least one second."""
    return waves.where("size(samples) >= sample_rate")


def sliding_windows(waves: DataFrame) -> DataFrame:
    """uuid, offset, energy of quarter-second windows at half steps; a short signal is one window.

    The energy is the sum of the power over the one-sided spectrum. By Parseval that is half of n times the sum of squares
    and of the power of the bins that have no mirror: the mean's and, for even n, the highest one's.
    """
    width = F.floor(F.col("sample_rate") * 0.25).cast("int")
    step = F.greatest((width / 2).cast("int"), F.lit(1))
    offsets = F.when(F.size("samples") > width, F.sequence(F.lit(0), F.size("samples") - width - 1, step)).otherwise(F.array(F.lit(0)))
    length = F.when(F.size("samples") > width, width).otherwise(F.size("samples"))
    cut = waves.where("size(samples) > 0").select("uuid", "samples", length.alias("w"), F.explode(offsets).alias("offset"))
    cut = cut.select("uuid", "offset", "w", F.slice("samples", F.col("offset") + 1, F.col("w")).alias("x"))
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    mean, squares = total(F.col("x")), total(F.transform("x", lambda x: x * x))
    highest = F.when(F.col("w") % 2 == 0, total(F.transform("x", lambda x, i: F.when(i % 2 == 0, x).otherwise(-x)))).otherwise(F.lit(0.0))
    return cut.select("uuid", "offset", ((F.col("w") * squares + mean * mean + highest * highest) / 2).alias("energy"))


def harmonic_vote(candidates: DataFrame, harmonics: int = 4) -> DataFrame:
    """key, bin: for each key the bin that gathers most energy from its small multiples.

    candidates: key, place (order of the windows), bin, energy. Equal sums go to the bin seen first.
    """
    spread = candidates.where("bin > 0").select("key", "place", "bin", "energy", F.explode(F.sequence(F.lit(1), F.lit(harmonics))).alias("d")).where("bin % d = 0")
    sums = spread.groupBy("key", (F.col("bin") / F.col("d")).cast("long").alias("bin")).agg(F.sum("energy").alias("energy"), F.min(F.struct("place", "d")).alias("seen"))
    best = F.row_number().over(W.partitionBy("key").orderBy(F.desc("energy"), "seen"))
    return sums.withColumn("rn", best).where("rn = 1").select("key", "bin")


def fit_length(waves: DataFrame, seconds: float) -> DataFrame:
    """Samples cut or padded with zeros to a length."""
    n = F.floor(F.col("sample_rate") * seconds).cast("int")
    padded = F.concat("samples", F.array_repeat(F.lit(0.0), F.greatest(n - F.size("samples"), F.lit(0))))
    return waves.withColumn("samples", F.slice(padded, F.lit(1), n))


def harmonic_share(waves: DataFrame, f0: Column) -> DataFrame:
    """uuid, harmonic_energy_ratio: share of power near the first eight harmonics of f0 (null samples: null)."""

    @F.pandas_udf("double")
    def share(samples: pd.Series, rate: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else dsp.harmonic_ratio(dsp.normalise(np.asarray(x, float)), int(r), float(b)) for x, r, b in zip(samples, rate, base, strict=True)], dtype=float)

    return waves.select("uuid", share("samples", "sample_rate", f0).alias("harmonic_energy_ratio"))


def cepstra(waves: DataFrame, count: int = 13, n_fft: int = 2048, hop: int = 512, mels: int = 40) -> DataFrame:
    """uuid, mfccs: mean cepstra over frames of n_fft samples (zeros for less than one frame)."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def means(samples: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([dsp.mfcc_mean(np.asarray(x, float), int(r), count, n_fft, hop, mels) for x, r in zip(samples, rate, strict=True)], dtype=object)

    return waves.where("samples is not null and sample_rate is not null").select("uuid", means("samples", "sample_rate").alias("mfccs"))


def frame_profiles(waves: DataFrame, frames: int, scale: float = 15.0) -> DataFrame:
    """uuid, frame, rms, dominant_hz, spatial and magnitude arrays of equal frames (what is left over at the end belongs to none)."""
    length = F.floor(F.size("samples") / frames).cast("int")
    numbered = waves.where(F.size("samples") >= frames).select("uuid", "sample_rate", "samples", length.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("frame"))

    @F.pandas_udf("rms double, spatial array<double>, magnitude array<double>, dominant_hz double")
    def profile(part: pd.Series, rate: pd.Series) -> pd.DataFrame:
        found = [dsp.frame_profile(np.asarray(x, float), scale, int(r)) for x, r in zip(part, rate, strict=True)]
        return pd.DataFrame(found, columns=["rms", "spatial", "magnitude", "dominant_hz"])

    cut = numbered.select("uuid", "frame", profile(F.slice("samples", F.col("frame") * F.col("n") + 1, F.col("n")), "sample_rate").alias("p"))
    return cut.select("uuid", "frame", "p.*")
