"""The KPI catalogue: each takes an observation frame and returns a typed frame (empty when there is nothing)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonolake.functions import pairs
from sonolake.functions.clean import band, finite, no_sentinel, np_round, to_number


def number(df: DataFrame, name: str) -> Column:
    """A column as double: finite numbers as they are (others: null), text by to_number()."""
    kind, c = dict(df.dtypes)[name], F.col(name)
    if kind in ("double", "float"):
        return finite(c.cast("double"))
    return c.cast("double") if kind in ("tinyint", "smallint", "int", "bigint") else to_number(c)


def typed(obs: DataFrame) -> DataFrame:
    """Cleaned category and source, numeric peak."""
    return obs.withColumns({"category": no_sentinel(F.col("category")), "source": no_sentinel(F.col("source")), "peak": number(obs, "peak_frequency_hz")})


def _peaks(obs: DataFrame) -> DataFrame:
    counted = typed(obs).na.drop(subset=["category", "peak"]).groupBy("category", F.rint("peak").cast("long").alias("frequency_hz_rounded")).agg(F.count(F.lit(1)).alias("occurrence_count"))
    return counted.withColumn("total", F.sum("occurrence_count").over(W.partitionBy("category")))


def mode_frequency(obs: DataFrame) -> DataFrame:
    """The most repeated rounded frequency of each category (ties: the lowest), and its share."""
    first = F.row_number().over(W.partitionBy("category").orderBy(F.desc("occurrence_count"), "frequency_hz_rounded"))
    share = np_round(F.col("occurrence_count") / F.col("total"), 4)
    return _peaks(obs).withColumn("rn", first).where("rn = 1").select("category", "frequency_hz_rounded", "occurrence_count", F.col("total").alias("total_in_category"), share.alias("share"))


def frequency_detail(obs: DataFrame, top: int = 5, like: str | None = None) -> DataFrame:
    """Frequencies of the `top` dense ranks in each category."""
    df = _peaks(obs)
    if like:
        df = df.where(F.col("category").rlike(f"(?i){like}"))
    rank = F.dense_rank().over(W.partitionBy("category").orderBy(F.desc("occurrence_count")))
    return df.withColumn("rank", rank).where(F.col("rank") <= top).select("category", "frequency_hz_rounded", "occurrence_count", "rank")


def ranked(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows and their position (a window over n rows)."""
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def top_mode_share(obs: DataFrame, n: int = 10) -> DataFrame:
    return ranked(mode_frequency(obs), n, F.desc("share"), "category")


def _scored(obs: DataFrame) -> DataFrame:
    s = obs.select("uuid", number(obs, "symmetry_score").alias("symmetry_score"), number(obs, "pattern_stability_score").alias("pattern_stability_score")).na.drop()
    return s.withColumn("score", (F.col("symmetry_score") + F.col("pattern_stability_score")) / 2)


def best_candidates(obs: DataFrame, n: int = 10) -> DataFrame:
    return ranked(_scored(obs), n, F.desc("score"), "uuid")


def best_candidates_dense(obs: DataFrame, n: int = 10) -> DataFrame:
    """Dense rank over all scores; only the n best rows are kept, so ranks are taken among them."""
    return _scored(obs).orderBy(F.desc("score"), "uuid").limit(n).withColumn("rank", F.dense_rank().over(W.orderBy(F.desc("score"))))


def frequency_clusters(obs: DataFrame) -> DataFrame:
    df = typed(obs).where(F.col("peak").isNotNull()).withColumn("band", band(F.col("peak")))
    out = df.groupBy("band").agg(F.count("uuid").alias("recording_count"), F.count_distinct("category").alias("category_count"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", np_round(F.col("recording_count") / F.sum("n").over(W.partitionBy()), 4)).drop("n")


def cluster_top_categories(obs: DataFrame, n: int = 3) -> DataFrame:
    df = typed(obs).na.drop(subset=["category", "peak"]).groupBy(band(F.col("peak")).alias("band"), "category").agg(F.count(F.lit(1)).alias("recording_count"))
    df = df.withColumn("share_within_band", np_round(F.col("recording_count") / F.sum("recording_count").over(W.partitionBy("band")), 4))
    rank = F.row_number().over(W.partitionBy("band").orderBy(F.desc("recording_count"), "category"))
    return df.withColumn("rank_in_band", rank).where(F.col("rank_in_band") <= n)


def _means(obs: DataFrame) -> DataFrame:
    return typed(obs).na.drop(subset=["category", "peak"]).groupBy("category").agg(F.avg("peak").alias("m"))


def category_pairs(obs: DataFrame) -> DataFrame:
    """All unordered pairs of categories with means and their difference, each rounded to two digits.

    One row for each category goes into the pairing, so its size is a property of the category list.
    """
    means = _means(obs)
    a, b = means.select(F.col("category").alias("category_a"), F.col("m").alias("ma")), means.select(F.col("category").alias("category_b"), F.col("m").alias("mb"))
    pairs = a.join(b, F.col("category_a") < F.col("category_b"))
    return pairs.select("category_a", "category_b", np_round(F.col("ma"), 2).alias("mean_a"), np_round(F.col("mb"), 2).alias("mean_b"), np_round(F.abs(F.col("ma") - F.col("mb")), 2).alias("difference"))


def _nearest(obs: DataFrame, n: int, choose) -> DataFrame:
    """Pairs that a search over the sorted means chooses: one row for each category in one task, no list of pairs."""

    def search(means: pd.DataFrame) -> pd.DataFrame:
        means = means.sort_values("category", key=lambda c: c.str.encode("utf-8")).reset_index(drop=True)
        m, name = means["m"].to_numpy(), means["category"]
        round_ = lambda x: float(np.rint(x * 100.0) / 100.0)
        rows = [(name[a], name[b], round_(m[a]), round_(m[b]), round_(abs(m[a] - m[b])), k) for k, (a, b) in enumerate(choose(m, np.arange(len(m)), n), 1)]
        return pd.DataFrame(rows, columns=["category_a", "category_b", "mean_a", "mean_b", "difference", "rank"])

    return _means(obs).groupBy().applyInPandas(search, "category_a string, category_b string, mean_a double, mean_b double, difference double, rank int")


def closest_pairs(obs: DataFrame, n: int = 10) -> DataFrame:
    """The n pairs of categories with the smallest rounded difference (ties: by names)."""
    return _nearest(obs, n, pairs.closest)


def closest_pairs_unique(obs: DataFrame, n: int = 10) -> DataFrame:
    """Greedy matching by ascending difference: each category at most once, n pairs at most."""
    return _nearest(obs, n, pairs.matched)


def processing_time(obs: DataFrame) -> DataFrame:
    df = typed(obs).withColumn("t", number(obs, "processing_time_seconds")).na.drop(subset=["source", "t"])
    out = df.groupBy("source").agg(F.avg("t").alias("avg"), F.stddev_samp("t").alias("std"), F.min("t").alias("min"), F.max("t").alias("max"), F.count("uuid").alias("recording_count"))
    return out.select("source", *(np_round(F.col(c), 3).alias(f"{c}_seconds") for c in ("avg", "std", "min", "max")), "recording_count")


def _by_category(obs: DataFrame, column: str) -> DataFrame:
    return typed(obs).withColumn("x", number(obs, column)).na.drop(subset=["category", "x"])


def complex_categories(obs: DataFrame, n: int = 10) -> DataFrame:
    g = _by_category(obs, "spectral_entropy").groupBy("category").agg(np_round(F.avg("x"), 4).alias("mean_entropy"), np_round(F.max("x"), 4).alias("max_entropy"), F.count("uuid").alias("recording_count"))
    return ranked(g, n, F.desc("mean_entropy"), "category")


def complex_recordings(obs: DataFrame, n: int = 10) -> DataFrame:
    df = typed(obs).select("uuid", "category", number(obs, "spectral_entropy").alias("spectral_entropy")).where("spectral_entropy is not null")
    return ranked(df, n, F.desc("spectral_entropy"), "uuid")


def bright_dark_categories(obs: DataFrame, n: int = 5) -> DataFrame:
    g = _by_category(obs, "spectral_centroid_hz").groupBy("category").agg(np_round(F.avg("x"), 2).alias("mean_centroid_hz"), F.count("uuid").alias("recording_count"))
    bright = ranked(g, n, F.desc("mean_centroid_hz"), "category").withColumn("group", F.lit("brightest"))
    dark = ranked(g, n, F.asc("mean_centroid_hz"), "category").withColumn("group", F.lit("darkest"))
    both = bright.unionByName(dark)
    return both.withColumn("rank", F.row_number().over(W.orderBy("group", "rank")))


def bright_dark_full(obs: DataFrame, n: int = 5) -> DataFrame:
    rows = typed(obs).select("uuid", "category", number(obs, "spectral_centroid_hz").alias("centroid_hz")).where("centroid_hz is not null")
    g = _by_category(obs, "spectral_centroid_hz").groupBy("category").agg(np_round(F.avg("x"), 2).alias("centroid_hz"), F.count("uuid").alias("recording_count"))
    out = None
    for level, df, key in (("recording", rows, "uuid"), ("category", g, "category")):
        for name, order in (("brightest", F.desc("centroid_hz")), ("darkest", F.asc("centroid_hz"))):
            part = ranked(df, n, order, key).withColumns({"aggregation_level": F.lit(level), "rank_group": F.lit(name)})
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
