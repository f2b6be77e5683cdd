"""Ranks and quantiles of whole columns: values sorted into ranges over all tasks, and prefix sums of what the ranges hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonolake.sources import versions


def _ranged(rows: DataFrame, folder: str, *keys: str) -> DataFrame:
    """Rows in ranges of the keys, p being the range's place, as a written table (the ranges are drawn once)."""
    version = versions.replace(rows.repartitionByRange(*keys).withColumn("p", F.spark_partition_id()), folder)
    return versions.read(rows.sparkSession, folder, version)


def _before(sizes: DataFrame, *group: str) -> DataFrame:
    """What the ranges before each one hold (a window over one row for each range)."""
    over = W.partitionBy(*group).orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(*group, "p", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))


def dense_rank(rows: DataFrame, column: str, folder: str, into: str = "rank") -> DataFrame:
    """Rows with the dense rank of a column, the largest value first; null has none.

    Each distinct value is ranked once and joined back, so a value that many rows share is one row in its range.
    """
    values = _ranged(rows.where(F.col(column).isNotNull()).select((-F.col(column)).alias("_low")).distinct(), folder, "_low")
    own = values.withColumn("k", F.row_number().over(W.partitionBy("p").orderBy("_low")))
    ranks = own.join(_before(values.groupBy("p").agg(F.count(F.lit(1)).alias("n"))), "p")
    return rows.withColumn("_low", -F.col(column)).join(ranks.select("_low", (F.col("before") + F.col("k")).alias(into)), "_low", "left").drop("_low")


def quantiles(rows: DataFrame, columns: list[str], at: list[float], folder: str) -> DataFrame:
    """column_name, q, value: exact quantiles of numeric columns, between two values in proportion; nulls do not count."""
    long = rows.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns)))).where("x is not null")
    values = _ranged(long.groupBy("column_name", "x").agg(F.count(F.lit(1)).alias("n")), folder, "column_name", "x")
    before = _before(values.groupBy("column_name", "p").agg(F.sum("n").alias("n")), "column_name")
    own = values.join(before, ["column_name", "p"])
    upto = F.col("before") + F.sum("n").over(W.partitionBy("column_name", "p").orderBy("x"))
    spans = own.select("column_name", "x", (upto - F.col("n")).alias("low"), upto.alias("high"))
    q = F.explode(F.array(*(F.lit(float(a)) for a in at))).alias("q")
    place = values.groupBy("column_name").agg(F.sum("n").alias("total")).select("column_name", q, "total").withColumn("place", F.col("q") * (F.col("total") - 1))
    near = (F.col("low") <= F.ceil("place")) & (F.col("high") > F.floor("place"))
    found = spans.join(F.broadcast(place), "column_name").where(near)  # a row for each column and quantile asked for
    held = lambda k: (F.col("low") <= k) & (F.col("high") > k)
    ends = found.groupBy("column_name", "q", "place").agg(F.max(F.when(held(F.floor("place")), F.col("x"))).alias("a"), F.max(F.when(held(F.ceil("place")), F.col("x"))).alias("b"))
    return ends.select("column_name", "q", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))).alias("value"))


def description(rows: DataFrame, columns: list[str], folder: str) -> DataFrame:
    """column_name, count, mean, std (null for one value), min, p25, p50, p75, max of numeric columns."""
    long = rows.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns))))
    plain = long.groupBy("column_name").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    of = quantiles(rows, columns, [0.25, 0.5, 0.75], folder).groupBy("column_name").agg(*(F.max(F.when(F.col("q") == q, F.col("value"))).alias(f"p{round(100 * q)}") for q in (0.25, 0.5, 0.75)))
    return plain.join(of, "column_name", "left").select("column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")
