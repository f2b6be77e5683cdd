"""Zone batches: quality checks, de-duplication, event merge and incremental work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonolake.functions.clean import blank_to_null


def trim_all(df: DataFrame) -> DataFrame:
    return df.select([F.trim(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])


def required_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are not null or empty; none if a key column is missing."""
    if not set(keys) <= set(df.columns):
        return df.limit(0)
    for k in keys:
        df = df.where(F.length(k) > 0)
    return df


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key: the largest of `order`, nulls last."""
    there = [F.col(c).desc_nulls_last() for c in order if c in df.columns] or [F.monotonically_increasing_id()]
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*there))).where("_rn = 1").drop("_rn")


def pending(df: DataFrame, done: DataFrame, key: str = "uuid") -> DataFrame:
    """Rows that the next zone does not have yet."""
    keys = done.select(F.trim(F.col(key).cast("string")).alias(key)).where(F.length(key) > 0).distinct()
    return df.join(keys, key, "left_anti")


def merge_events(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Device and time of the latest event of each uuid win over the row's own; either column is added where it is missing."""
    for column in ("device", "time_recorded"):
        rows = rows if column in rows.columns else rows.withColumn(column, F.lit(None).cast("string"))
    last = latest(events, ["uuid"], "event_time").select("uuid", blank_to_null(F.col("device")).alias("_device"), blank_to_null(F.col("event_time")).alias("_time"))
    merged = rows.join(last, "uuid", "left")
    return merged.withColumn("device", F.coalesce("_device", blank_to_null(F.col("device")), F.lit("-"))).withColumn("time_recorded", F.coalesce("_time", blank_to_null(F.col("time_recorded")), F.lit(""))).drop("_device", "_time")


def uuid_of_path(path):
    """What stands behind the last slash of a path, without the ending .wav; other endings stay, and nothing is null."""
    return F.nullif(F.regexp_replace(F.substring_index(path, "/", -1), r"\.wav$", ""), F.lit(""))


def append_evolving(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both under the union of their columns; what a side lacks is the empty text."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in both.columns])


def zone_overlap(zones: dict[str, DataFrame]) -> DataFrame:
    """Distinct keys shared by each pair of zones, and of each zone."""
    flags = None
    for name, df in zones.items():
        part = df.select("uuid", F.lit(name).alias("zone"))
        flags = part if flags is None else flags.union(part)
    sets = flags.groupBy("uuid").agg(F.sort_array(F.collect_set("zone")).alias("zones"))  # at most one entry for each zone
    pairs = sets.select(F.explode("zones").alias("zone_a"), "zones").select("zone_a", F.explode("zones").alias("zone_b")).where("zone_a <= zone_b")
    return pairs.groupBy("zone_a", "zone_b").agg(F.count(F.lit(1)).alias("n_shared"))


def column_profile(df: DataFrame) -> DataFrame:
    """Name, type and non-null count of every column, in one pass."""
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("dtype"), F.col(f"`{c}`").alias("non_null")) for c, t in df.dtypes))
    return counts.select(F.inline(rows))


def diverse_batch(df: DataFrame, category: str, key: str, n: int) -> DataFrame:
    """n rows taken round-robin over the categories."""
    ranked = df.withColumn("rn", F.row_number().over(W.partitionBy(category).orderBy(key)))
    return ranked.where(F.col("rn") <= n).orderBy("rn", category).limit(n)  # no category gives more than n


def text_profile(df: DataFrame, *columns: str) -> DataFrame:
    """For each text column: non-null count, distinct values, most frequent value (ties: the smallest) and its count."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))).alias("p")).select("p.*").where("value is not null")
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("v")))
    return counts.groupBy("column_name").agg(F.sum("n").alias("non_null"), F.count(F.lit(1)).alias("n_unique"), best.alias("b")).select("column_name", "non_null", "n_unique", F.col("b.v").alias("top"), (-F.col("b.neg")).alias("freq"))


def matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose column holds a match of the pattern in any case; null matches nothing."""
    return df.where(F.col(column).rlike(f"(?i){pattern}"))


def only(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose column is in an allow-list."""
    return df.where(F.col(column).isin(allowed))


def valid_events(events: DataFrame) -> DataFrame:
    """Messages that name both an audio path and a bucket."""
    return events.where((F.length("audio_path") > 0) & (F.length("bucket") > 0))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def since(df: DataFrame, column: str, start: str | None) -> DataFrame:
    """Rows whose ISO time, compared as text, is not before `start`; all rows without one."""
    return df if start is None else df.where(F.col(column) >= start)


def merge_metrics(rows: DataFrame, events: DataFrame) -> DataFrame:
    """One row: n_events (distinct uuids), n_matched, n_hot_unmatched and n_dropped (without a uuid), in one aggregation.

    Rows and events are counted for each uuid before they meet, so a uuid with many rows is a few partial sums.
    """
    hot = F.coalesce(F.lower(F.trim("source")) == "hot-path", F.lit(False)).cast("long")
    both = rows.select("uuid", F.lit(1).alias("n"), hot.alias("hot"), F.lit(0).alias("event")).union(events.select("uuid", F.lit(0), F.lit(0).cast("long"), F.lit(1)))
    each = both.groupBy(blank_to_null(F.col("uuid")).alias("uuid")).agg(F.sum("n").alias("n"), F.sum("hot").alias("hot"), F.max("event").alias("event"))
    some = F.col("uuid").isNotNull()
    total = lambda test, value: F.coalesce(F.sum(F.when(test, value)), F.lit(0)).cast("long")
    return each.agg(
        total(some, F.col("event")).alias("n_events"), total(some & (F.col("event") == 1), F.col("n")).alias("n_matched"),
        total(some & (F.col("event") == 0), F.col("hot")).alias("n_hot_unmatched"), total(~some, F.col("n")).alias("n_dropped"),
    )
