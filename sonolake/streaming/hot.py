"""The hot path as Structured Streaming: read what is there, de-duplicate within a watermark, count by window."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolake.operators import zones
from sonolake.sources import objects, versions
from sonolake.sources.observations import HOT_EVENT
from sonolake.sources.tables import read_parquet


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def replay(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is available and returns what it emitted: all rows that it appended, or its last complete result.

    What it emits goes to Parquet folders in the shared one, none of it to the driver.
    """
    spark, name = stream.sparkSession, f"replay_{uuid.uuid4().hex}"
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="stream-")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/{name}").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{base}/{name}-rows").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/{name}-rows")
    done: list[int] = []

    def keep(result: DataFrame, number: int) -> None:
        result.write.mode("overwrite").parquet(f"{base}/{name}-{number}")
        done.append(number)

    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/{name}-{done[-1]}") if done else spark.createDataFrame([], stream.schema)


def tumbling(stream: DataFrame, width: str = "1 day") -> DataFrame:
    return stream.groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"))


def sliding(stream: DataFrame, width: str = "1 day", step: str = "12 hours") -> DataFrame:
    return stream.groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n"))


def unique_events(stream: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def ingest(stream: DataFrame, path: str, rejected: str, checkpoint: str, key: str = "event_id", time: str | None = None, reach_days: int = 1) -> None:
    """Appends what is available to a table, at least once and without repeats of a key.

    Each micro-batch is appended after an anti-join with the keys that are there, so a batch that runs again after a
    failure adds nothing twice. Rows without a key go to a table of their own with the reason, by their content alike.
    Of several rows with one key the smallest is taken.

    With a time column the table is partitioned by its date (UTC session), as `day`, and a row repeats one of the table if
    their dates are at most `reach_days` apart or both missing; a batch then reads only the partitions from its first date to
    its last, that much wider. Within a batch a key is one row whatever its dates. Without a time column every key of the
    table is read for each batch.
    """

    def add(batch: DataFrame, number: int) -> None:
        bad = batch.where(F.col(key).isNull()).withColumns({"reason": F.lit(f"no {key}"), "row_hash": F.sha2(F.to_json(F.struct(*batch.columns)), 256)})
        if (dead := read_parquet(batch.sparkSession, rejected)) is not None:
            bad = bad.join(dead.select("row_hash"), "row_hash", "left_anti")
        bad.write.mode("append").parquet(rejected)
        fresh = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*(c for c in batch.columns if c != key), key)).alias("_r")).select(*(F.col("_r")[c].alias(c) for c in batch.columns))
        if time is not None:
            fresh = fresh.withColumn("day", F.to_date(time))
        if (old := read_parquet(batch.sparkSession, path)) is not None:
            fresh = fresh.join(old.select(key), key, "left_anti") if time is None else _unseen(fresh, old, key, reach_days)
        writer = fresh.write.mode("append")
        (writer if time is None else writer.partitionBy("day")).parquet(path)

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _unseen(fresh: DataFrame, old: DataFrame, key: str, days: int) -> DataFrame:
    """New rows without a repeat in reach; the bounds of the batch are literals, so that partitions outside are pruned."""
    low, high = fresh.agg(F.min("day"), F.max("day")).first()
    near = F.lit(False) if low is None else F.col("day").between(F.date_sub(F.lit(low), days), F.date_add(F.lit(high), days))
    seen = old.where(near | F.col("day").isNull()).select(F.col(key).alias("_key"), F.col("day").alias("_day"))
    apart = F.abs(F.date_diff("day", "_day"))
    return fresh.join(seen, (F.col(key) == F.col("_key")) & (F.col("day").eqNullSafe(F.col("_day")) | (apart <= days)), "left_anti")


def json_events(spark: SparkSession, path: str) -> DataFrame:
    """Archived hot events as a stream, one JSON object a file or a line; what doesn't parse has nulls."""
    return spark.readStream.schema(HOT_EVENT).option("mode", "PERMISSIVE").json(path)


def _named(events: DataFrame) -> DataFrame:
    """With `object` (bucket and path) of messages that name both, and a key: the object's, or a hash of the message."""
    both = (F.length("audio_path") > 0) & (F.length("bucket") > 0)
    named = events.withColumn("object", F.when(both, F.concat_ws("/", "bucket", "audio_path")))
    return named.withColumn("event_key", F.coalesce("object", F.sha2(F.to_json(F.struct(*events.columns)), 256)))


def judged(events: DataFrame, root: str) -> DataFrame:
    """One row for each key (that of the smallest timestamp, then of the smallest row) with the reason why it is no good, or null.

    Messages are reduced to one row a key before tasks ask for the objects (bucket and path below the root) of theirs.
    """
    named = _named(events)
    first = named.groupBy("event_key").agg(F.min(F.struct("timestamp", *(c for c in named.columns if c not in ("timestamp", "event_key")))).alias("e"))
    rows = first.select("event_key", *(F.col("e")[c].alias(c) for c in events.columns), F.col("e.object").alias("object"))
    asked = objects.spread(rows, "event_key").withColumn("there", objects.length_of(F.col("object"), root))
    reason = F.when(F.col("object").isNull(), "no audio_path or bucket").when(F.col("there").isNull(), "no object")
    return asked.withColumn("reason", reason).drop("object", "there")


def merge_latest(events: DataFrame, path: str, checkpoint: str) -> None:
    """Works off a stream of (uuid, device, event_time) into the table of each uuid's latest event, one row a uuid.

    A micro-batch is reduced to its latest events and merged into the buckets that it touches, in one commit by its number. The
    table is to zones.merge_events() what the archive of all events is.
    """

    def latest(rows: DataFrame) -> DataFrame:
        return zones.latest(rows, ["uuid"], "event_time", "device")

    def add(batch: DataFrame, number: int) -> None:
        new = latest(batch.where(F.length("uuid") > 0).select("uuid", "device", "event_time"))
        versions.upsert(new, path, "uuid", lambda old, rows: rows if old is None else latest(old.unionByName(rows)), token=f"{checkpoint}:{number}")

    events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def with_retries(run: Callable[[], None], attempts: int = 5, seconds: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Runs a stream to its end, again after a failure to connect or in the run (it goes on from its checkpoint); the attempts it took."""
    for attempt in range(1, attempts + 1):
        try:
            run()
            return attempt
        except (StreamingQueryException, ConnectionError):
            if attempt == attempts:
                raise
            sleep(seconds)
    raise ValueError("at least one attempt")


def consume(events: DataFrame, root: str, path: str, checkpoint: str) -> None:
    """Works off an event stream into one versioned table, good messages and dead letters (those with a reason) alike.

    Each micro-batch is one commit, so both appear at once or not at all, and a batch that runs again is found in the log by its
    number. Messages whose key the table has, good or dead, are not taken again, so a run from the start adds nothing. Whether an
    object is there is asked at the time of the batch, for the objects of its messages alone.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = judged(batch, root)
        if (old := versions.read(spark, path)) is not None:
            rows = rows.join(old.select("event_key"), "event_key", "left_anti")
        versions.append(rows, path, token=f"{checkpoint}:{number}")

    events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
