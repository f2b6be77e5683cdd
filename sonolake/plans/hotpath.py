"""Queries over events as objects and streams: archive, consumer with dead letters, object copies, enrichment; with DuckDB SQL."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from sonolake.functions.clean import np_round
from sonolake.operators import enrich, zones
from sonolake.plans.roundtrips import folder
from sonolake.sources import archive, objects, tables, versions
from sonolake.sources.event_archive import EventArchive, archived, archived_stream
from sonolake.sources.observations import read
from sonolake.streaming import capture, hot

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@F.pandas_udf(BinaryType())
def wav_bytes(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """Samples as a 16-bit waveform."""
    return pd.Series([tables.encode_wav(np.asarray(x, float), int(r)) for x, r in zip(samples, rate, strict=True)])


@_query("""select 'u-' || cast(user_id as varchar) as uuid, n, device from (select user_id, count(*) over (partition by user_id) as n, event_type as device, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn = 1""")
def event_archive(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user and the number of them, archived as an object each by a stream that runs twice from the start."""
    base, events = folder(spark), read(spark, d, "events")
    last = events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("device"), F.count(F.lit(1)).alias("n"))
    last.select(F.concat(F.lit("u-"), "user_id").alias("uuid"), F.concat(F.lit("raw/u-"), "user_id", F.lit(".wav")).alias("audio_path"), F.col("n").cast("int").alias("duration"), "device").write.parquet(f"{base}/events")
    spark.dataSource.register(EventArchive)
    for k in range(2):
        stream = spark.readStream.schema("uuid string, audio_path string, duration int, device string").parquet(f"{base}/events")
        stream.writeStream.format("event_archive").option("path", f"{base}/archive").option("key", "uuid").option("checkpointLocation", f"{base}/mark-{k}").trigger(availableNow=True).start().awaitTermination()
    found = archived(spark, f"{base}/archive")
    name = F.regexp_extract("file", r"([^/]+)\.json$", 1)
    return found.where(name == zones.uuid_of_path(F.col("audio_path"))).select(name.alias("uuid"), F.col("duration").cast("long").alias("n"), "device")


@_query("""with e as (select event_id, lpad(cast(event_id as varchar), 12, '0') as timestamp, event_type as device, case when event_id % 11 = 0 then null else 'landing/raw/' || cast(user_id as varchar) || '.wav' end as object, user_id from events),
 f as (select *, row_number() over (partition by coalesce(object, timestamp) order by timestamp) as rn from e)
 select timestamp, device, case when object is null then 'no audio_path or bucket' when user_id % 4 = 0 then 'no object' end as reason from f where rn = 1""")
def event_stream_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """JSON events in two drops and a run from the start: each object once, with the reason where there is no object or no name of one."""
    base, events = folder(spark), read(spark, d, "events")
    users = events.select("user_id").distinct().where("user_id % 4 <> 0")
    objects.write_objects(users.select(F.concat(F.lit("landing/raw/"), "user_id", F.lit(".wav")).alias("name"), F.col("user_id").cast("string").cast("binary").alias("content")), f"{base}/objects")
    message = events.select("event_id", F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("raw/"), "user_id", F.lit(".wav"))).alias("audio_path"), F.lit("landing").alias("bucket"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("timestamp"), F.col("event_type").alias("device"))
    half = events.agg(F.percentile_approx("event_id", 0.5)).first()[0] or 0
    for k, part in enumerate((F.col("event_id") <= half, F.col("event_id") > half)):
        message.where(part).drop("event_id").write.json(f"{base}/events/drop-{k}")
        hot.consume(hot.json_events(spark, f"{base}/events/*"), f"{base}/objects", f"{base}/t", f"{base}/mark")
    hot.consume(hot.json_events(spark, f"{base}/events/*"), f"{base}/objects", f"{base}/t", f"{base}/again")
    return versions.read(spark, f"{base}/t").select("timestamp", "device", "reason")


@_query("select 'm/' || cast(c_custkey as varchar) as target, length(c_name) as size, sha256(c_name) as sha256, case when c_custkey % 5 = 0 then 'missing' else 'copied' end as status, false as source_left from customer where c_custkey % 5 <> 0 union all select 'm/' || cast(c_custkey as varchar), null, null, 'missing', false from customer where c_custkey % 5 = 0")
def object_moves(spark: SparkSession, d: str) -> DataFrame:
    """Objects moved between folders, some of which are not there; the move runs twice, and the manifest says what came of it."""
    base, customers = folder(spark), read(spark, d, "customer")
    name = F.col("c_custkey").cast("string")
    objects.write_objects(customers.where("c_custkey % 5 <> 0").select(name.alias("name"), "c_name"), f"{base}/a", lambda row: None if row["c_name"] is None else row["c_name"].encode())
    plan = customers.select(F.concat(F.lit(f"{base}/a/"), name).alias("source"), F.concat(F.lit(f"{base}/b/m/"), name).alias("target"))
    for _ in range(2):
        moved = objects.copy_objects(plan, f"{base}/manifest", move=True)
    out = moved.withColumns({"left": objects.length_of(F.col("source")), "length": objects.length_of(F.col("target"))}).where(F.col("length").eqNullSafe(F.col("size")))
    return out.select(F.substring_index("target", "/b/", -1).alias("target"), "size", "sha256", "status", F.col("left").isNotNull().alias("source_left"))


def sound(row: dict) -> bytes:
    """The WAV file of a vector: a tone and its third harmonic at 8 kHz; by the id's last digit half a second (3), silence (5) or no sound (9)."""
    v = row["vec_id"] % 10
    if v == 9:
        return b"no sound"
    wave = 2 * np.pi * (200 + 4 * (row["vec_id"] % 250)) * np.arange(4000 if v == 3 else 8000) / 8000
    return tables.encode_wav(np.zeros(len(wave)) if v == 5 else (np.sin(wave) + np.sin(3 * wave) / 3) / 1.4, 8000)


_HEARD = """q as (select vec_id, k, trunc((sin(2 * pi() * (200 + 4 * (vec_id % 250)) * k / 8000) + sin(3 * (2 * pi() * (200 + 4 * (vec_id % 250)) * k / 8000)) / 3) / 1.4 * 32767) / 32768.0 as x from embeddings, (select unnest(range(0, 8000)) as k) where vec_id % 10 not in (3, 5, 7, 9)),
 top as (select vec_id, max(abs(x)) as m, sqrt(avg(x * x) filter (where k < 2000)) as r, max(abs(x)) filter (where k < 2000) as a from q group by vec_id)"""


@_query(f"""with {_HEARD}, e as (select *, 200 + 4 * (vec_id % 250) as hz, 'vec-' || cast(vec_id as varchar) as uuid from embeddings)
 select uuid, case when e.vec_id % 10 = 3 then 'too short' when e.vec_id % 10 = 5 then 'no frequency' when e.vec_id % 10 = 7 then 'no object' when e.vec_id % 10 = 9 then 'does not decode' end as reason,
 case when m is not null then cast(1.0 as double) end as duration, case when m is not null then cast(hz as double) end as peak_frequency_hz, case when m is not null then round_even(r / m * 1000.0, 0) / 1000.0 end as peak_rms, case when m is not null then round_even(a / m * 1000.0, 0) / 1000.0 end as peak_amplitude,
 case when m is not null then cast(hz as varchar) || '|' || cast(3 * hz as varchar) end as peaks, case when m is not null then 'audio/' || cast(hz as varchar) || '/' || uuid || '-' || cast(hz as varchar) || '.wav' end as audio_path, case when m is not null then cast(16044 as bigint) end as audio_size
 from e left join top on e.vec_id = top.vec_id""")
def trusted_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Landing rows with their objects to the trusted zone: what is heard, where the copy lies, and why others are rejected."""
    base, v = folder(spark), F.col("vec_id") % 10
    names = read(spark, d, "embeddings").where(v != 7).select(F.concat(F.lit("raw/"), "vec_id", F.lit(".wav")).alias("name"), "vec_id")
    objects.write_objects(names, f"{base}/landing", sound)
    rows = read(spark, d, "embeddings").select(F.concat(F.lit("vec-"), "vec_id").alias("uuid"), F.concat(F.lit(" raw/"), "vec_id", F.lit(".wav ")).alias("audio_path"))
    good, bad = enrich.to_trusted(rows, f"{base}/landing", f"{base}/trusted", f"{base}/manifest")
    good = good.where(objects.length_of(F.col("audio_path"), f"{base}/trusted") == F.col("audio_size"))
    both = good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad.withColumn("audio_path", F.lit(None).cast("string")), allowMissingColumns=True)
    return both.select("uuid", "reason", "duration", "peak_frequency_hz", np_round(F.col("peak_rms"), 3).alias("peak_rms"), np_round(F.col("peak_amplitude"), 3).alias("peak_amplitude"), F.col("all_peak_frequencies_hz").alias("peaks"), "audio_path", "audio_size")


@_query("""with x as (select vec_id, cast(unnest(embedding) as double) as v from embeddings), q as (select vec_id, trunc(v * 32767) / 32768.0 as v from x)
 select 'vec-' || cast(vec_id as varchar) as uuid, 64 as sample_rate, count(*) as n, round_even(sum(v * v) * 1000000.0, 0) / 1000000.0 as energy from q group by vec_id""")
def wave_codec(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as WAV files and read back."""
    base = folder(spark)
    waves = read(spark, d, "embeddings").select(F.concat(F.lit("vec-"), "vec_id", F.lit(".wav")).alias("name"), wav_bytes("embedding", F.lit(64)).alias("content"))
    objects.write_objects(waves, f"{base}/waves")
    back = tables.read_waves(spark, f"{base}/waves")
    energy = np_round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x), 6).alias("energy")
    return back.select(zones.uuid_of_path(F.col("path")).alias("uuid"), "sample_rate", F.size("samples").cast("long").alias("n"), energy)


@_query("""select uuid, source, device, time_recorded from (select 'ev-' || cast(event_id as varchar) as uuid, 'Freesound' as source, case when event_id % 3 = 0 then 'mic' else '-' end as device,
 case when event_id % 3 = 0 then '2030' when event_id % 7 = 0 then '' else strftime(ts, '%Y-%m-%d') end as time_recorded from events)""")
def boundary_names(spark: SparkSession, d: str) -> DataFrame:
    """A CSV table under the names of the zone's boundary, through the trusted batch."""
    from sonolake.plans import batches
    from sonolake.sources.observations import with_boundary_names

    path, e = folder(spark), F.col("event_id")
    uuid = F.concat(F.lit("ev-"), "event_id")
    rows = read(spark, d, "events").select(uuid.alias("uuid"), F.concat(F.lit("a/"), uuid).alias("audio_path"), F.lit("Freesound").alias("source"), F.when(e % 7 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("time_recorded"))
    tables.export_csv(with_boundary_names(rows), path)
    events = read(spark, d, "events").where(e % 3 == 0).select(uuid.alias("uuid"), F.lit("mic").alias("device"), F.lit("2030").alias("event_time"))
    return batches.trusted_batch(tables.read_exports(spark, path), events, None).select("uuid", "source", "device", "time_recorded")


@_query("""with x as (select vec_id, label, cast(unnest(embedding) as double) as v from embeddings where label % 3 <> 0), q as (select vec_id, label, trunc(v * 32767) / 32768.0 as v from x)
 select vec_id, cast(vec_id % 5 + 1 as int) as fold, cast(label as int) as target, 'label, ' || cast(label as varchar) as category, count(*) as n, round_even(sum(v * v) * 1000000.0, 0) / 1000000.0 as energy from q group by vec_id, label""")
def archive_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as waveforms in ZIP archives of 100 with an index each, read back by the categories that are wanted."""
    base, v = folder(spark), F.col("vec_id")
    waves = read(spark, d, "embeddings").select("vec_id", "label", F.floor(v / 100).alias("part"), wav_bytes("embedding", F.lit(64)).alias("content"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out, lines = io.BytesIO(), ["filename,fold,target,category"]
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in rows.itertuples():
                z.writestr(f"set/audio/{r.vec_id}.wav", r.content)
                lines.append(f'{r.vec_id}.wav,{r.vec_id % 5 + 1},{r.label},"label, {r.label}"')
            z.writestr("set/meta/index.csv", "\r\n".join(lines))
        return pd.DataFrame({"name": [f"{rows['part'].iloc[0]}.zip"], "content": [out.getvalue()]})

    objects.write_objects(waves.groupBy("part").applyInPandas(pack, "name string, content binary"), f"{base}/zips")
    zips = [r.uri for r in objects.listing(spark, f"{base}/zips").collect()]
    wanted = [f"label, {k}" for k in range(1000) if k % 3]
    found = archive.dataset(spark, zips, categories=wanted) if zips else spark.createDataFrame([], "filename string, fold int, target int, category string, content binary")
    back = found.select(F.substring_index("filename", ".", 1).cast("long").alias("vec_id"), "fold", "target", "category", tables.decoded("content").alias("w"))
    energy = np_round(F.aggregate("w.samples", F.lit(0.0), lambda a, x: a + x * x), 6)
    return back.select("vec_id", "fold", "target", "category", F.size("w.samples").cast("long").alias("n"), energy.alias("energy"))


@_query("""with last as (select * from (select user_id, event_type, event_id, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn = 1)
 select cast(c_custkey as varchar) as uuid, coalesce(event_type, '-') as device, coalesce(lpad(cast(event_id as varchar), 10, '0'), '') as time_recorded from customer left join last on user_id = c_custkey""")
def latest_event_stream(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their latest event, from a table that a stream of events keeps over three drops and a run from the start."""
    base, events = folder(spark), read(spark, d, "events")
    e = F.col("event_id")
    rows = events.select(F.col("user_id").cast("string").alias("uuid"), F.col("event_type").alias("device"), F.lpad(e.cast("string"), 10, "0").alias("event_time"), (e % 3).alias("drop"))
    for k in range(3):
        rows.where(F.col("drop") == k).drop("drop").write.mode("append").parquet(f"{base}/events")
        hot.merge_latest(spark.readStream.schema("uuid string, device string, event_time string").parquet(f"{base}/events"), f"{base}/latest", f"{base}/mark")
    hot.merge_latest(spark.readStream.schema("uuid string, device string, event_time string").parquet(f"{base}/events"), f"{base}/latest", f"{base}/again")
    customers = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("uuid"))
    return zones.merge_events(customers, versions.read(spark, f"{base}/latest")).select("uuid", "device", "time_recorded")


@_query("""with b as (select vec_id, k, substring(sha256('mic-' || cast(vec_id as varchar) || chr(1) || cast(k as varchar)), 1, 32) as uuid, 16 + 4 * (vec_id % 20) as hz from embeddings, (select unnest([0, 1]) as k))
 select uuid, cast(case when vec_id % 9 > 0 then 1.0 end as double) as duration, case when vec_id % 9 > 0 then cast(hz as double) end as peak_frequency_hz, case when vec_id % 9 > 0 then cast(556 as bigint) end as audio_size,
  case when vec_id % 9 > 0 then 'audio/hot-path/' || cast(hz as varchar) || '/' || uuid || '-' || cast(hz as varchar) || '.wav' end as audio_path, case when vec_id % 9 > 0 then lpad(cast(256 * k as varchar), 12, '0') end as time_recorded, case when vec_id % 9 = 0 then 'no frequency' end as reason from b""")
def hot_path(spark: SparkSession, d: str) -> DataFrame:
    """From samples to landing rows: two seconds at 256 Hz for each vector, a tone or silence, as batches, objects, archived events, messages, moved objects."""
    base, rate = folder(spark), 256
    f = F.when(F.col("vec_id") % 9 > 0, 16 + 4 * (F.col("vec_id") % 20)).otherwise(0)
    place = F.explode(F.sequence(F.lit(0), F.lit(2 * rate - 1))).alias("place")
    samples = read(spark, d, "embeddings").select(F.concat(F.lit("mic-"), "vec_id").alias("device"), f.alias("f"), place)
    samples.select("device", F.floor(F.col("place") / 64).alias("tick"), F.col("place").cast("long").alias("place"), F.sin(2 * np.pi * F.col("f") * F.col("place") / rate).alias("sample")).write.parquet(f"{base}/samples")
    stream = spark.readStream.schema("device string, tick long, place long, sample double").parquet(f"{base}/samples")
    capture.run_captured(capture.capture_batches(stream, rate, 2 * rate), f"{base}/batches", f"{base}/captured")
    events = capture.produce(spark.read.schema(capture.BATCHES).parquet(f"{base}/batches"), f"{base}/zones", rate)
    spark.dataSource.register(EventArchive)
    events.write.format("event_archive").option("key", "uuid").mode("append").save(f"{base}/zones/landing/events/hot")
    hot.consume(archived_stream(spark, f"{base}/zones/landing/events/hot").drop("file"), f"{base}/zones", f"{base}/messages", f"{base}/consumed")
    good, bad = enrich.to_landing(versions.read(spark, f"{base}/messages").where("reason is null"), f"{base}/zones", f"{base}/moved")
    columns = ("uuid", "duration", "peak_frequency_hz", "audio_size", "audio_path", "time_recorded")
    return good.select(*columns).withColumn("reason", F.lit(None).cast("string")).unionByName(bad.select("uuid", "reason"), allowMissingColumns=True)
