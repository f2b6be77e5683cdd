"""Queries that write with the library's writers, read back and go through whole batches, with DuckDB SQL for what must come out."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolake.functions import images
from sonolake.functions.clean import np_round
from sonolake.operators import features, zones
from sonolake.plans import batches
from sonolake.sources import tables, versions
from sonolake.sources.observations import observations, read, with_boundary_names, with_internal_names
from sonolake.streaming import capture, hot

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_EV = "'ev-' || lpad(cast(event_id as varchar), 8, '0')"


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def folder(spark: SparkSession) -> str:
    """A fresh folder in the shared one (of its own only where none is named, as in tests)."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='tables-')}/{uuid.uuid4().hex}"


@_query("select event_id, cast(user_id as varchar) as user_id, 'a \"' || event_type || '\", b' as text, case when event_id % 2 = 0 then cast(value as varchar) end as value from events where event_type is not null")
def csv_export_of_two_layouts(spark: SparkSession, d: str) -> DataFrame:
    base = read(spark, d, "events").where("event_type is not null").select("event_id", "user_id", F.concat(F.lit('a "'), "event_type", F.lit('", b')).alias("text"), F.col("value").cast("string").alias("value"))
    path = folder(spark)
    tables.export_csv(base.where("event_id % 2 = 0"), path, ("text",))
    tables.export_csv(base.where("event_id % 2 = 1").drop("value"), path)
    return tables.read_exports(spark, path).withColumn("event_id", F.col("event_id").cast("long"))


@_query("select cast(event_id as varchar) as uuid, 44100 as sample_rate, event_type as device, strftime(ts, '%Y-%m-%d') as day from events")
def json_event_archive(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events").select(F.concat(F.lit("audio/raw/"), "event_id", F.lit(".wav")).alias("audio_path"), F.lit("landing").alias("bucket"), F.date_format("ts", "yyyy-MM-dd").alias("timestamp"), F.lit(44100).alias("sample_rate"), F.col("event_type").alias("device"))
    path = folder(spark)
    events.write.json(path)
    return tables.read_events(spark, path).select(zones.uuid_of_path(F.col("audio_path")).alias("uuid"), "sample_rate", "device", F.col("timestamp").alias("day"))


@_query("select event_id, user_id, case when event_id % 2 = 1 then event_type end as event_type from events")
def parquet_appends(spark: SparkSession, d: str) -> DataFrame:
    events, path = read(spark, d, "events").select("event_id", "user_id", "event_type"), folder(spark)
    tables.append(events.where("event_id % 2 = 0").drop("event_type"), path)
    tables.append(events.where("event_id % 2 = 1"), path)
    return tables.read_parquet(spark, path)


@_query("select cast(event_id as varchar) as event_id, case when event_id % 2 = 1 then event_type else '' end as event_type from events")
def text_appends(spark: SparkSession, d: str) -> DataFrame:
    events, path = read(spark, d, "events").select("event_id", "event_type"), folder(spark)
    tables.append(events.where("event_id % 2 = 0").select("event_id"), path)
    return tables.append_text(events.where("event_id % 2 = 1"), spark, path)


@_query("select 'trusted' as zone, 'ok' as status, cast(1 as bigint) as version, count(*) as n, cast(2 as bigint) as n_columns from customer union all select 'landing', 'ok', 0, count(*), 2 from nation union all select 'exploitation', 'no_table', null, null, null")
def zone_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Tables of three zones (the last one without rows) synchronised twice where there is more, and what an inspection says."""
    base = folder(spark)
    small = {"trusted": read(spark, d, "customer").select("c_custkey", "c_name"), "landing": read(spark, d, "nation").select("n_nationkey", "n_name"), "exploitation": read(spark, d, "nation").select("n_name").limit(0)}
    for name, df in small.items():
        tables.append(df, f"{base}/{name}/table")
    of = {name: (f"{base}/{name}/table", f"{base}/{name}/snapshots") for name in small}
    batches.sync_all(spark, of)
    batches.sync_all(spark, {"trusted": of["trusted"]})
    found = {name: tables.inspect(spark, f"{base}/{name}") for name in small}
    return spark.createDataFrame([(n, x["status"], x["version"], x["rows"], x["cols"]) for n, x in found.items()], "zone string, status string, version long, n long, n_columns long")


@_query("""select v as version, event_type, count(*) as n from events, (select unnest([0, 1, 2, 3]) as v)
 where case v when 0 then event_id % 4 = 0 when 1 then event_id % 4 < 2 when 2 then event_id % 4 < 2 and event_type = 'click' else event_id % 4 < 2 and event_type = 'click' or event_id % 4 = 3 end group by 1, 2""")
def table_versions(spark: SparkSession, d: str) -> DataFrame:
    """Two appends, a replacement of what was read and an append that comes twice: the event types of every version."""
    events, path = read(spark, d, "events").select("event_id", "event_type"), folder(spark)
    part = lambda k: events.where(F.col("event_id") % 4 == k)
    versions.append(part(0), path)
    seen = versions.append(part(1), path)
    versions.replace(versions.read(spark, path).where("event_type = 'click'"), path, read=seen)
    for _ in range(2):
        versions.append(part(3), path, token="batch-3")
    found = [versions.read(spark, path, v).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).cast("long").alias("version"), "event_type", "n") for v in range(versions.latest(spark, path) + 1)]
    return reduce(DataFrame.unionByName, found)


@_query("select source_id, created, n from (select source_id, created, row_number() over (partition by source_id order by created) as n, created >= '2024-01-10' as late from (select cast(user_id as varchar) as source_id, min(strftime(ts, '%Y-%m-%d')) as created from events group by 1))")
def incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over sources with their first day: the second starts where the first one began and finds what is new."""
    rows = read(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("source_id")).agg(F.min(F.date_format("ts", "yyyy-MM-dd")).alias("created"))
    path = folder(spark)
    tables.ingest_since(rows.where("created < '2024-01-10'"), "created", "source_id", f"{path}/t", f"{path}/mark", "2024-01-01")
    tables.ingest_since(rows, "created", "source_id", f"{path}/t", f"{path}/mark", "2024-01-20")
    tables.ingest_since(rows, "created", "source_id", f"{path}/t", f"{path}/mark", "2024-01-21")
    return spark.read.parquet(f"{path}/t").groupBy("source_id", "created").agg(F.count(F.lit(1)).alias("n"))


@_query("select distinct event_id, false as rejected from events where event_id % 11 <> 0 union all select event_id, true from events where event_id % 11 = 0")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Events into a table once each, those without a key into the dead letters; a run from the start adds nothing."""
    path = folder(spark)
    for k in ("a", "b"):
        stream = hot.event_stream(spark, d).withColumn("key", F.when(F.col("event_id") % 11 != 0, F.col("event_id"))).select("key", "event_id")
        hot.ingest(stream, f"{path}/t", f"{path}/dead", f"{path}/mark-{k}", "key")
    good = spark.read.parquet(f"{path}/t").select("event_id", F.lit(False).alias("rejected"))
    return good.union(spark.read.parquet(f"{path}/dead").select("event_id", F.lit(True)))


_MIRROR = "x as (select vec_id, cast(unnest(embedding) as double) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings), m as (select a.vec_id, a.i, a.v, b.v as w, avg(a.v) over (partition by a.vec_id) as m from x a join x b on a.vec_id = b.vec_id and b.i = (a.i // 8) * 8 + 7 - a.i % 8)"
_ROUND = lambda e: f"round_even(({e}) * 1000000.0, 0) / 1000000.0"


@_query(
    f"with {_MIRROR} select 'vec-' || cast(vec_id as varchar) as uuid, {_ROUND('greatest(0, least(1, 0.5 * (sum((v - m) * (w - m)) / (sum((v - m) * (v - m)) + 1e-12) + 1)))')} as symmetry_score, "
    f"{_ROUND('sum(case when i < 16 then v * v2 end) / (sqrt(sum(case when i < 16 then v * v end) * sum(case when i < 16 then v2 * v2 end)) + 1e-12)')} as pattern_stability_score "
    "from (select m.*, x.v as v2 from m left join x on m.vec_id = x.vec_id and x.i = m.i + 48) group by vec_id"
)
def pattern_scores(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as pictures of 8 by 8 for the symmetry, as four frames of 4 by 4 for the stability."""

    @F.pandas_udf("symmetry_score double, pattern_stability_score double")
    def scores(x: pd.Series) -> pd.DataFrame:
        own = [np.asarray(v, float) for v in x]
        return pd.DataFrame({"symmetry_score": [images.symmetry_score(v.reshape(8, 8)) for v in own], "pattern_stability_score": [images.pattern_stability(list(v.reshape(4, 4, 4))) for v in own]})

    found = read(spark, d, "embeddings").select(F.concat(F.lit("vec-"), "vec_id").alias("uuid"), scores("embedding").alias("s")).select("uuid", "s.*")
    return found.select("uuid", *(np_round(F.col(c), 6).alias(c) for c in ("symmetry_score", "pattern_stability_score")))


def tone_keys(spark: SparkSession, d: str) -> DataFrame:
    """uuid, sample_rate and own_hz of a tone for each vector."""
    f = 200 + 4 * (F.col("vec_id") % 250)
    return read(spark, d, "embeddings").select(F.concat(F.lit("vec-"), "vec_id").alias("uuid"), F.lit(8000).alias("sample_rate"), f.cast("double").alias("own_hz"))


def tone_samples() -> Column:
    """A second at 8 kHz of own_hz, and a third of it at three times the frequency."""
    wave = lambda k: 2 * np.pi * F.col("own_hz") * k / 8000
    return F.transform(F.sequence(F.lit(0), F.lit(7999)), lambda k: F.sin(wave(k)) + F.sin(3 * wave(k)) / 3)


def tones(spark: SparkSession, d: str) -> DataFrame:
    """A second at 8 kHz for each vector: a tone that its id gives, and a third of it at three times the frequency."""
    return tone_keys(spark, d).select("uuid", tone_samples().alias("samples"), "sample_rate", "own_hz")


@_query("select 'vec-' || cast(vec_id as varchar) as uuid, cast(200 + 4 * (vec_id % 250) as double) as peak_frequency_hz, cast(200 + 4 * (vec_id % 250) as varchar) || '|' || cast(3 * (200 + 4 * (vec_id % 250)) as varchar) as peaks_hz, cast(1.0 as double) as harmonic_energy_ratio, 13 as n_mfccs, true as heard from embeddings")
def tone_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Peaks, voting, harmonics and cepstra of tones, whose answers are known."""
    found = features.with_features(features.long_enough(tones(spark, d)))
    return found.select("uuid", "peak_frequency_hz", "peaks_hz", np_round(F.col("harmonic_energy_ratio"), 4).alias("harmonic_energy_ratio"), F.size("mfccs").alias("n_mfccs"), F.exists("mfccs", lambda x: x != 0).alias("heard"))


_LANDING = """l as (select *, row_number() over (partition by uuid order by time_recorded desc nulls last, source_id desc nulls last) as rn from
 (select 'ev-' || cast(event_id % 500 as varchar) as uuid, 'u-' || cast(user_id as varchar) || '-' || lpad(cast(event_id as varchar), 8, '0') as source_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as time_recorded, event_id from events where event_id % 13 <> 0)),
 e as (select 'ev-' || cast(event_id % 500 as varchar) as uuid, max(event_id) as event_id from events where event_id % 3 = 0 group by 1)"""


def _landing(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = F.col("event_id")
    key = F.concat(F.lit("ev-"), (e % 500).cast("string"))
    base = read(spark, d, "events")
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    source = F.concat(F.lit("u-"), "user_id", F.lit("-"), F.lpad(e.cast("string"), 8, "0"))
    landing = base.select(F.concat(F.lit(" "), key).alias("uuid"), source.alias("source_id"), time.alias("time_recorded"), F.when(e % 13 != 0, F.concat(F.lit("a/"), key, F.lit(".wav"))).otherwise(F.lit(" ")).alias("audio_path"))
    events = base.where(e % 3 == 0).select(F.concat(F.lit("hot/raw/"), key, F.lit(".wav")).alias("audio_path"), F.concat(F.lit("mic-"), e.cast("string")).alias("device"), F.lpad(e.cast("string"), 12, "0").alias("timestamp"), F.lit("x.json").alias("file"))
    return landing, events


@_query(f"with {_LANDING} select l.uuid, l.source_id, case when e.event_id is null then l.time_recorded else lpad(cast(e.event_id as varchar), 12, '0') end as time_recorded, coalesce('mic-' || cast(e.event_id as varchar), '-') as device from l left join e on l.uuid = e.uuid where rn = 1 and cast(substring(l.uuid, 4) as bigint) % 7 <> 0")
def trusted_batch(spark: SparkSession, d: str) -> DataFrame:
    landing, archive = _landing(spark, d)
    done = spark.range(0, 500, 7).select(F.concat(F.lit("ev-"), "id").alias("uuid"))
    return batches.trusted_batch(landing, batches.archived_events(archive), done).select("uuid", "source_id", "time_recorded", "device")


@_query(f"with {_LANDING} select count(*) as first_run, cast((select count(*) from l where rn = 1 and uuid not in (select uuid from l)) as bigint) as second_run from l where rn = 1")
def trusted_batch_twice(spark: SparkSession, d: str) -> DataFrame:
    """Rows that two runs of the same batch add."""
    landing, archive = _landing(spark, d)
    path, events = folder(spark), batches.archived_events(archive)
    added = [batches.run_and_append(spark, lambda done: batches.trusted_batch(landing, events, done), path) for _ in range(2)]
    return spark.createDataFrame([tuple(added)], "first_run long, second_run long")


@_query("select 'vec-' || cast(vec_id as varchar) as uuid, case when vec_id % 5 = 0 then null else cast(200 + 4 * (vec_id % 250) as double) end as lowest, case when vec_id % 5 = 0 then null when vec_id % 2 = 0 then cast(1.0 as double) else cast(0.1 as double) end as harmonic_energy_ratio from embeddings where vec_id % 3 <> 0")
def exploitation_batch(spark: SparkSession, d: str) -> DataFrame:
    """Features by key for trusted rows, a fifth of them without a waveform; odd rows state three times the true peak."""
    waves = tone_keys(spark, d)
    v = F.regexp_extract("uuid", "[0-9]+", 0).cast("long")
    trusted = waves.select("uuid", F.concat(F.lit("a/"), "uuid").alias("audio_path"), F.when(v % 2 == 0, F.col("own_hz")).otherwise(3 * F.col("own_hz")).cast("string").alias("peak_frequency_hz"), F.lit("old").alias("loudness"))
    out = batches.exploitation_batch(trusted, waves.where(v % 5 != 0), trusted.where(v % 3 == 0), tone_samples())
    # of the power of f and 3 f / 3 nine tenths lie at f
    lowest = F.when(F.col("spectral_centroid_hz").isNotNull(), np_round(F.col("spectral_centroid_hz") / 1.2, 3))
    return out.select("uuid", lowest.alias("lowest"), np_round(F.col("harmonic_energy_ratio"), 4).alias("harmonic_energy_ratio"))


@_query("select 'vec-' || cast(vec_id as varchar) as uuid, '1.0.0' as feature_version, cast(0.1 as double) as harmonic_energy_ratio, true as heard from embeddings where vec_id % 4 > 1 union all select 'vec-' || cast(vec_id as varchar), '1.0.0', 1.0, true from embeddings where vec_id % 4 > 1 and vec_id % 3 = 0")
def exploitation_finished(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the last zone: of waveforms of half a second (0) and of none (1) there is none; repeated rows stay, repeated waveforms (2) add none."""
    waves, v = tone_keys(spark, d), F.regexp_extract("uuid", "[0-9]+", 0).cast("long") % 4
    sounds = waves.where(v != 1).unionByName(waves.where(v == 2)).withColumn("n", F.when(v == 0, 4000).otherwise(8000))
    rows = waves.select("uuid", F.concat(F.lit("a/"), "uuid").alias("audio_path"), (3 * F.col("own_hz")).cast("string").alias("peak_frequency_hz"), "own_hz")
    more = rows.where(F.regexp_extract("uuid", "[0-9]+", 0).cast("long") % 3 == 0).withColumn("peak_frequency_hz", F.col("own_hz").cast("string"))
    out = batches.finished(batches.exploitation_batch(rows.unionByName(more).drop("own_hz"), sounds, None, F.slice(tone_samples(), F.lit(1), F.col("n"))))
    return out.select("uuid", "feature_version", np_round(F.col("harmonic_energy_ratio"), 4).alias("harmonic_energy_ratio"), (F.size("mfccs") == 13).alias("heard"))


@_query(f"select {_EV} as uuid, value * 10 as peak from events where value * 10 > 0 and event_id % 37 <> 0 and event_id % 59 <> 0 and event_id % 67 <> 0")
def positive_peaks(spark: SparkSession, d: str) -> DataFrame:
    return batches.positive_peak(observations(spark, d)).select("uuid", F.col("peak_frequency_hz").cast("double").alias("peak"))


@_query("select c_custkey, c_name from customer order by c_custkey limit 25")
def ordered_preview(spark: SparkSession, d: str) -> DataFrame:
    return batches.preview(batches.existing(read(spark, d, "customer"), "c_custkey", "nothing", "c_name"), 25, "c_custkey")


_BEST = f"select {_EV} as uuid, 'u-' || cast(user_id as varchar) as source_id, ((event_id * 7919) % 1000) / cast(1000 as double) as symmetry_score, ((event_id * 104729) % 1000) / cast(1000 as double) as pattern_stability_score from events"


@_query(f"select row_number() over (order by (symmetry_score + pattern_stability_score) / 2 desc, uuid) as rank, uuid, source_id, symmetry_score, pattern_stability_score, (symmetry_score + pattern_stability_score) / 2 as combined_score from ({_BEST}) order by 1 limit 10")
def best_candidates_report(spark: SparkSession, d: str) -> DataFrame:
    return batches.best_candidates(observations(spark, d).drop("category", "source", "peak_frequency_hz"))


def _captured(spark: SparkSession, samples: DataFrame, size: int, capacity: int, drops: int) -> DataFrame:
    """Batches of (device, tick, place, sample) rows that arrive in drops of files, the stream being stopped and started for each."""
    path = folder(spark)
    at = samples.agg(F.percentile("tick", [k / drops for k in range(1, drops)])).first()[0]
    drop = sum((F.when(F.col("tick") > F.lit(x), 1).otherwise(0) for x in at), F.lit(0))
    samples.withColumn("drop", drop).write.partitionBy("drop").parquet(f"{path}/samples")
    for k in range(drops):
        arrived = spark.read.parquet(f"{path}/samples").where(F.col("drop") == k).drop("drop")
        arrived.write.mode("append").parquet(f"{path}/arrived")
        stream = spark.readStream.schema(samples.schema).parquet(f"{path}/arrived")
        capture.run_captured(capture.capture_batches(stream, size, capacity), f"{path}/batches", f"{path}/mark")
    return spark.read.schema(capture.BATCHES).parquet(f"{path}/batches")


@_query("""with k as (select cast(user_id as varchar) as device, event_id as place, value, row_number() over (partition by user_id order by event_id) - 1 as pos from events)
 select device, cast(pos // 5 as bigint) as batch, min(place) as first, max(place) as last, count(*) as n, round_even(sum(value) * 1000.0, 0) / 1000.0 as total, cast(0 as bigint) as dropped from k group by device, pos // 5 having count(*) = 5""")
def sample_batches(spark: SparkSession, d: str) -> DataFrame:
    """A consumer that looks at every sample: each whole batch of each device comes out once, over three starts of the stream."""
    events = read(spark, d, "events").select(F.col("user_id").cast("string").alias("device"), F.col("event_id").alias("tick"), F.col("event_id").alias("place"), F.col("value").alias("sample"))
    found = _captured(spark, events, 5, 10, 3)
    return found.select("device", "batch", "first", "last", "n", np_round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 3).alias("total"), "dropped")


@_query("""with recursive e as (select cast(user_id % 7 as varchar) as device, event_id as place, (event_id // 50) as tick, row_number() over (partition by user_id % 7 order by event_id) as seen from events),
 t as (select device, tick, max(seen) as seen, row_number() over (partition by device order by tick) as i from e group by device, tick),
 s as (select device, 0 as i, cast(0 as bigint) as head, cast(0 as bigint) as dropped, cast(0 as bigint) as batch, cast(null as bigint) as front from (select distinct device from e)
  union all select s.device, t.i, greatest(s.head, t.seen - 12) + case when t.seen - greatest(s.head, t.seen - 12) >= 6 then 6 else 0 end, s.dropped + greatest(0, t.seen - 12 - s.head),
   s.batch + case when t.seen - greatest(s.head, t.seen - 12) >= 6 then 1 else 0 end, case when t.seen - greatest(s.head, t.seen - 12) >= 6 then greatest(s.head, t.seen - 12) end from s join t on s.device = t.device and t.i = s.i + 1)
 select s.device, s.batch - 1 as batch, a.place as first, b.place as last, cast(6 as bigint) as n, s.dropped from s join e a on s.device = a.device and a.seen = s.front + 1 join e b on s.device = b.device and b.seen = s.front + 6""")
def sample_batches_behind(spark: SparkSession, d: str) -> DataFrame:
    """A consumer that looks too seldom: one batch a look, and the oldest samples beyond the backlog are dropped and counted."""
    e = F.col("event_id")
    events = read(spark, d, "events").select((F.col("user_id") % 7).cast("string").alias("device"), F.floor(e / 50).alias("tick"), e.alias("place"), F.col("value").alias("sample"))
    return _captured(spark, events, 6, 12, 2).select("device", "batch", "first", "last", "n", "dropped")


@_query("select event_id, substring(sha256(cast(event_id as varchar) || chr(1) || event_type), 1, 32) as uuid from events where event_type is not null")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").where("event_type is not null").select("event_id", batches.event_id("event_id", "event_type").alias("uuid"))
