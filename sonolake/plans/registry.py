"""The query registry: name -> query over the driver's tables, and DuckDB SQL with the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sonolake.functions.clean import hundreds_path, no_sentinel, np_round, tags_list, tags_text, to_number
from sonolake.operators import features, order, zones
from sonolake.plans import batches, hotpath, kpi, roundtrips
from sonolake.sources import paged
from sonolake.sources.observations import HOT_EVENT, observations, read
from sonolake.streaming import hot

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

OBS = """obs as (select event_id, 'ev-' || lpad(cast(event_id as varchar), 8, '0') as uuid, 'u-' || cast(user_id as varchar) as source_id,
 case event_type when 'view' then 'warm-path' when 'click' then 'hot-path' when 'purchase' then 'Freesound' when 'signup' then ' ESC-50 ' when 'error' then '-' end as source,
 case when event_id % 41 = 0 then '-' when event_id % 43 = 0 then 'nan' when event_id % 47 = 0 then 'None' when event_id % 53 = 0 then '' when event_id % 61 = 0 then null
  else ' cat_' || lpad(cast(cast(json_extract_string(props, '$.k') as int) % 17 as varchar), 2, '0') end as category,
 case when event_id % 37 = 0 or event_id % 59 = 0 or event_id % 67 = 0 then null else value * 10 end as peak,
 ((event_id * 7919) % 1000) / cast(1000 as double) as symmetry_score, ((event_id * 104729) % 1000) / cast(1000 as double) as pattern_stability_score,
 value as t, value / 10 as entropy, value * 20 as centroid from events),
typed as (select * replace (case when trim(category) in ('', '-', 'nan', 'None') then null else trim(category) end as category,
 case when trim(source) in ('', '-', 'nan', 'None') then null else trim(source) end as source) from obs)"""
_R = lambda e, d: f"round_even(({e}) * {10**d}.0, 0) / {10**d}.0"
_BAND = "case when peak < 200 then 'Low' when peak < 1000 then 'Mid' else 'High' end"
_PEAKS = f"""{OBS}, counted as (select category, cast(round_even(peak, 0) as bigint) as frequency_hz_rounded, count(*) as occurrence_count from typed where category is not null and peak is not null group by 1, 2),
peaks as (select *, sum(occurrence_count) over (partition by category) as total from counted)"""
_MODE = f"""{_PEAKS}, mode as (select category, frequency_hz_rounded, occurrence_count, cast(total as bigint) as total_in_category, {_R("occurrence_count / cast(total as double)", 4)} as share
 from (select *, row_number() over (partition by category order by occurrence_count desc, frequency_hz_rounded) as rn from peaks) where rn = 1)"""
_PAIRS = f"""{OBS}, means as (select category, avg(peak) as m from typed where category is not null and peak is not null group by 1),
pairs as (select a.category as category_a, b.category as category_b, {_R("a.m", 2)} as mean_a, {_R("b.m", 2)} as mean_b, {_R("abs(a.m - b.m)", 2)} as difference from means a join means b on a.category < b.category)"""
_TOP = lambda body, order, n=10: f"select *, row_number() over (order by {order}) as rank from ({body}) qualify row_number() over (order by {order}) <= {n}"


def _obs(name: str, query, sql: str | None) -> None:
    QUERIES[name] = lambda spark, d: query(observations(spark, d))
    if sql:
        ORACLE[name] = f"with {sql}"


_obs("freq_clusters", kpi.frequency_clusters, f"{OBS} select band, count(uuid) as recording_count, count(distinct category) as category_count, {_R('count(uuid) / cast((select count(*) from typed where peak is not null) as double)', 4)} as share from (select *, {_BAND} as band from typed where peak is not null) group by band")
_obs("freq_cluster_top_categories", kpi.cluster_top_categories, f"{OBS}, g as (select {_BAND} as band, category, count(*) as recording_count from typed where category is not null and peak is not null group by 1, 2), w as (select *, {_R('recording_count / cast(sum(recording_count) over (partition by band) as double)', 4)} as share_within_band, row_number() over (partition by band order by recording_count desc, category) as rank_in_band from g) select * from w where rank_in_band <= 3")
_obs("mode_freq_per_category", kpi.mode_frequency, f"{_MODE} select * from mode")
_obs("top_mode_share", kpi.top_mode_share, f"{_MODE} {_TOP('select * from mode', 'share desc, category')}")
_obs("freq_distribution_detail", kpi.frequency_detail, f"{_PEAKS} select category, frequency_hz_rounded, occurrence_count, rank from (select *, dense_rank() over (partition by category order by occurrence_count desc) as rank from peaks) where rank <= 5")
_SCORED = "select uuid, symmetry_score, pattern_stability_score, (symmetry_score + pattern_stability_score) / 2 as score from obs"
_obs("best_candidates", kpi.best_candidates, f"{OBS} {_TOP(_SCORED, 'score desc, uuid')}")
_obs("best_candidates_dense", kpi.best_candidates_dense, f"{OBS} select uuid, symmetry_score, pattern_stability_score, score, rank from (select *, dense_rank() over (order by score desc) as rank, row_number() over (order by score desc, uuid) as rn from ({_SCORED})) where rn <= 10")
_obs("category_pairs", kpi.category_pairs, f"{_PAIRS} select * from pairs")
_obs("category_pairs_top", kpi.closest_pairs, f"{_PAIRS} {_TOP('select * from pairs', 'difference, category_a, category_b')}")
_obs("category_pairs_unique", kpi.closest_pairs_unique, f"""recursive {_PAIRS}, listed as (select *, row_number() over (order by difference, category_a, category_b) as i from pairs),
 scan as (select cast(0 as bigint) as i, cast([] as varchar[]) as used, false as picked
  union all select l.i, case when len(s.used) < 20 and not list_contains(s.used, l.category_a) and not list_contains(s.used, l.category_b) then list_concat(s.used, [l.category_a, l.category_b]) else s.used end,
  len(s.used) < 20 and not list_contains(s.used, l.category_a) and not list_contains(s.used, l.category_b) from scan s join listed l on l.i = s.i + 1)
 select category_a, category_b, mean_a, mean_b, difference, row_number() over (order by l.i) as rank from listed l join scan s on l.i = s.i where s.picked""")
_obs("proc_time_per_source", kpi.processing_time, f"{OBS} select source, {_R('avg(t)', 3)} as avg_seconds, {_R('stddev_samp(t)', 3)} as std_seconds, {_R('min(t)', 3)} as min_seconds, {_R('max(t)', 3)} as max_seconds, count(uuid) as recording_count from typed where source is not null and t is not null group by source")
_obs("complex_categories", kpi.complex_categories, f"{OBS} {_TOP(f'''select category, {_R('avg(entropy)', 4)} as mean_entropy, {_R('max(entropy)', 4)} as max_entropy, count(uuid) as recording_count from typed where category is not null and entropy is not null group by category''', 'mean_entropy desc, category')}")
_obs("complex_recordings", kpi.complex_recordings, f"{OBS} {_TOP('select uuid, category, entropy as spectral_entropy from typed where entropy is not null', 'spectral_entropy desc, uuid')}")
_CENTROIDS = f"select category, {_R('avg(centroid)', 2)} as mean_centroid_hz, count(uuid) as recording_count from typed where category is not null and centroid is not null group by category"
_obs("bright_dark_categories", kpi.bright_dark_categories, f"""{OBS}, g as ({_CENTROIDS}), b as (select *, 'brightest' as "group", row_number() over (order by mean_centroid_hz desc, category) as r from g), k as (select *, 'darkest' as "group", row_number() over (order by mean_centroid_hz, category) as r from g),
u as (select * from b where r <= 5 union all select * from k where r <= 5) select category, mean_centroid_hz, recording_count, row_number() over (order by "group", r) as rank, "group" from u""")
_obs("bright_dark_full", kpi.bright_dark_full, f"""{OBS}, g as ({_CENTROIDS}), rec as (select uuid, category, centroid as centroid_hz from typed where centroid is not null),
u as (select uuid, category, centroid_hz, row_number() over (order by centroid_hz desc, uuid) as rank, 'recording' as aggregation_level, 'brightest' as rank_group, cast(null as bigint) as recording_count from rec
 union all select uuid, category, centroid_hz, row_number() over (order by centroid_hz, uuid), 'recording', 'darkest', null from rec
 union all select null, category, mean_centroid_hz, row_number() over (order by mean_centroid_hz desc, category), 'category', 'brightest', recording_count from g
 union all select null, category, mean_centroid_hz, row_number() over (order by mean_centroid_hz, category), 'category', 'darkest', recording_count from g) select * from u where rank <= 5""")
_obs("sentinel_clean", lambda o: o.select("uuid", no_sentinel(F.col("category")).alias("category"), no_sentinel(F.col("source")).alias("source")), f"{OBS} select uuid, category, source from typed")
_obs("lenient_numeric", lambda o: o.select("uuid", np_round(to_number(F.col("peak_frequency_hz")), 4).alias("peak")), f"{OBS} select uuid, {_R('peak', 4)} as peak from typed")
_obs("qa_required_keys", lambda o: zones.required_keys(zones.trim_all(o.select("uuid", "category")), "uuid", "category"), f"{OBS} select uuid, trim(category) as category from obs where length(trim(category)) > 0")
_obs("pending_by_source", lambda o: kpi.typed(zones.pending(o, o.where("event_id % 3 = 0"))).groupBy("source").agg(F.count(F.lit(1)).alias("n")), f"{OBS} select source, count(*) as n from typed where event_id % 3 <> 0 group by source")
_obs("pending_left_anti", lambda o: zones.pending(o.where("event_id % 3 = 0"), o.where("event_id % 6 = 0")).select("uuid", "source_id"), f"{OBS} select uuid, source_id from obs where event_id % 3 = 0 and event_id % 6 <> 0")
_obs("pending_second_run", lambda o: zones.counts_by(zones.pending(o, kpi.typed(o).where("category is not null and source is not null")), "source"), f"{OBS} select source, count(*) as n from obs where uuid not in (select uuid from typed where category is not null and source is not null) group by source")
_obs("zone_overlap", lambda o: zones.zone_overlap({"landing": o, "trusted": o.where("event_id % 3 = 0"), "exploitation": o.where("event_id % 6 = 0")}), f"""{OBS}, z as (select uuid, 'landing' as zone from obs union all select uuid, 'trusted' from obs where event_id % 3 = 0 union all select uuid, 'exploitation' from obs where event_id % 6 = 0)
 select a.zone as zone_a, b.zone as zone_b, count(*) as n_shared from (select distinct * from z) a join (select distinct * from z) b on a.uuid = b.uuid and a.zone <= b.zone group by 1, 2""")
_obs("column_profile", lambda o: zones.column_profile(kpi.typed(o).select("uuid", "category", "source", "peak")).select("column_name", "non_null"), f"{OBS} select 'uuid' as column_name, count(uuid) as non_null from typed union all select 'category', count(category) from typed union all select 'source', count(source) from typed union all select 'peak', count(peak) from typed")
_obs("schema_evolve_union", lambda o: zones.append_evolving(o.select("uuid", "source_id"), o.select("uuid", "source_id", "category")), f"{OBS} select uuid, source_id, '' as category from obs union all select uuid, source_id, coalesce(category, '') from obs")


def _feature_describe(obs):
    x = kpi.typed(obs)
    row = lambda c: F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n"), F.col(f"m_{c}").alias("mean"), F.col(f"a_{c}").alias("min"), F.col(f"b_{c}").alias("max"))
    cols = ("spectral_entropy", "spectral_centroid_hz")
    return x.agg(*(f(c).alias(f"{p}_{c}") for c in cols for p, f in (("n", F.count), ("m", lambda c: np_round(F.avg(c), 4)), ("a", lambda c: np_round(F.min(c), 4)), ("b", lambda c: np_round(F.max(c), 4))))).select(F.inline(F.array(*(row(c) for c in cols))))


_DESCRIBE = lambda c, n: f"select '{n}' as feature, count({c}) as n, {_R(f'avg({c})', 4)} as mean, {_R(f'min({c})', 4)} as min, {_R(f'max({c})', 4)} as max from typed"
_obs("feature_describe", _feature_describe, f"{OBS} {_DESCRIBE('entropy', 'spectral_entropy')} union all {_DESCRIBE('centroid', 'spectral_centroid_hz')}")


def _dense_ranks(spark, d):
    o = observations(spark, d)
    score = (F.col("symmetry_score") + F.col("pattern_stability_score")) / 2
    return order.dense_rank(o.select("uuid", F.when(F.col("event_id") % 5 > 0, score).alias("score")), "score", roundtrips.folder(spark)).select("uuid", "rank")


QUERIES["dense_ranks"] = _dense_ranks
ORACLE["dense_ranks"] = """with s as (select 'ev-' || lpad(cast(event_id as varchar), 8, '0') as uuid, case when event_id % 5 > 0 then (((event_id * 7919) % 1000) / cast(1000 as double) + ((event_id * 104729) % 1000) / cast(1000 as double)) / 2 end as score from events)
 select uuid, case when score is not null then dense_rank() over (order by score desc nulls last) end as rank from s"""


def _feature_description(spark, d):
    o = kpi.typed(observations(spark, d)).withColumn("none", F.lit(None).cast("double"))
    found = order.description(o, ["peak", "spectral_entropy", "symmetry_score", "none"], roundtrips.folder(spark))
    return found.select("column_name", "count", *(np_round(F.col(c), 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")))


_DESCRIPTION = lambda c, n: f"select '{n}' as column_name, count({c}) as count, " + ", ".join(f"{_R(e, 4)} as {a}" for e, a in ((f"avg({c})", "mean"), (f"stddev_samp({c})", "std"), (f"min({c})", "min"), (f"quantile_cont({c}, 0.25)", "p25"), (f"quantile_cont({c}, 0.5)", "p50"), (f"quantile_cont({c}, 0.75)", "p75"), (f"max({c})", "max"))) + " from typed"
QUERIES["feature_description"] = _feature_description
ORACLE["feature_description"] = f"with {OBS} " + " union all ".join(_DESCRIPTION(c, n) for c, n in (("peak", "peak"), ("entropy", "spectral_entropy"), ("symmetry_score", "symmetry_score"), ("cast(null as double)", "none")))


def _dedupe_latest(spark, d):
    order = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return zones.latest(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], *order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


QUERIES["dedupe_latest"] = _dedupe_latest
ORACLE["dedupe_latest"] = """select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, row_number() over (partition by l_orderkey, l_linenumber
 order by l_shipdate desc nulls last, l_partkey desc nulls last, l_suppkey desc nulls last, l_quantity desc nulls last, l_extendedprice desc nulls last, l_discount desc nulls last, l_tax desc nulls last) as rn from lineitem) where rn = 1"""


def _latest_event_merge(spark, d):
    rows = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("uuid"), F.lit(None).cast("string").alias("time_recorded"))
    events = read(spark, d, "events").select(F.col("user_id").cast("string").alias("uuid"), F.col("event_type").alias("device"), F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("/"), F.lpad(F.col("event_id").cast("string"), 10, "0")).alias("event_time"))
    return zones.merge_events(rows, events).select("uuid", "device", F.substring("time_recorded", 28, 10).alias("event"))


QUERIES["latest_event_merge"] = _latest_event_merge
ORACLE["latest_event_merge"] = """with last as (select * from (select user_id, event_type, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1)
 select cast(c_custkey as varchar) as uuid, coalesce(event_type, '-') as device, coalesce(lpad(cast(event_id as varchar), 10, '0'), '') as event from customer left join last on user_id = c_custkey"""


def _event_json_parse(spark, d):
    audio = F.concat(F.lit('{"audio_path": "audio/hot-path/raw/'), F.col("event_id").cast("string"), F.lit('.wav", "bucket": "landing", "sample_rate": 44100, "duration": 5, "device": "'), F.col("event_type"), F.lit('"}'))
    return read(spark, d, "events").select(F.from_json(audio, HOT_EVENT).alias("e")).select(zones.uuid_of_path(F.col("e.audio_path")).alias("uuid"), "e.bucket", "e.sample_rate", "e.duration", "e.device")


QUERIES["event_json_parse"] = _event_json_parse
ORACLE["event_json_parse"] = "select cast(event_id as varchar) as uuid, 'landing' as bucket, 44100 as sample_rate, 5 as duration, event_type as device from events"
QUERIES["path_template"] = lambda spark, d: read(spark, d, "events").select("event_id", hundreds_path(F.col("value"), F.col("event_id")).alias("path"))
ORACLE["path_template"] = "select event_id, 'audio/' || cast(cast(floor(value / 100) as bigint) * 100 as varchar) || '-' || cast((cast(floor(value / 100) as bigint) + 1) * 100 as varchar) || '/' || cast(event_id as varchar) || '.wav' as path from events"
QUERIES["tags_roundtrip"] = lambda spark, d: read(spark, d, "part").select("p_partkey", tags_text(tags_list(F.lower("p_type"), " ")).alias("tags"), F.size(tags_list(tags_text(tags_list(F.col("p_type"), " ")))).cast("long").alias("n_tags"))
ORACLE["tags_roundtrip"] = "select p_partkey, replace(lower(p_type), ' ', '|') as tags, cast(length(p_type) - length(replace(p_type, ' ', '')) + 1 as bigint) as n_tags from part"
QUERIES["diverse_batch"] = lambda spark, d: zones.diverse_batch(read(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 250)
ORACLE["diverse_batch"] = "select doc_id, source, rn from (select *, row_number() over (order by rn, source) as place from (select doc_id, source, row_number() over (partition by source order by doc_id) as rn from documents)) where place <= 250"


def _waves(spark, d):
    return read(spark, d, "embeddings").select(F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("uuid"), F.col("embedding").cast("array<double>").alias("samples"), F.lit(64).alias("sample_rate"))


QUERIES["acoustic_features"] = lambda spark, d: features.with_features(features.long_enough(_waves(spark, d)))


def _energy(spark, d):
    return QUERIES["acoustic_features"](spark, d).select("uuid", np_round(F.col("signal_energy"), 6).alias("signal_energy"), np_round(F.col("zero_crossing_rate"), 6).alias("zero_crossing_rate"), np_round(F.col("loudness"), 6).alias("loudness"))


QUERIES["energy_features"] = _energy
ORACLE["energy_features"] = f"""with x as (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings), s as (select vec_id, i, cast(v as double) / max(abs(cast(v as double))) over (partition by vec_id) as v from x),
 l as (select *, case when v >= 0 then 1 else -1 end as sg, lag(case when v >= 0 then 1 else -1 end) over (partition by vec_id order by i) as pg from s)
 select 'vec-' || cast(vec_id as varchar) as uuid, {_R("sum(v * v)", 6)} as signal_energy, {_R("sum(case when pg is not null and sg <> pg then 1 else 0 end) / 63.0", 6)} as zero_crossing_rate, {_R("20 * log10(sqrt(avg(v * v)) + 1e-20)", 6)} as loudness from l group by vec_id"""


def _windowed(make):
    def run(spark, d):
        out = hot.replay(make(hot.event_stream(spark, d)), "complete")
        return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("window_start"), *(c for c in out.columns if c != "window"))

    return run


QUERIES["stream_tumbling"] = _windowed(hot.tumbling)
ORACLE["stream_tumbling"] = "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') as window_start, count(*) as n, count(value) as n_values from events group by 1"
QUERIES["stream_dedupe"] = lambda spark, d: hot.replay(hot.unique_events(hot.event_stream(spark, d)).select("event_id", "user_id", "event_type"), "append")
ORACLE["stream_dedupe"] = "select distinct event_id, user_id, event_type from events"
QUERIES["stream_sliding"] = _windowed(hot.sliding)
ORACLE["stream_sliding"] = """with h as (select date_trunc('day', ts) + case when extract(hour from ts) >= 12 then interval 12 hour else interval 0 hour end as s from events)
 select strftime(s, '%Y-%m-%d %H:%M') as window_start, count(*) as n from (select s from h union all select s - interval 12 hour as s from h) group by 1"""


def _spectral(spark, d):
    names = ("spectral_centroid_hz", "spectral_bandwidth_hz", "spectral_flatness", "spectral_entropy")
    return QUERIES["acoustic_features"](spark, d).select("uuid", *(np_round(F.col(c), 5).alias(c) for c in names))


QUERIES["spectral_features"] = _spectral
ORACLE["spectral_features"] = f"""with x as (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings), s as (select vec_id, i, cast(v as double) / max(abs(cast(v as double))) over (partition by vec_id) as v from x),
 k as (select unnest(range(0, 33)) as f), b as (select vec_id, f, sqrt(power(sum(v * cos(2 * pi() * f * i / 64)), 2) + power(sum(v * sin(2 * pi() * f * i / 64)), 2)) as m from s, k group by vec_id, f),
 t as (select vec_id, sum(m * m) as p, sum(f * m * m) / sum(m * m) as c, exp(avg(ln(m + 1e-20))) / avg(m) as fl from b group by vec_id)
 select 'vec-' || cast(b.vec_id as varchar) as uuid, {_R("max(c)", 5)} as spectral_centroid_hz, {_R("sqrt(sum((f - c) * (f - c) * m * m) / max(p))", 5)} as spectral_bandwidth_hz, {_R("max(fl)", 5)} as spectral_flatness,
 {_R("-sum(case when m * m / p > 1e-20 then m * m / p * ln(m * m / p) else 0 end)", 5)} as spectral_entropy from b join t on b.vec_id = t.vec_id group by b.vec_id"""
QUERIES["sliding_windows"] = lambda spark, d: features.sliding_windows(_waves(spark, d)).select("uuid", "offset", np_round(F.col("energy"), 6).alias("energy"))
ORACLE["sliding_windows"] = f"""with x as (select vec_id, cast(unnest(embedding) as double) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings), o as (select unnest(range(0, 48, 8)) as o), k as (select unnest(range(0, 9)) as f),
 p as (select vec_id, o, f, power(sum(v * cos(2 * pi() * f * (i - o) / 16)), 2) + power(sum(v * sin(2 * pi() * f * (i - o) / 16)), 2) as p from x, o, k where i >= o and i < o + 16 group by vec_id, o, f)
 select 'vec-' || cast(vec_id as varchar) as uuid, cast(o as int) as "offset", {_R("sum(p)", 6)} as energy from p group by vec_id, o"""
# whole energies, so that sums don't depend on their order
QUERIES["harmonic_vote"] = lambda spark, d: features.harmonic_vote(read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("place"), F.floor("value").alias("bin"), (F.col("event_id") % 97 + 1).alias("energy")))
ORACLE["harmonic_vote"] = """with s as (select user_id as key, event_id as place, cast(floor(value) as bigint) as bin, event_id % 97 + 1 as energy, d from events, (select unnest([1, 2, 3, 4]) as d) where floor(value) > 0 and cast(floor(value) as bigint) % d = 0),
 g as (select key, bin // d as bin, sum(energy) as energy, min(place * 10 + d) as seen from s group by 1, 2) select key, bin from (select *, row_number() over (partition by key order by energy desc, seen) as rn from g) where rn = 1"""
_obs("text_profile", lambda o: zones.text_profile(kpi.typed(o), "category", "source"), f"""{OBS}, l as (select 'category' as column_name, category as value from typed union all select 'source', source from typed), c as (select column_name, value, count(*) as n from l where value is not null group by 1, 2),
 r as (select *, row_number() over (partition by column_name order by n desc, value) as rn, sum(n) over (partition by column_name) as t, count(*) over (partition by column_name) as u from c) select column_name, cast(t as bigint) as non_null, u as n_unique, value as top, n as freq from r where rn = 1""")
_obs("qa_trim", lambda o: zones.trim_all(o.select("uuid", "category", "source")), f"{OBS} select uuid, trim(category) as category, trim(source) as source from obs")
_obs("category_search", lambda o: zones.matching(kpi.typed(o), "category", "CAT_1").select("uuid", "category"), f"{OBS} select uuid, category from typed where regexp_matches(category, 'CAT_1', 'i')")
_obs("allowed_categories", lambda o: zones.only(kpi.typed(o), "category", ["cat_03", "cat_07", "cat_11"]).select("uuid", "category"), f"{OBS} select uuid, category from typed where category in ('cat_03', 'cat_07', 'cat_11')")
_obs("category_counts", lambda o: zones.counts_by(kpi.typed(o), "category"), f"{OBS} select category, count(*) as n from typed group by category")
_obs("new_sources", lambda o: paged.new_only(o.select("source_id"), o.where("event_id % 211 = 0")), f"{OBS} select distinct source_id from obs where source_id not in (select source_id from obs where event_id % 211 = 0)")
_obs("merge_metrics", lambda o: zones.merge_metrics(o.select(F.when(F.col("event_id") % 19 != 0, F.col("uuid")).alias("uuid"), "source"), o.where("event_id % 3 = 0")), f"""{OBS}, r as (select case when event_id % 19 <> 0 then uuid end as uuid, source from obs), e as (select uuid from obs where event_id % 3 = 0)
 select (select count(distinct uuid) from e) as n_events, count(*) filter (where uuid in (select uuid from e)) as n_matched, count(*) filter (where uuid is not null and uuid not in (select uuid from e) and lower(trim(source)) = 'hot-path') as n_hot_unmatched,
 count(*) filter (where uuid is null) as n_dropped from r""")
_SINCE = "2024-01-15T12:00:00.000000Z"
_obs("incremental_since", lambda o: zones.since(o, "time_recorded", _SINCE).select("uuid"), f"s as (select 'ev-' || lpad(cast(event_id as varchar), 8, '0') as uuid from events where strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') >= '{_SINCE}') select uuid from s")


def _paths(spark, d):
    name = F.col("event_id").cast("string")
    path = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("audio/raw/"), name, F.lit(".wav"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("x/"), name, F.lit(".mp3"))).when(F.col("event_id") % 2 == 0, F.lit("a/.wav")).otherwise(name)
    return read(spark, d, "events").select("event_id", zones.uuid_of_path(path).alias("uuid"))


QUERIES["uuid_from_path"] = _paths
ORACLE["uuid_from_path"] = "select event_id, case when event_id % 3 = 2 and event_id % 2 = 0 then null else cast(event_id as varchar) || case when event_id % 3 = 1 then '.mp3' else '' end end as uuid from events"


def _valid_events(spark, d):
    e = F.col("event_id")
    events = read(spark, d, "events").select("event_id", F.when(e % 5 > 0, F.concat(F.lit("a/"), e.cast("string"))).alias("audio_path"), F.when(e % 7 > 0, F.lit("landing")).otherwise("").alias("bucket"))
    return zones.valid_events(events)


QUERIES["valid_events"] = _valid_events
ORACLE["valid_events"] = "select event_id, 'a/' || cast(event_id as varchar) as audio_path, 'landing' as bucket from events where event_id % 5 > 0 and event_id % 7 > 0"


def _fixed_length(spark, d):
    sizes = [features.fit_length(_waves(spark, d), s).select("uuid", F.size("samples").alias("n"), np_round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x), 6).alias("energy")) for s in (0.75, 2.0)]
    return sizes[0].union(sizes[1])


QUERIES["fixed_length"] = _fixed_length
ORACLE["fixed_length"] = f"""with x as (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings)
 select 'vec-' || cast(vec_id as varchar) as uuid, n, {_R("sum(case when i <= n then cast(v as double) * cast(v as double) else 0 end)", 6)} as energy from x, (select unnest([48, 128]) as n) group by vec_id, n"""
_POWER = """x as (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings), s as (select vec_id, i, cast(v as double) / max(abs(cast(v as double))) over (partition by vec_id) as v from x),
 k as (select unnest(range(0, 33)) as f), p as (select vec_id, f, power(sum(v * cos(2 * pi() * f * i / 64)), 2) + power(sum(v * sin(2 * pi() * f * i / 64)), 2) as p from s, k group by vec_id, f)"""
QUERIES["spectral_rolloff"] = lambda spark, d: QUERIES["acoustic_features"](spark, d).select("uuid", "spectral_rolloff_hz")
ORACLE["spectral_rolloff"] = f"""with {_POWER}, c as (select vec_id, f, sum(p) over (partition by vec_id order by f) as c, sum(p) over (partition by vec_id) as t from p)
 select 'vec-' || cast(vec_id as varchar) as uuid, cast(min(f) as double) as spectral_rolloff_hz from c where c >= 0.85 * t group by vec_id"""
QUERIES["harmonic_share"] = lambda spark, d: features.harmonic_share(_waves(spark, d), F.lit(9.0)).select("uuid", np_round(F.col("harmonic_energy_ratio"), 6).alias("harmonic_energy_ratio"))
ORACLE["harmonic_share"] = f"""with {_POWER} select 'vec-' || cast(vec_id as varchar) as uuid, {_R("sum(p * ((abs(f - 9) <= 5)::int + (abs(f - 18) <= 5)::int + (abs(f - 27) <= 5)::int)) / sum(p)", 6)} as harmonic_energy_ratio from p group by vec_id"""
QUERIES["mel_cepstra"] = lambda spark, d: features.cepstra(_waves(spark, d), 5, 32, 16, 10).select("uuid", F.posexplode("mfccs").alias("k", "value")).select("uuid", "k", "value")
ORACLE["mel_cepstra"] = f"""with mel as (select i, least(greatest(floor(33 * 700 * (power(10, i * 2595 * log10(1 + 32 / 700.0) / 11 / 2595) - 1) / 64), 0), 16) as b from (select unnest(range(0, 12)) as i)),
 bank as (select m.i as m, f, case when f >= a.b and f < m.b then (f - a.b) / greatest(m.b - a.b, 1) when f >= m.b and f < c.b then (c.b - f) / greatest(c.b - m.b, 1) else 0 end as w
  from mel m join mel a on a.i = m.i - 1 join mel c on c.i = m.i + 1, (select unnest(range(0, 17)) as f)),
 x as (select vec_id, cast(unnest(embedding) as double) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings), fr as (select unnest(range(0, 3)) as t), k as (select unnest(range(0, 17)) as f),
 s as (select vec_id, t, i - 16 * t as j, v * (0.5 - 0.5 * cos(2 * pi() * (i - 16 * t) / 31)) as v from x, fr where i >= 16 * t and i < 16 * t + 32),
 p as (select vec_id, t, f, power(sum(v * cos(2 * pi() * f * j / 32)), 2) + power(sum(v * sin(2 * pi() * f * j / 32)), 2) as p from s, k group by vec_id, t, f),
 e as (select vec_id, t, m - 1 as m, ln(greatest(sum(p * w), 1e-10)) as e from p join bank on p.f = bank.f group by vec_id, t, m),
 c as (select vec_id, t, c, sum(e * cos(pi() * c * (m + 0.5) / 10)) * sqrt(0.2) / case when c = 0 then sqrt(2) else 1 end as v from e, (select unnest(range(0, 5)) as c) group by vec_id, t, c)
 select 'vec-' || cast(vec_id as varchar) as uuid, cast(c as int) as k, {_R("avg(v)", 6)} as value from c group by vec_id, c"""
_obs("drawn_sources", lambda o: paged.drawn(o.select("uuid", "source_id"), "uuid", 40, 7), f"{OBS} select uuid, source_id from obs order by md5('7/' || uuid), uuid limit 40")
QUERIES["frame_profiles"] = lambda spark, d: features.frame_profiles(_waves(spark, d), 1)


def _frame_peaks(spark, d):
    found = features.frame_profiles(_waves(spark, d), 1)
    peaks = F.posexplode(F.arrays_zip("spatial", "magnitude")).alias("place", "p")
    return found.select("uuid", np_round(F.col("rms"), 6).alias("rms"), "dominant_hz", peaks).select("uuid", "rms", "dominant_hz", "place", np_round(F.col("p.spatial"), 6).alias("spatial"), np_round(F.col("p.magnitude"), 6).alias("magnitude"))


QUERIES["frame_peaks"] = _frame_peaks
ORACLE["frame_peaks"] = f"""with x as (select vec_id, cast(unnest(embedding) as double) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings), k as (select unnest(range(0, 33)) as f),
 b as (select vec_id, f, sqrt(power(sum(v * cos(2 * pi() * f * i / 64)), 2) + power(sum(v * sin(2 * pi() * f * i / 64)), 2)) as m from x, k group by vec_id, f),
 y as (select vec_id, f, m / (max(m) over (partition by vec_id) + 1e-12) as m, lag(m) over w as before, lead(m) over w as after, m as raw from b window w as (partition by vec_id order by f)),
 top as (select vec_id, list([f] order by m desc) as fs from y where raw > before and raw > after and m >= 0.08 group by vec_id),
 kept as (select vec_id, unnest(list_reduce(fs, lambda acc, one: case when list_bool_or([abs(z - one[1]) < 5 for z in acc]) then acc else list_concat(acc, one) end)) as f from top),
 own as (select y.vec_id, y.f, y.m from kept join y on kept.vec_id = y.vec_id and kept.f = y.f),
 edge as (select own.vec_id, own.f, own.m, coalesce(max(case when y.f < own.f and y.m > own.m then y.f end), -1) as lo, coalesce(min(case when y.f > own.f and y.m > own.m then y.f end), 33) as hi from own join y on own.vec_id = y.vec_id group by 1, 2, 3),
 low as (select e.vec_id, e.f, e.m, min(case when y.f > lo and y.f <= e.f then y.m end) as l, min(case when y.f >= e.f and y.f < hi then y.m end) as r from edge e join y on e.vec_id = y.vec_id group by 1, 2, 3),
 good as (select vec_id, f, m from low where m - greatest(l, r) >= 0.04),
 listed as (select * from good union all select vec_id, f, m from y where vec_id not in (select vec_id from good) qualify row_number() over (partition by vec_id order by m desc, f) = 1),
 ranked as (select *, row_number() over (partition by vec_id order by m desc, f desc) - 1 as place from listed), loud as (select vec_id, sqrt(avg(v * v)) as rms from x group by vec_id)
 select 'vec-' || cast(r.vec_id as varchar) as uuid, {_R("rms", 6)} as rms, cast(first_value(f) over (partition by r.vec_id order by place) as double) as dominant_hz, cast(place as int) as place, {_R("2.5 + sqrt(f / 33.0) * 15", 6)} as spatial, {_R("m", 6)} as magnitude
 from ranked r join loud on r.vec_id = loud.vec_id where place < 6"""
QUERIES |= roundtrips.QUERIES | hotpath.QUERIES
ORACLE |= roundtrips.ORACLE | hotpath.ORACLE

#: What names a row of each KPI of the catalogue, in both engines, and the query with the KPI's SQL.
_ITEMS = {
    "1": ("category", "category", "top_mode_share"), "2": ("uuid", "uuid", "best_candidates"), "3": ("concat_ws('/', band, category)", "band || '/' || category", "freq_cluster_top_categories"),
    "4": ("concat_ws('/', category_a, category_b)", "category_a || '/' || category_b", "category_pairs_unique"), "5": ("source", "source", "proc_time_per_source"), "6": ("category", "category", "complex_categories"),
    "7": ("concat_ws('/', `group`, category)", "\"group\" || '/' || category", "bright_dark_categories"),
}


def _kpi_run_all(spark, d):
    """The rows of all KPIs of the catalogue by their names."""
    made = [df.select(F.lit(name).alias("kpi"), F.expr(_ITEMS[name][0]).alias("item")) for name, df in batches.run_all(observations(spark, d)).items()]
    return reduce(lambda a, b: a.unionByName(b), made)


QUERIES["kpi_run_all"] = _kpi_run_all
ORACLE["kpi_run_all"] = " union all ".join(f"select '{name}' as kpi, {item} as item from ({ORACLE[query]}) as k{name}" for name, (_, item, query) in _ITEMS.items())
