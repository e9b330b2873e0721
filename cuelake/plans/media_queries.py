"""Queries on audio frames, speakers and scenes, each with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import media as M

from . import fixtures as X

R = lambda c: X.rounded(c).alias(c)
PAUSES = X.FRAMES + """,
p25 as (select media_id, quantile_cont(rms, 0.25) filter (rms > 0) as p from frames group by 1),
f25 as (select f.*, rms < p as q, lead(t_ms) over w as nxt, row_number() over w as i from frames f join p25 using (media_id) window w as (partition by media_id order by t_ms)),
g25 as (select *, i - row_number() over (partition by media_id order by t_ms) as g from f25 where q),
r25 as (select media_id, min(t_ms) as start_ms, max(nxt) as end_ms, avg(rms) as energy, max(nxt) - min(t_ms) as duration_ms from g25 group by media_id, g having count(nxt) = count(*) and max(nxt) - min(t_ms) >= 300),
pauses as (select *, case when duration_ms < 500 then 'short_pause' when duration_ms < 1000 then case when energy < 0.01 then 'natural_break' else 'speech_pause' end when duration_ms < 2000 then 'sentence_break' else 'long_silence' end as kind,
  least(100, 50 + case when duration_ms between 300 and 2000 then 30 when duration_ms > 2000 then 10 else 0 end + case when energy < 0.01 then 20 when energy < 0.05 then 10 else 0 end) / 100 as confidence from r25)"""
MINIMA_ONLY = """
pall as (select media_id, quantile_cont(rms, 0.25) as p from frames group by 1),
nb as (select *, """ + ", ".join(f"lag(rms, {k}) over w as l{k}, lead(rms, {k}) over w as r{k}" for k in (1, 2, 3)) + """ from frames window w as (partition by media_id order by t_ms)),
minima as (select media_id, t_ms, rms from nb join pall using (media_id) where rms < p and """ + " and ".join(f"rms < l{k} and rms < r{k}" for k in (1, 2, 3)) + ")"
MINIMA = X.FRAMES + "," + MINIMA_ONLY
ACTIVITY = X.CUES + "," + X.FRAMES + r""",
inside as (select c.media_id, c.language, c.sdh, c.seq, c.start_ms, c.end_ms, c.text, f.rms, f.zcr, f.centroid from cues c join frames f on f.media_id = c.media_id and f.t_ms >= c.start_ms and f.t_ms < c.end_ms),
thr as (select media_id, language, sdh, seq, coalesce(quantile_cont(rms, 0.3) filter (rms > 0), 0) as r, avg(zcr) as z, avg(centroid) as k from inside group by all),
activity as (select i.media_id, i.language, i.sdh, i.seq, i.start_ms, i.end_ms, len(list_filter(regexp_split_to_array(any_value(i.text), '[\p{Z}\s]+'), lambda x: x <> ''))::int as words, count(*) as frames,
  (count(*) filter (round(i.rms - r, 9) > 0 and round(i.zcr - z * 0.5::double, 9) > 0 and round(z * 2.0::double - i.zcr, 9) > 0 and round(i.centroid - k * 0.3::double, 9) > 0) * 200)::bigint as active_ms from inside i join thr using (media_id, language, sdh, seq) group by all)"""
CHANGES = X.SEGMENTS + """,
lagged as (select media_id, start_ms as t_ms, lag(speaker_id) over w as from_speaker, speaker_id as to_speaker from segments window w as (partition by media_id order by start_ms)),
changes as (select * from lagged where from_speaker <> to_speaker)"""
#: Scenes on the time line of the speaker segments.
SCENES_AT = "\nscenes as (select media_id % 20 as media_id, t_ms * 10 as t_ms from visual where kind = 'scene')"
ELEMENTS = """
elements as (select media_id, speaker_id, i, avg(features[i]) as m from segments, unnest(range(1, 65)) u(i) group by 1, 2, 3),
centres as (select media_id, speaker_id, list(m order by i) as centre from elements group by 1, 2),
conf as (select s.media_id, s.speaker_id, s.start_ms, greatest(0, least(1, list_dot_product(features, centre) / sqrt(list_dot_product(features, features) * list_dot_product(centre, centre)))) as confidence from segments s join centres using (media_id, speaker_id))"""


def _frames(spark, d):
    return X.frames(spark, d)


def _pauses(spark, d):
    return M.detect_pauses(X.frames(spark, d))


def _scenes_at(spark, d):
    return X.visual_events(spark, d).where("kind = 'scene'").select((F.col("media_id") % 20).alias("media_id"), (F.col("t_ms") * 10).alias("t_ms"))


def cue_event_align(spark, d):
    out = M.align_events(X.cues(spark, d), X.visual_events(spark, d))
    return out.select("media_id", "language", "sdh", "seq", *[F.size(c).alias(c) for c in ("scenes", "appearances", "motions")], F.array_min("scenes").alias("first_scene"))


def change_alignment(spark, d):
    changes = M.speaker_changes(X.speaker_segments(spark, d))
    return M.change_alignment(changes, _scenes_at(spark, d)).select("media_id", "changes", "aligned", R("share"))


def nearest_break(spark, d):
    f = X.frames(spark, d)
    edges = X.cues(spark, d).select("media_id", F.struct("language", "sdh", "seq").alias("edge_id"), F.lit("start").alias("side"), F.col("start_ms").alias("t_ms"))
    return M.nearest_break(edges, M.breaks(M.detect_pauses(f), M.energy_minima(f))).select("media_id", "edge_id.*", "t_ms", "snap_ms", "is_pause")


def cue_frame_join(spark, d):
    return M.cue_frames(X.cues(spark, d), X.frames(spark, d)).groupBy("media_id", "language", "sdh", "seq").agg(F.count("*").alias("frames"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"), X.rounded(F.sum("rms")).alias("rms"))


def speech_activity(spark, d):
    return M.speech_activity(X.cues(spark, d), X.frames(spark, d)).select("media_id", "language", "sdh", "seq", "words", "frames", "active_ms", R("activity_ratio"))


def speech_rate(spark, d):
    f = X.frames(spark, d)
    s = M.speech_rate(M.speech_activity(X.cues(spark, d), f), f)
    return s.select("media_id", "language", "sdh", R("mean_wpm"), R("std_wpm"), R("median_wpm"), R("min_wpm"), R("max_wpm"), "too_fast", "too_slow", R("speaking_ratio"))


def detect_pauses(spark, d):
    return _pauses(spark, d).select("media_id", "start_ms", "end_ms", "duration_ms", R("energy"), "kind", "confidence")


def pause_stats(spark, d):
    s = M.pause_stats(_pauses(spark, d))
    return s.select("media_id", "pauses", R("mean_ms"), R("median_ms"), R("std_ms"), "min_ms", "max_ms", "short_pause", "natural_break", "speech_pause", "sentence_break", "long_silence")


def segmentation_points(spark, d):
    return M.segmentation_points(_pauses(spark, d).withColumn("confidence", F.col("confidence") + 0.05))


def energy_profile(spark, d):
    return M.energy_profile(X.frames(spark, d)).select("media_id", *map(R, ("mean_rms", "std_rms", "dynamic_range", "spectral_complexity", "temporal_stability", "variability")))


def energy_minima(spark, d):
    return M.energy_minima(X.frames(spark, d)).select("media_id", "t_ms", R("rms"))


def energy_segments(spark, d):
    return M.energy_segments(X.frames(spark, d)).select("media_id", "start_ms", "end_ms", "duration_ms")


def _retimed(spark, d):
    return M.retime_cues(X.cues(spark, d), M.sound_breaks(X.frames(spark, d)))


def retime_cues(spark, d):
    return _retimed(spark, d).select("media_id", "language", "sdh", "seq", R("new_start_ms"), R("new_end_ms"))


def retime_report(spark, d):
    r = M.retime_report(_retimed(spark, d))
    return r.select("media_id", "language", "sdh", "cues", "extended", "shortened", "changed", R("speed_gain"), R("evenness_gain"), R("timing_score"))


def speaker_cluster(spark, d):
    return M.speaker_cluster(X.speaker_segments(spark, d)).select("media_id", "start_ms", "speaker_id")


def sketch_percentiles(spark, d):
    """Percentiles by sketches, and whether their ranks lie within the accuracy."""
    f = X.frames(spark, d)
    q = M.percentiles(f, F.col("rms"), [0.25, 0.6], 50)
    near = f.join(q, "media_id").groupBy("media_id").agg(F.count("*").alias("frames"), *[F.count(F.when(F.col("rms") <= F.col("q")[k], 1)).alias(f"_at{k}") for k in (0, 1)], *[F.count(F.when(F.col("rms") < F.col("q")[k], 1)).alias(f"_below{k}") for k in (0, 1)])
    fits = lambda k, p: (F.col(f"_at{k}") >= F.col("frames") * (p - 0.02) - 1) & (F.col(f"_below{k}") <= F.col("frames") * (p + 0.02) + 1)
    return near.select("media_id", "frames", (fits(0, 0.25) & fits(1, 0.6)).alias("within"))


def speaker_profiles(spark, d):
    p = M.speaker_profiles(X.speaker_segments(spark, d))
    return p.select("media_id", "speaker_id", "total_ms", "segments", R("mean_pitch"), R("var_pitch"), R("mean_energy"), R("mean_centroid"), R("mean_rolloff"), X.rounded(F.aggregate("mfcc", F.lit(0.0), lambda a, x: a + x)).alias("mfcc_sum"))


def speaker_confidence(spark, d):
    return M.speaker_confidence(X.speaker_segments(spark, d)).groupBy("media_id").agg(X.rounded(F.avg("confidence")).alias("confidence"), X.rounded(F.min("confidence")).alias("least"))


def speaker_changes(spark, d):
    return M.speaker_changes(X.speaker_segments(spark, d)).select("media_id", "t_ms", "from_speaker", "to_speaker")


def _histograms(spark, d):
    return X.speaker_segments(spark, d).select("media_id", F.col("start_ms").alias("t_ms"), F.col("features").alias("histogram"))


def scene_changes(spark, d):
    return M.scene_changes(_histograms(spark, d), 0.0).select("media_id", "t_ms", R("correlation"))


def scene_stats(spark, d):
    return M.scene_stats(M.scene_changes(_histograms(spark, d), 0.0)).select("media_id", "scenes", R("mean_scene_s"), R("per_second"))


def dominant_faces(spark, d):
    return M.dominant_faces(X.faces(spark, d)).select("media_id", "t_ms", "face_id", "area", R("confidence"), "faces")


def snr_quality(spark, d):
    return M.snr_quality(X.frames(spark, d)).select("media_id", R("snr_db"), "quality")


def _cross(spark, d):
    events = X.visual_events(spark, d).select((F.col("media_id") % 20).alias("media_id"), "kind", (F.col("t_ms") * 10).alias("t_ms"))
    return M.cross_modal(X.speaker_segments(spark, d), events, X.cues(spark, d))


def cross_modal(spark, d):
    return _cross(spark, d).select("media_id", "language", "sdh", R("alignment"), R("confidence"), R("multimodal"))


def media_recommendations(spark, d):
    scenes = M.scene_stats(M.scene_changes(_histograms(spark, d), 0.0))
    return M.media_recommendations(M.snr_quality(X.frames(spark, d)), _cross(spark, d), scenes).select("media_id", "language", "sdh", F.array_join("findings", "; ").alias("findings"))


SCENE_SQL = X.SEGMENTS + """,
hist as (select media_id, start_ms as t_ms, features as y, lag(features) over (partition by media_id order by start_ms) as x from segments),
cen as (select media_id, t_ms, list_transform(x, lambda v: v - list_avg(x)) as a, list_transform(y, lambda v: v - list_avg(y)) as b from hist where x is not null),
corr as (select media_id, t_ms, list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) as correlation from cen),
scene_changes as (select * from corr where correlation < 0),
sd as (select *, lead(t_ms) over (partition by media_id order by t_ms) - t_ms as d from scene_changes),
scene_stats as (select media_id, count(*) as scenes, coalesce(avg(d), 0) / 1000 as mean_scene_s, count(*) * 1000 / max(t_ms) as per_second from sd group by 1)"""
ALIGN_ONLY = """
aligned as (select c.media_id, count(*) as changes, count(*) filter (exists (select 1 from scenes s where s.media_id = c.media_id and abs(s.t_ms - c.t_ms) < 2000)) as aligned from changes c group by 1)"""
SNR = """
snr as (select media_id, case when quantile_cont(rms * rms, 0.25) > 0 then 10 * log10(quantile_cont(rms * rms, 0.75) / quantile_cont(rms * rms, 0.25)) else 60 end as snr_db from frames group by 1)"""
CROSS_ONLY = f"""{SCENES_AT}, {ALIGN_ONLY}, {ELEMENTS},
ca as (select media_id, avg(confidence) as confidence from conf group by 1), app as (select media_id % 20 as media_id, count(*) as a from visual where kind = 'appearance' group by 1), cn as (select media_id, language, sdh, count(*) as n from cues group by all),
crossed as (select media_id, language, sdh, coalesce(aligned / changes, 0) as alignment, confidence, (confidence + coalesce(a, 0) / greatest(coalesce(n, 0), 1)) / 2 as multimodal from ca left join aligned using (media_id) left join app using (media_id) left join cn using (media_id))"""
BREAKS = """
breaks as (select media_id, 'start' as side, start_ms as at, end_ms as tt, confidence from {p} union all select media_id, 'end', end_ms, start_ms, confidence from {p} union all select media_id, s, t_ms, t_ms, null from minima, (values ('start'), ('end')) v(s))"""
RETIME = X.CUES + "," + PAUSES + "," + MINIMA_ONLY + "," + BREAKS.format(p="(select * from pauses where confidence > 0.7)") + r""",
rc as (select *, len(list_filter(regexp_split_to_array(text, '[\p{Z}\s]+'), lambda x: x <> '')) as words, length(trim(text)) as chars from cues),
rh as (select *, (greatest(words * 300.0::double, chars * 50.0::double, 1000.0::double) - (end_ms - start_ms)) / 2 as half from rc),
ed as (select media_id, language, sdh, seq, side, case side when 'start' then start_ms - half else end_ms + half end as t from rh, (values ('start'), ('end')) v(side) where abs(half) > 100),
sn as (select e.*, b.tt from ed e left join breaks b on b.media_id = e.media_id and b.side = e.side and abs(b.at - e.t) < 500
  qualify row_number() over (partition by e.media_id, e.language, e.sdh, e.seq, e.side order by b.at is null, b.confidence is null, case when b.confidence is not null then -b.confidence else abs(b.at - e.t) end, b.at, b.tt) = 1),
pk as (select media_id, language, sdh, seq, max(case when side = 'start' then coalesce(tt::double, greatest(0, t)) end) as s, max(case when side = 'end' then coalesce(tt::double, t) end) as e from sn group by all),
ne as (select h.*, coalesce(s, h.start_ms) as new_start_ms, coalesce(e, h.end_ms) as e from rh h left join pk using (media_id, language, sdh, seq)),
retimed as (select *, case when e - new_start_ms < 1000 then new_start_ms + 1000 else e end as new_end_ms from ne)"""
#: Farthest-first starts and Lloyd's steps for all media and numbers of clusters.
KMEANS = X.SEGMENTS.replace("\nsegments as", "segments as", 1) + """,
pts as (select media_id, start_ms, features as v, count(*) over (partition by media_id) as n from segments),
far as (select media_id, start_ms, v, n, 'infinity'::double as d, 0 as step, first_value(v) over (partition by media_id order by start_ms) as c from pts
  union all select media_id, start_ms, v, n, e, step + 1, first_value(v) over (partition by media_id order by e desc, start_ms) from (select *, least(d, pow(list_distance(v, c), 2)) as e from far where step < 5)),
lloyd as (select distinct f.media_id, k, step as c, f.c as v, 0 as it from far f, unnest(range(2, 7)) u(k) where k <= greatest(2, least(6, n // 2)) and step < k
  union all select media_id, k, c, list(m order by i), it + 1 from (select media_id, k, c, it, i, avg(v[i]) as m from (
    select p.media_id, k, p.start_ms, it, any_value(p.v) as v, arg_min(l.c, list_distance(p.v, l.v)) as c from pts p join lloyd l on l.media_id = p.media_id where it < 30 group by all), unnest(range(1, 65)) u(i) group by all) group by all),
put as (select p.media_id, k, p.start_ms, arg_min(l.c, list_distance(p.v, l.v)) as c, min(pow(list_distance(p.v, l.v), 2)) as d from pts p join lloyd l on l.media_id = p.media_id and it = 30 group by all),
costs as (select media_id, k, sum(d) as cost from put group by all),
drops as (select *, cost - lag(cost) over (partition by media_id order by k) as drop, max(k) over (partition by media_id) as top from costs),
best as (select media_id, case when max(top) = 2 then 2 else least(arg_max(k, drop), max(top)) end as k from drops group by 1)"""
QUERIES = {
    "cue_event_align": (cue_event_align, f"""with {X.CUES}, {X.VISUAL} select c.media_id, c.language, c.sdh, c.seq, (count(*) filter (kind = 'scene'))::int as scenes, (count(*) filter (kind = 'appearance'))::int as appearances, (count(*) filter (kind = 'motion'))::int as motions, min(t_ms) filter (kind = 'scene') as first_scene
        from cues c left join visual v on v.media_id = c.media_id and v.t_ms between c.start_ms and c.end_ms group by all"""),
    "change_alignment": (change_alignment, f"with {CHANGES}, {X.VISUAL}, {SCENES_AT}, {ALIGN_ONLY} select media_id, changes, aligned, round(aligned / changes, 6) as share from aligned"),
    "nearest_break": (nearest_break, f"""with {X.CUES}, {PAUSES}, {MINIMA_ONLY}, {BREAKS.format(p='pauses')}, j as (select c.media_id, c.language, c.sdh, c.seq, c.start_ms as t_ms, b.tt, b.at as ba, b.confidence from cues c left join breaks b on b.media_id = c.media_id and b.side = 'start' and abs(b.at - c.start_ms) < 500)
        select media_id, language, sdh, seq, t_ms, tt as snap_ms, case when ba is null then null else confidence is not null end as is_pause from j qualify row_number() over (partition by media_id, language, sdh, seq order by ba is null, confidence is null, case when confidence is not null then -confidence else abs(ba - t_ms) end, ba, tt) = 1"""),
    "cue_frame_join": (cue_frame_join, f"with {X.CUES}, {X.FRAMES} select c.media_id, c.language, c.sdh, c.seq, count(*) as frames, min(t_ms) as first_ms, max(t_ms) as last_ms, round(sum(rms), 6) as rms from cues c join frames f on f.media_id = c.media_id and t_ms >= start_ms and t_ms < end_ms group by all"),
    "speech_activity": (speech_activity, f"with {ACTIVITY} select media_id, language, sdh, seq, words, frames, active_ms, round(active_ms / (end_ms - start_ms), 6) as activity_ratio from activity"),
    "speech_rate": (speech_rate, f"""with {ACTIVITY}, w as (select *, words * 60000.0::double / active_ms as wpm from activity where active_ms > 0), au as (select media_id, max(t_ms) + 200 as audio_ms from frames group by 1)
        select media_id, language, sdh, round(avg(wpm), 6) as mean_wpm, round(stddev_pop(wpm), 6) as std_wpm, round(median(wpm), 6) as median_wpm, round(min(wpm), 6) as min_wpm, round(max(wpm), 6) as max_wpm, count(*) filter (wpm > 200) as too_fast, count(*) filter (wpm < 80) as too_slow,
        round(sum(active_ms) / any_value(audio_ms), 6) as speaking_ratio from w join au using (media_id) group by all"""),
    "detect_pauses": (detect_pauses, f"with {PAUSES} select media_id, start_ms, end_ms, duration_ms, round(energy, 6) as energy, kind, confidence from pauses"),
    "pause_stats": (pause_stats, f"""with {PAUSES} select media_id, count(*) as pauses, round(avg(duration_ms), 6) as mean_ms, median(duration_ms)::double as median_ms, round(stddev_pop(duration_ms), 6) as std_ms, min(duration_ms) as min_ms, max(duration_ms) as max_ms,
        {", ".join(f"count(*) filter (kind = '{k}') as {k}" for k in ("short_pause", "natural_break", "speech_pause", "sentence_break", "long_silence"))} from pauses group by 1"""),
    "segmentation_points": (segmentation_points, f"""with {PAUSES}, s as (select media_id, start_ms, confidence + 0.05::double as confidence, kind, duration_ms from pauses) select media_id, start_ms + duration_ms / 2 as break_ms, confidence, kind, duration_ms,
        row_number() over (partition by media_id order by confidence desc, start_ms)::int as place from s where confidence > 0.8 and duration_ms > 500"""),
    "energy_profile": (energy_profile, f"""with {X.FRAMES} select media_id, round(avg(rms), 6) as mean_rms, round(stddev_pop(rms), 6) as std_rms, round(max(rms) - min(rms) filter (rms > 0), 6) as dynamic_range, round(stddev_pop(centroid), 6) as spectral_complexity,
        round(1 / (1 + stddev_pop(zcr)), 6) as temporal_stability, round(case when avg(rms) > 0 then stddev_pop(rms) / avg(rms) else 0 end, 6) as variability from frames group by 1"""),
    "energy_minima": (energy_minima, f"with {MINIMA} select media_id, t_ms, round(rms, 6) as rms from minima"),
    "energy_segments": (energy_segments, f"""with {X.FRAMES}, p as (select media_id, quantile_cont(rms, 0.6) as p from frames group by 1), f as (select f.*, rms > p as q, lead(t_ms) over w as nxt, row_number() over w as i from frames f join p using (media_id) window w as (partition by media_id order by t_ms)),
        g as (select *, i - row_number() over (partition by media_id order by t_ms) as g from f where q)
        select media_id, min(t_ms) as start_ms, max(nxt) as end_ms, max(nxt) - min(t_ms) as duration_ms from g group by media_id, g having count(nxt) = count(*) and max(nxt) - min(t_ms) > 1000"""),
    "retime_cues": (retime_cues, f"with {RETIME} select media_id, language, sdh, seq, round(new_start_ms, 6)::double as new_start_ms, round(new_end_ms, 6)::double as new_end_ms from retimed"),
    "retime_report": (retime_report, f"""with {RETIME}, x as (select *, (new_end_ms - new_start_ms - (end_ms - start_ms)) / 1000 as change, words * 60000.0::double / (new_end_ms - new_start_ms) as wpm, chars * 1000.0::double / (new_end_ms - new_start_ms) as cps, case when end_ms > start_ms then words * 60000.0::double / (end_ms - start_ms) end as old from retimed)
        select media_id, language, sdh, count(*) as cues, count(*) filter (change > 0.5) as extended, count(*) filter (change < -0.5) as shortened, count(*) filter (abs(change) > 0.2) as changed, round(avg(wpm) - avg(old), 6) as speed_gain, round(stddev_pop(old) - stddev_pop(wpm), 6) as evenness_gain,
        round(avg(greatest(0, 1 - case when wpm > 200 or wpm < 100 then 0.2 else 0 end - case when cps > 25 or cps < 10 then 0.2 else 0 end + case when wpm between 120 and 180 then 0.1 else 0 end + case when cps between 15 and 20 then 0.1 else 0 end)), 6)::double as timing_score from x group by all"""),
    "speaker_cluster": (speaker_cluster, f"with recursive {KMEANS} select media_id, start_ms, c as speaker_id from put join best using (media_id, k)"),
    "sketch_percentiles": (sketch_percentiles, f"with {X.FRAMES} select media_id, count(*) as frames, true as within from frames group by 1"),
    "speaker_profiles": (speaker_profiles, f"""with {X.SEGMENTS}, {ELEMENTS} select s.media_id, s.speaker_id, sum(end_ms - start_ms)::bigint as total_ms, count(*) as segments, round(avg(features[1]), 6) as mean_pitch, round(var_pop(features[1]), 6) as var_pitch, round(avg(features[2]), 6) as mean_energy,
        round(avg(features[3]), 6) as mean_centroid, round(avg(features[4]), 6) as mean_rolloff, round(list_sum(any_value(centre)[5:17]), 6) as mfcc_sum from segments s join centres using (media_id, speaker_id) group by 1, 2"""),
    "speaker_confidence": (speaker_confidence, f"with {X.SEGMENTS}, {ELEMENTS} select media_id, round(avg(confidence), 6) as confidence, round(min(confidence), 6) as least from conf group by 1"),
    "speaker_changes": (speaker_changes, f"with {CHANGES} select media_id, t_ms, from_speaker, to_speaker from changes"),
    "scene_changes": (scene_changes, f"with {SCENE_SQL} select media_id, t_ms, round(correlation, 6) as correlation from scene_changes"),
    "scene_stats": (scene_stats, f"with {SCENE_SQL} select media_id, scenes, round(mean_scene_s, 6) as mean_scene_s, round(per_second, 6) as per_second from scene_stats"),
    "dominant_face_timeline": (dominant_faces, f"""with {X.FACES}, k as (select *, w * h as area, count(*) over (partition by media_id, t_ms) as faces from faces qualify row_number() over (partition by media_id, t_ms order by w * h desc, face_id) = 1)
        select media_id, t_ms, face_id, area, round(least(1.0, area / 10000) * greatest(0.1, 1 - sqrt(pow(floor(x + w / 2) - 320, 2) + pow(floor(y + h / 2) - 240, 2)) / 400), 6)::double as confidence, faces from k"""),
    "snr_quality": (snr_quality, f"with {X.FRAMES}, {SNR} select media_id, round(snr_db, 6) as snr_db, case when snr_db > 20 then 'excellent' when snr_db > 15 then 'good' when snr_db > 10 then 'fair' else 'poor' end as quality from snr"),
    "cross_modal": (cross_modal, f"with {X.CUES}, {CHANGES}, {X.VISUAL}, {CROSS_ONLY} select media_id, language, sdh, round(alignment, 6) as alignment, round(confidence, 6) as confidence, round(multimodal, 6) as multimodal from crossed"),
    "media_recommendations": (media_recommendations, f"""with {X.CUES}, {SCENE_SQL}, {CHANGES[len(X.SEGMENTS) + 1:]}, {X.VISUAL}, {CROSS_ONLY}, {X.FRAMES}, {SNR},
        j as (select media_id, language, sdh, snr_db, coalesce(confidence, 0) as confidence, coalesce(multimodal, 0) as multimodal, scenes, mean_scene_s from snr left join crossed using (media_id) left join scene_stats using (media_id))
        select media_id, language, sdh, coalesce(array_to_string(list_filter([case when snr_db < 15 then 'high: low audio quality' end, case when confidence < 0.7 then 'medium: low speaker confidence' end, case when coalesce(scenes, 0) > 0 and mean_scene_s < 5 then 'low: frequent scene changes' end, case when multimodal > 0.8 then 'info: consistent' end], lambda x: x is not null), '; '), '') as findings from j"""),
}
