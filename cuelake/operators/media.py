"""Audio frames, speakers and scenes: alignment with cues, pauses, energy, retiming, speaker and scene statistics. Frame times
are whole milliseconds ``HOP_MS`` apart; feature tables are inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.dims import FILE_KEYS
from cuelake.functions.joins import band, interval_join
from cuelake.functions.scratch import dropped, stored
from cuelake.functions.text import is_blank, listed, words

HOP_MS = 200


def align_events(cues: DataFrame, events: DataFrame, keys: tuple[str, ...] = FILE_KEYS) -> DataFrame:
    """Visual events during each cue (both ends included), times listed by kind; cues without events stay."""
    found = interval_join(cues.select(*keys, "seq", "start_ms", "end_ms"), events, how="left")
    times = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("t_ms")))).alias(f"{kind}s")
    return found.groupBy(*keys, "seq").agg(*[times(k) for k in ("scene", "appearance", "motion")])


def change_alignment(changes: DataFrame, scenes: DataFrame, reach_ms: int = 2000) -> DataFrame:
    """Per media, the share of speaker changes with a scene change less than ``reach_ms`` away."""
    a = changes.select("media_id", "t_ms").withColumn("_b", F.explode(band(F.col("t_ms"), reach_ms))).alias("a")
    b = scenes.select("media_id", "t_ms").withColumn("_b", F.floor(F.col("t_ms") / reach_ms)).alias("b")
    near = a.join(b, (F.col("a.media_id") == F.col("b.media_id")) & (F.col("a._b") == F.col("b._b")) & (F.abs(F.col("a.t_ms") - F.col("b.t_ms")) < reach_ms), "left_semi")
    hit = near.select("media_id", "t_ms").distinct().withColumn("_h", F.lit(1))
    return changes.join(hit, ["media_id", "t_ms"], "left").groupBy("media_id").agg(F.count("*").alias("changes"), F.count("_h").alias("aligned")).withColumn("share", F.col("aligned") / F.col("changes"))


def cue_frames(cues: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames from the start of each cue to just before its end."""
    return interval_join(cues, frames, closed=False)


def breaks(pauses: DataFrame, minima: DataFrame) -> DataFrame:
    """(media_id, side, at, to, confidence): where edges can snap to: the same side of a pause, giving its other side, or an energy minimum
    (confidence null)."""
    both = pauses.select("media_id", "start_ms", "end_ms", "confidence").unionByName(minima.select("media_id", F.col("t_ms").alias("start_ms"), F.col("t_ms").alias("end_ms"), F.lit(None).cast("double").alias("confidence")))
    return _sides(both)


def _sides(spans: DataFrame) -> DataFrame:
    side = lambda name, at, to: F.struct(F.lit(name).alias("side"), F.col(at).alias("at"), F.col(to).alias("to"))
    return spans.select("media_id", "confidence", F.explode(F.array(side("start", "start_ms", "end_ms"), side("end", "end_ms", "start_ms"))).alias("s")).select("media_id", "s.side", "s.at", "s.to", "confidence")


def snapped(edges: DataFrame, places: DataFrame, keys: list[str], reach_ms: int = 500) -> DataFrame:
    """For each row of keys of edges (media_id, side, t_ms, and more), one ``start`` and one ``end``, each (kind, d, at, to): the break that its
    edges of that side snap to. Of the pauses within reach the one with the highest confidence (then the earliest; kind 0), else the
    nearest energy minimum (then the earliest; kind 1), else null. Edges meet the breaks once, in buckets of time."""
    b = places.withColumn("_b", F.floor(F.col("at") / reach_ms)).alias("b")
    a = edges.withColumn("_b", F.explode_outer(band(F.col("t_ms"), reach_ms))).alias("a")
    near = (F.col("a.media_id") == F.col("b.media_id")) & (F.col("a.side") == F.col("b.side")) & (F.col("a._b") == F.col("b._b")) & (F.abs(F.col("b.at") - F.col("a.t_ms")) < reach_ms)
    met = a.join(b, near, "left").select("a.*", "b.at", "b.to", "b.confidence")
    pause = F.col("confidence").isNotNull()
    order = F.struct(F.when(pause, 0).otherwise(1).alias("kind"), F.when(pause, -F.col("confidence")).otherwise(F.abs(F.col("at") - F.col("t_ms"))).alias("d"), "at", "to")
    best = lambda side: F.min(F.when((F.col("side") == side) & F.col("at").isNotNull(), order)).alias(side)
    return met.groupBy(*keys).agg(best("start"), best("end"))


def nearest_break(edges: DataFrame, places: DataFrame, reach_ms: int = 500) -> DataFrame:
    """Each edge (media_id, edge_id, side, t_ms) with the break of its side to snap to (see ``snapped``): snap_ms and is_pause, null if there
    is none."""
    found = snapped(edges, places, ["media_id", "edge_id", "side", "t_ms"], reach_ms)
    own = F.when(F.col("side") == "start", F.col("start")).otherwise(F.col("end"))
    return found.select("media_id", "edge_id", "side", "t_ms", own.to.alias("snap_ms"), (own.kind == 0).alias("is_pause"))


def speech_activity(cues: DataFrame, frames: DataFrame, keys: tuple[str, ...] = FILE_KEYS) -> DataFrame:
    """Active speech within each cue: frames louder than the 30th percentile of the cue's sounding frames, with moderate zero crossings
    and enough high frequencies. The frames of a cue meet once."""
    inside = cue_frames(cues.select(*keys, "seq", "start_ms", "end_ms", "text"), frames)
    per = inside.groupBy(*keys, "seq", "start_ms", "end_ms", "text").agg(
        F.coalesce(F.percentile(F.when(F.col("rms") > 0, F.col("rms")), 0.3), F.lit(0.0)).alias("_r"), F.avg("zcr").alias("_z"), F.avg("centroid").alias("_c"), F.collect_list(F.struct("rms", "zcr", "centroid")).alias("_f"), F.count("*").alias("frames"))
    # Compared to nine decimals, so that means summed in any order decide alike.
    over = lambda a, b: F.round(a - b, 9) > 0
    active = F.size(F.filter("_f", lambda x: over(x.rms, F.col("_r")) & over(x.zcr, F.col("_z") * 0.5) & over(F.col("_z") * 2.0, x.zcr) & over(x.centroid, F.col("_c") * 0.3)))
    ms = active.cast("long") * HOP_MS
    return per.select(*keys, "seq", "start_ms", "end_ms", F.size(words("text")).alias("words"), "frames", ms.alias("active_ms"), F.when(F.col("end_ms") > F.col("start_ms"), ms / (F.col("end_ms") - F.col("start_ms"))).otherwise(0.0).alias("activity_ratio"))


def speech_rate(activity: DataFrame, frames: DataFrame, keys: tuple[str, ...] = FILE_KEYS) -> DataFrame:
    """Words a minute of active speech: per file mean, deviation, median, range, cues over 200 and under 80, and the share of the audio
    that is speech."""
    rate = activity.where("active_ms > 0").withColumn("wpm", F.col("words") * 60000.0 / F.col("active_ms"))
    audio = frames.groupBy("media_id").agg((F.max("t_ms") + HOP_MS).alias("audio_ms"))
    s = rate.groupBy(*keys).agg(F.avg("wpm").alias("mean_wpm"), F.stddev_pop("wpm").alias("std_wpm"), F.median("wpm").alias("median_wpm"), F.min("wpm").alias("min_wpm"), F.max("wpm").alias("max_wpm"), F.count(F.when(F.col("wpm") > 200, 1)).alias("too_fast"), F.count(F.when(F.col("wpm") < 80, 1)).alias("too_slow"), F.sum("active_ms").alias("active_ms"))
    return s.join(audio, "media_id").withColumn("speaking_ratio", F.col("active_ms") / F.col("audio_ms"))


def _runs(frames: DataFrame, inside: Column, least_ms: int, strict: bool) -> DataFrame:
    """Runs of frames for which ``inside`` holds, from their first frame to the first one after; a run at the end of the media is
    not closed and not given."""
    w = Window.partitionBy("media_id").orderBy("t_ms")
    x = frames.withColumn("_in", inside).withColumn("_next", F.lead("t_ms").over(w)).withColumn("_i", F.row_number().over(w))
    x = x.where("_in").withColumn("_g", F.col("_i") - F.row_number().over(w))
    runs = x.groupBy("media_id", "_g").agg(F.min("t_ms").alias("start_ms"), F.max("_next").alias("end_ms"), F.count("_next").alias("_n"), F.count("*").alias("_k"), F.avg("rms").alias("energy")).where("_n = _k")
    d = F.col("end_ms") - F.col("start_ms")
    return runs.withColumn("duration_ms", d).where(d > least_ms if strict else d >= least_ms).drop("_g", "_n", "_k")


def percentiles(frames: DataFrame, value: Column, p: list[float], accuracy: int | None = None, keys: tuple[str, ...] = ("media_id",)) -> DataFrame:
    """The keys and ``q``, the percentiles of a value: exact, or with ``accuracy`` from sketches that are merged (a rank error of at
    most 1 / accuracy of the rows, in memory that does not grow with them). Partial results come before the shuffle."""
    q = F.percentile(value, p) if accuracy is None else F.percentile_approx(value, p, accuracy).cast("array<double>")
    return frames.groupBy(*keys).agg(q.alias("q"))


def _with_percentile(frames: DataFrame, p: float, sounding: bool, accuracy: int | None = None) -> DataFrame:
    """Adds _p. By default exact, in a window that holds a medium's frames; with ``accuracy`` by sketches."""
    value = F.when(F.col("rms") > 0, F.col("rms")) if sounding else F.col("rms")
    if accuracy is None:
        return frames.withColumn("_p", F.percentile(value, p).over(Window.partitionBy("media_id")))
    return frames.join(percentiles(frames, value, [p], accuracy).select("media_id", F.col("q")[0].alias("_p")), "media_id", "left")


def _pause_confidence() -> Column:
    d, e = F.col("duration_ms"), F.col("energy")
    return F.least(F.lit(100), F.lit(50) + F.when(d.between(300, 2000), 30).when(d > 2000, 10).otherwise(0) + F.when(e < 0.01, 20).when(e < 0.05, 10).otherwise(0)) / 100


def detect_pauses(frames: DataFrame, min_ms: int = 300, accuracy: int | None = None) -> DataFrame:
    """Runs below the 25th percentile of the sounding frames, with type and confidence. accuracy: see ``percentiles``."""
    runs = _runs(_with_percentile(frames, 0.25, True, accuracy), F.col("rms") < F.col("_p"), min_ms, False)
    d, e = F.col("duration_ms"), F.col("energy")
    kind = F.when(d < 500, "short_pause").when(d < 1000, F.when(e < 0.01, "natural_break").otherwise("speech_pause")).when(d < 2000, "sentence_break").otherwise("long_silence")
    return runs.withColumn("kind", kind).withColumn("confidence", _pause_confidence())


def pause_stats(pauses: DataFrame) -> DataFrame:
    d = F.col("duration_ms")
    kinds = ("short_pause", "natural_break", "speech_pause", "sentence_break", "long_silence")
    return pauses.groupBy("media_id").agg(F.count("*").alias("pauses"), F.avg(d).alias("mean_ms"), F.median(d).alias("median_ms"), F.stddev_pop(d).alias("std_ms"), F.min(d).alias("min_ms"), F.max(d).alias("max_ms"), *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds])


def good_pauses(pauses: DataFrame) -> DataFrame:
    return pauses.where("confidence > 0.7")


def segmentation_points(pauses: DataFrame) -> DataFrame:
    """Middles of sure and long pauses, the surest first within a media."""
    good = pauses.where("confidence > 0.8 and duration_ms > 500")
    place = F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("confidence"), "start_ms"))
    return good.select("media_id", (F.col("start_ms") + F.col("duration_ms") / 2).alias("break_ms"), "confidence", "kind", "duration_ms", place.alias("place"))


def energy_profile(frames: DataFrame) -> DataFrame:
    r = F.col("rms")
    s = frames.groupBy("media_id").agg(F.avg(r).alias("mean_rms"), F.stddev_pop(r).alias("std_rms"), (F.max(r) - F.min(F.when(r > 0, r))).alias("dynamic_range"), F.stddev_pop("centroid").alias("spectral_complexity"), (1 / (1 + F.stddev_pop("zcr"))).alias("temporal_stability"))
    return s.withColumn("variability", F.when(F.col("mean_rms") > 0, F.col("std_rms") / F.col("mean_rms")).otherwise(0.0))


def _lowest(order: int) -> Column:
    w = Window.partitionBy("media_id").orderBy("t_ms")
    low = F.lit(True)
    for k in range(1, order + 1):
        low = low & F.coalesce(F.col("rms") < F.lag("rms", k).over(w), F.lit(False)) & F.coalesce(F.col("rms") < F.lead("rms", k).over(w), F.lit(False))
    return low


def energy_minima(frames: DataFrame, order: int = 3, accuracy: int | None = None) -> DataFrame:
    """Frames quieter than their ``order`` neighbours on both sides (frames at the edges are none) and than the 25th percentile."""
    marked = frames.withColumn("_low", _lowest(order))
    return _with_percentile(marked, 0.25, False, accuracy).where("_low and rms < _p").select("media_id", "t_ms", "rms")


def energy_segments(frames: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Runs above the 60th percentile that last over a second."""
    return _runs(_with_percentile(frames, 0.6, False, accuracy), F.col("rms") > F.col("_p"), 1000, True)


def sound_breaks(frames: DataFrame, least_confidence: float = 0.7, min_ms: int = 300, order: int = 3) -> DataFrame:
    """``breaks`` of the good pauses and the energy minima of frames, in one pass: both percentiles, the runs and the neighbours come from
    windows over the same frames, and pauses and minima are groups of one aggregation there."""
    media, w = Window.partitionBy("media_id"), Window.partitionBy("media_id").orderBy("t_ms")
    r = F.col("rms")
    low = _lowest(order)
    x = frames.select("media_id", "t_ms", "rms", F.percentile(F.when(r > 0, r), 0.25).over(media).alias("_p"), F.percentile(r, 0.25).over(media).alias("_q"), F.lead("t_ms").over(w).alias("_next"), F.row_number().over(w).alias("_i"), low.alias("_low"))
    quiet = r < F.col("_p")
    x = x.withColumn("_g", F.col("_i") - F.count(F.when(quiet, 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kinds = F.array_compact(F.array(F.when(quiet, F.struct(F.lit(True).alias("pause"), F.col("_g").alias("g"))), F.when(F.col("_low") & (r < F.col("_q")), F.struct(F.lit(False).alias("pause"), F.col("_i").cast("long").alias("g")))))
    each = x.select("media_id", "t_ms", "rms", "_next", F.explode(kinds).alias("k")).groupBy("media_id", "k").agg(F.min("t_ms").alias("start_ms"), F.max("_next").alias("_end"), F.count("_next").alias("_n"), F.count("*").alias("_k"), F.avg("rms").alias("energy"))
    pause = F.col("k.pause")
    spans = each.withColumn("end_ms", F.when(pause, F.col("_end")).otherwise(F.col("start_ms"))).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    spans = spans.where(~pause | ((F.col("_n") == F.col("_k")) & (F.col("duration_ms") >= min_ms)))
    sure = F.when(pause, _pause_confidence())
    return _sides(spans.select("media_id", "start_ms", "end_ms", sure.alias("confidence")).where(F.col("confidence").isNull() | (F.col("confidence") > least_confidence)))


def retime_cues(cues: DataFrame, places: DataFrame, keys: tuple[str, ...] = FILE_KEYS) -> DataFrame:
    """New start and end of cues with text: as long as reading takes (200 words a minute, 20 characters a second, a second at least);
    the change is shared by both edges, which snap to ``breaks`` (or sound_breaks); the result lasts a second at least. Cues meet the
    breaks once; those that hardly change ask for none."""
    c = cues.where(~is_blank("text")).withColumn("words", F.size(words("text"))).withColumn("chars", F.char_length(F.trim("text")))
    target = F.greatest(F.col("words") * 300.0, F.col("chars") * 50.0, F.lit(1000.0))
    half = (target - (F.col("end_ms") - F.col("start_ms"))) / 2
    own = [*keys, "seq", "start_ms", "end_ms", "words", "chars"]
    c = c.select(*own, F.when(F.abs(half) > 100, half).alias("_half"))
    edge = lambda side, t: F.struct(F.lit(side).alias("side"), t.alias("t_ms"))
    both = F.explode(F.array(edge("start", F.col("start_ms") - F.col("_half")), edge("end", F.col("end_ms") + F.col("_half"))))
    out = snapped(c.select(*own, "_half", both.alias("e")).select(*own, "_half", "e.side", "e.t_ms"), places, [*own, "_half"])
    new_start = F.coalesce(F.col("start.to").cast("double"), F.greatest(F.lit(0.0), F.col("start_ms") - F.col("_half")), F.col("start_ms").cast("double"))
    new_end = F.coalesce(F.col("end.to").cast("double"), F.col("end_ms") + F.col("_half"), F.col("end_ms").cast("double"))
    out = out.select(*own, F.when(F.col("_half").isNull(), F.col("start_ms").cast("double")).otherwise(new_start).alias("new_start_ms"), new_end.alias("_e"))
    return out.withColumn("new_end_ms", F.when(F.col("_e") - F.col("new_start_ms") < 1000, F.col("new_start_ms") + 1000).otherwise(F.col("_e"))).drop("_e")


def explained(retimed: DataFrame) -> DataFrame:
    """Adds the change in seconds, words a minute, characters a second, score, kind of change and reason."""
    new = F.col("new_end_ms") - F.col("new_start_ms")
    r = retimed.withColumn("change_s", (new - (F.col("end_ms") - F.col("start_ms"))) / 1000).withColumn("wpm", F.col("words") * 60000.0 / new).withColumn("cps", F.col("chars") * 1000.0 / new)
    change, wpm, cps = F.col("change_s"), F.col("wpm"), F.col("cps")
    reason = F.when(change > 0.5, F.when(wpm > 200, "fast reading speed").when(cps > 20, "high character density").otherwise("better readability")).when(change < -0.5, F.when(wpm < 120, "slow reading speed").otherwise("improve pacing")).otherwise("minor adjustment")
    score = F.lit(1.0) - F.when((wpm > 200) | (wpm < 100), 0.2).otherwise(0.0) - F.when((cps > 25) | (cps < 10), 0.2).otherwise(0.0) + F.when(wpm.between(120, 180), 0.1).otherwise(0.0) + F.when(cps.between(15, 20), 0.1).otherwise(0.0)
    return r.withColumn("kind", F.when(change > 0.5, "extend").when(change < -0.5, "shorten").otherwise("keep")).withColumn("reason", reason).withColumn("score", F.greatest(F.lit(0.0), score))


def retime_report(retimed: DataFrame, keys: tuple[str, ...] = FILE_KEYS) -> DataFrame:
    """Per file: cues, extended, shortened, changed by over 0.2 s, gain in mean speed and evenness, and mean score."""
    r = explained(retimed)
    old = F.when(F.col("end_ms") > F.col("start_ms"), F.col("words") * 60000.0 / (F.col("end_ms") - F.col("start_ms")))
    return r.groupBy(*keys).agg(
        F.count("*").alias("cues"), F.count(F.when(F.col("kind") == "extend", 1)).alias("extended"), F.count(F.when(F.col("kind") == "shorten", 1)).alias("shortened"), F.count(F.when(F.abs("change_s") > 0.2, 1)).alias("changed"),
        (F.avg("wpm") - F.avg(old)).alias("speed_gain"), (F.stddev_pop(old) - F.stddev_pop("wpm")).alias("evenness_gain"), F.avg("score").alias("timing_score"))


def snr_quality(frames: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Ratio of the 75th to the 25th percentile of squared amplitude in decibels (60 if the latter is 0), and its band."""
    q = percentiles(frames, F.col("rms") * F.col("rms"), [0.25, 0.75], accuracy).withColumnRenamed("q", "_q")
    snr = F.when(F.col("_q")[0] > 0, 10 * F.log10(F.col("_q")[1] / F.col("_q")[0])).otherwise(60.0)
    return q.select("media_id", snr.alias("snr_db"), F.when(snr > 20, "excellent").when(snr > 15, "good").when(snr > 10, "fair").otherwise("poor").alias("quality"))


# ---- Speakers ----------------------------------------------------------------------------------------------------------------

def _square(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _starts(points: DataFrame, most: int) -> DataFrame:
    """(media_id, n, starts): up to ``most`` segments of each medium, the earliest and then always the one farthest from those before."""
    first = points.groupBy("media_id").agg(F.min(F.struct("start_ms", "features")).alias("_m"), F.count("*").alias("n"))
    chosen = stored(first.select("media_id", "n", F.array("_m.features").alias("starts")))
    for _ in range(1, most):
        away = F.array_min(F.transform("starts", lambda c: _square("features", c)))
        far = points.join(chosen, "media_id").groupBy("media_id").agg(F.max(F.struct(away.alias("d"), (-F.col("start_ms")).alias("t"), "features")).alias("_m"))
        more = F.when(F.col("_m.d") > 0, F.concat("starts", F.array("_m.features"))).otherwise(F.col("starts"))
        chosen, before = stored(chosen.join(far, "media_id").select("media_id", "n", more.alias("starts"))), chosen
        dropped(before)
    return chosen


def _nearest(centres: Column, k: Column) -> Column:
    """(d, c): squared distance and number of the nearest centre among those of k."""
    return F.array_min(F.transform(F.filter(centres, lambda x: x.k == k), lambda x: F.struct(_square("features", x.v).alias("d"), x.c.alias("c"))))


def speaker_cluster(segments: DataFrame, k: int | None = None, most: int = 6, rounds: int = 30) -> DataFrame:
    """Adds speaker_id by k-means over the feature vectors of each medium. Without k, 2 to ``most`` clusters (at most half of its segments)
    are tried, and the number after the smallest drop of the cost is taken.

    All media and all numbers of clusters take their steps together: a row for each medium holds its centres (a bounded number), the
    segments meet it, and the new centres are grouped means. Starts are fixed (see ``_starts``), so results do not depend on chance
    or partitions. A cluster that loses all its segments is left out. The steps end when no centre moves, or after ``rounds``."""
    points = segments.select("media_id", "start_ms", F.col("features").cast("array<double>").alias("features"))
    dims = points.agg(F.max(F.size("features"))).first()[0] or 0
    starts = _starts(points, k or most)
    ks = F.array(F.lit(k)) if k else F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.lit(most), F.floor(F.col("n") / 2).cast("int"))))
    each = F.flatten(F.transform("_ks", lambda n: F.transform(F.slice("starts", F.lit(1), n), lambda v, i: F.struct(n.alias("k"), i.alias("c"), v.alias("v")))))
    centres = stored(starts.withColumn("_ks", ks).select("media_id", "_ks", each.alias("centres")))
    dropped(starts)
    mean = F.array(*[F.avg(F.get("features", F.lit(i))) for i in range(dims)]).cast("array<double>")
    moved = lambda a, b: F.exists(F.zip_with(a, b, lambda x, y: (x.c != y.c) | F.exists(F.zip_with(x.v, y.v, lambda p, q: F.abs(p - q) > 1e-9 * (1 + F.abs(p))), lambda z: z)), lambda z: F.coalesce(z, F.lit(True)))
    for _ in range(rounds):
        put = points.join(centres, "media_id").select("media_id", "_ks", "features", F.explode("_ks").alias("k"), "centres")
        put = put.select("media_id", "_ks", "features", "k", _nearest(F.col("centres"), F.col("k")).c.alias("c"))
        means = put.groupBy("media_id", "_ks", "k", "c").agg(mean.alias("v"))
        new = means.groupBy("media_id", "_ks").agg(F.array_sort(F.collect_list(F.struct("k", "c", "v"))).alias("centres"))
        new, before = stored(new), centres
        still = new.join(before.select("media_id", F.col("centres").alias("_b")), "media_id").where((F.size("centres") != F.size("_b")) | moved("centres", "_b"))
        ended = still.isEmpty()
        dropped(before)
        centres = new
        if ended:
            break
    costs = points.join(centres, "media_id").select("media_id", "features", "centres", F.explode("_ks").alias("k")).groupBy("media_id", "k").agg(F.sum(_nearest(F.col("centres"), F.col("k")).d).alias("cost"))
    listed_ = costs.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("k", "cost"))).alias("_c"))
    drops = F.transform(F.sequence(F.lit(1), F.size("_c") - 1), lambda i: F.col("_c")[i].cost - F.col("_c")[i - 1].cost)
    place = F.when(F.size("_c") < 2, 0).otherwise(F.least(F.array_position(drops, F.array_max(drops)).cast("int"), F.size("_c") - 1))
    best = listed_.select("media_id", F.col("_c")[place].k.alias("_k"))
    final = centres.join(best, "media_id").select("media_id", F.filter("centres", lambda x: x.k == F.col("_k")).alias("_centres"), "_k")
    rows = segments.drop("speaker_id").join(final, "media_id")
    return rows.withColumn("speaker_id", _nearest(F.col("_centres"), F.col("_k")).c).drop("_centres", "_k")


def _means(segments: DataFrame) -> DataFrame:
    """Mean feature vector of each speaker."""
    each = segments.select("media_id", "speaker_id", F.posexplode("features").alias("i", "v")).groupBy("media_id", "speaker_id", "i").agg(F.avg("v").alias("m"))
    return each.groupBy("media_id", "speaker_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x.m).alias("centre"))


def speaker_profiles(segments: DataFrame) -> DataFrame:
    f = lambda k: F.col("features")[k]
    s = segments.groupBy("media_id", "speaker_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"), F.count("*").alias("segments"), F.avg(f(0)).alias("mean_pitch"), F.var_pop(f(0)).alias("var_pitch"), F.avg(f(1)).alias("mean_energy"), F.avg(f(2)).alias("mean_centroid"), F.avg(f(3)).alias("mean_rolloff"))
    return s.join(_means(segments).select("media_id", "speaker_id", F.slice("centre", 5, 13).alias("mfcc")), ["media_id", "speaker_id"])


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def speaker_confidence(segments: DataFrame) -> DataFrame:
    """Adds confidence: cosine of a segment to its speaker's mean, between 0 and 1."""
    c = segments.join(_means(segments), ["media_id", "speaker_id"])
    cosine = _dot("features", "centre") / F.sqrt(_dot("features", "features") * _dot("centre", "centre"))
    return c.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0))))).drop("centre")


def speaker_changes(segments: DataFrame) -> DataFrame:
    """Starts of segments whose speaker is not the one before, with the lower confidence of the two."""
    w = Window.partitionBy("media_id").orderBy("start_ms")
    conf = F.col("confidence") if "confidence" in segments.columns else F.lit(1.0)
    x = segments.select("media_id", F.col("start_ms").alias("t_ms"), F.lag("speaker_id").over(w).alias("from_speaker"), F.col("speaker_id").alias("to_speaker"), F.least(conf, F.lag(conf).over(w)).alias("confidence"))
    return x.where("from_speaker <> to_speaker")


# ---- Scenes ------------------------------------------------------------------------------------------------------------------

def scene_changes(frames: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Frames whose histogram has a correlation below the threshold with the one before."""
    w = Window.partitionBy("media_id").orderBy("t_ms")
    x = frames.withColumn("_p", F.lag("histogram").over(w)).where("_p is not null")
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)
    x = x.withColumn("_a", mean("_p")).withColumn("_m", mean("histogram"))
    x = x.withColumn("_x", F.transform("_p", lambda v: v - F.col("_a"))).withColumn("_y", F.transform("histogram", lambda v: v - F.col("_m")))
    r = _dot("_x", "_y") / F.sqrt(_dot("_x", "_x") * _dot("_y", "_y"))
    return x.select("media_id", "t_ms", r.alias("correlation")).where(F.col("correlation") < threshold)


def scene_stats(changes: DataFrame) -> DataFrame:
    """Scenes, mean time between changes, and changes a second up to the last."""
    w = Window.partitionBy("media_id").orderBy("t_ms")
    x = changes.withColumn("_d", F.lead("t_ms").over(w) - F.col("t_ms"))
    s = x.groupBy("media_id").agg(F.count("*").alias("scenes"), (F.coalesce(F.avg("_d"), F.lit(0.0)) / 1000).alias("mean_scene_s"), F.max("t_ms").alias("_last"))
    return s.withColumn("per_second", F.when(F.col("_last") > 0, F.col("scenes") * 1000 / F.col("_last")).otherwise(0.0)).drop("_last")


def dominant_faces(faces: DataFrame) -> DataFrame:
    """The largest face of each frame (then the first), its confidence by size and nearness to the centre, and the faces' number."""
    area = F.col("w") * F.col("h")
    best = faces.groupBy("media_id", "t_ms").agg(F.max(F.struct(area.alias("area"), (-F.col("face_id")).alias("n"), "x", "y", "w", "h")).alias("f"), F.count("*").alias("faces"))
    dx, dy = F.floor(F.col("f.x") + F.col("f.w") / 2) - 320, F.floor(F.col("f.y") + F.col("f.h") / 2) - 240
    confidence = F.least(F.lit(1.0), F.col("f.area") / 10000) * F.greatest(F.lit(0.1), 1 - F.sqrt(dx * dx + dy * dy) / 400)
    return best.select("media_id", "t_ms", (-F.col("f.n")).alias("face_id"), "f.area", confidence.alias("confidence"), "faces")


def cross_modal(segments: DataFrame, events: DataFrame, cues: DataFrame, keys: tuple[str, ...] = FILE_KEYS) -> DataFrame:
    """Per file of a medium (one row with null keys where it has none): share of speaker changes near a scene change, and mean of speaker confidence and appearances a cue."""
    s = speaker_confidence(segments)
    aligned = change_alignment(speaker_changes(s), events.where("kind = 'scene'")).select("media_id", F.col("share").alias("alignment"))
    conf = s.groupBy("media_id").agg(F.avg("confidence").alias("confidence"))
    seen = events.where("kind = 'appearance'").groupBy("media_id").agg(F.count("*").alias("_a"))
    n = cues.groupBy(*keys).agg(F.count("*").alias("_n"))
    x = conf.join(aligned, "media_id", "left").join(seen, "media_id", "left").join(n, "media_id", "left")
    visual = F.coalesce("_a", F.lit(0)) / F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1))
    return x.select(*keys, F.coalesce("alignment", F.lit(0.0)).alias("alignment"), "confidence", ((F.col("confidence") + visual) / 2).alias("multimodal"))


def media_recommendations(snr: DataFrame, cross: DataFrame, scenes: DataFrame, keys: tuple[str, ...] = FILE_KEYS) -> DataFrame:
    """Findings of each file by priority. Media come from the sound table; parts that are missing count as 0, scenes as absent."""
    x = snr.join(cross, "media_id", "left").join(scenes, "media_id", "left").na.fill(0.0, ["confidence", "multimodal"])
    found = listed(
        (F.col("snr_db") < 15, "high: low audio quality"), (F.col("confidence") < 0.7, "medium: low speaker confidence"),
        ((F.coalesce(F.col("scenes"), F.lit(0)) > 0) & (F.col("mean_scene_s") < 5), "low: frequent scene changes"), (F.col("multimodal") > 0.8, "info: consistent"))
    return x.select(*keys, found.alias("findings"))
