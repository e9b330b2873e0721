"""Media with several files: regular and SDH, several languages, several target languages; and what is computed on them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuelake.functions.joins import FACTOR, interval_join, widths
from cuelake.operators import media, merge, ops, quality, rules, translation

CUES = "media_id long, language string, sdh boolean, seq int, start_ms long, end_ms long, text string"
#: A regular and an SDH file of one medium, of two cues each.
TWO = [(1, "eng", sdh, k + 1, k * 3000, k * 3000 + 2500, f"{'[noise] ' if sdh else ''}This is the full text number {k}.") for sdh in (False, True) for k in (0, 1)]


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame(TWO, CUES)


def test_rules_and_metrics_do_not_mix_variants(spark, two):
    assert not {r["rule_id"] for r in rules.validate(two).collect()} & {"R01", "R08"}
    got = {r["sdh"]: (r["cues"], r["overlapping"]) for r in quality.cue_metrics(two).collect()}
    assert got == {False: (2, 0), True: (2, 0)}
    assert {r["sdh"] for r in rules.report(two).collect()} == {False, True}
    assert [r["context"] for r in merge.context_window(two).where("seq = 2 and sdh").collect()] == [TWO[2][6]]


def test_events_and_retiming_are_by_file(spark, two):
    events = spark.createDataFrame([(1, "scene", 1000), (1, "scene", 4000)], "media_id long, kind string, t_ms long")
    assert sorted((r["sdh"], r["seq"], r["scenes"]) for r in media.align_events(two, events).collect()) == [(s, k, [1000 if k == 1 else 4000]) for s in (False, True) for k in (1, 2)]
    frames = spark.createDataFrame([(1, k * 200, 0.5 + (k * 7 % 11) / 50, 0.3, 500.0) for k in range(40)], "media_id long, t_ms long, rms double, zcr double, centroid double")
    places = media.breaks(media.good_pauses(media.detect_pauses(frames)), media.energy_minima(frames))
    assert sorted(map(tuple, places.collect()), key=repr) == sorted(map(tuple, media.sound_breaks(frames).select(places.columns).collect()), key=repr) and places.count() > 4
    both = {(r["sdh"], r["seq"]): (r["new_start_ms"], r["new_end_ms"]) for r in media.retime_cues(two, places).collect()}
    for sdh in (False, True):
        alone = {(r["sdh"], r["seq"]): (r["new_start_ms"], r["new_end_ms"]) for r in media.retime_cues(two.where(F.col("sdh") == sdh), places).collect()}
        assert alone == {k: v for k, v in both.items() if k[0] == sdh}
    assert media.speech_activity(two, frames).count() == 4


def test_missing_variants_are_missing(spark):
    units = spark.createDataFrame([(1, "eng", s, 0) for s in (False, True)], "media_id long, language string, sdh boolean, chunk_no int")
    files = units.where("not sdh")
    assert [r["sdh"] for r in merge.missing_units(units, files).collect()] == [True]
    assert {(r["language"], r["rate"]) for r in merge.delivery_rate(units, files).collect()} == {("eng", 0.5), (None, 0.5)}


def test_pairs_of_one_medium_are_scored_apart(spark):
    pairs = spark.createDataFrame([(1, "en", "hi", "a b c d e", "a b c d e"), (1, "en", "bn", "a b c d e", "v w x y z")], "media_id long, src_lang string, tgt_lang string, ref string, hyp string")
    assert {r["tgt_lang"]: r["bleu"] for r in translation.bleu(pairs).collect()} == {"hi": pytest.approx(1.0), "bn": 0.0}
    assert {r["tgt_lang"]: r["bleu"] for r in translation.scored(pairs).collect()} == {"hi": pytest.approx(1.0), "bn": 0.0}
    lexicon = spark.createDataFrame([("a", 1.0, 0.0)], "token string, polarity double, subjectivity double")
    assert {r["tgt_lang"]: r["polarity_b"] for r in quality.sentiment_preservation(pairs, lexicon).collect()} == {"hi": 1.0, "bn": 0.0}


def test_language_pairs_keep_variants_apart(spark, two):
    both = two.unionByName(two.withColumn("language", F.lit("hin")))
    got = {r["sdh"]: (r["ref"], r["hyp"]) for r in translation.pair_languages(both, "eng", "hin").collect()}
    text = lambda sdh: " ".join(r[6] for r in TWO if r[2] == sdh)
    assert got == {s: (text(s), text(s)) for s in (False, True)}


def test_reports_in_one_pass_are_those_of_the_findings(spark, sf):
    from cuelake.plans import fixtures

    c = fixtures.lined_cues(spark, sf)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(rules.report(c)) == rows(rules.validation_report(rules.validate(c), quality.cue_totals(c)))


def test_scores_need_no_shuffle(spark, sf):
    """Texts are scored on the row that holds both (the fixture deals documents once)."""
    from cuelake.plans import translation_queries

    for query in (translation_queries.bleu, translation_queries.translation_score):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "ENSURE_REQUIREMENTS" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_precisions_are_counted_by_hand(spark):
    dice = random.Random(5)
    text = lambda n, kinds: " ".join(dice.choice("abcdefgh"[:kinds]) for _ in range(n))
    rows = [(text(n, k), text(m, k)) for n in (1, 3, 9, 60, 400) for m in (1, 4, 50, 300) for k in (1, 2, 8)] + [("a b", ""), ("", "a b"), (None, "a"), ("a", None), (None, None), ("a a a a a", "a b a"), ("a b a", "a a a a a")]
    got = spark.createDataFrame(rows, "hyp string, ref string").select("hyp", "ref", translation.ngram_precisions().alias("g")).collect()
    assert len(got) == len(rows)
    for r in got:
        h, f = ((r[c] or "").split() for c in ("hyp", "ref"))
        assert (r["g"]["hyp_len"], r["g"]["ref_len"]) == (len(h), len(f))
        for n in range(1, 5):
            grams = [Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (h, f)]
            assert r["g"][f"p{n}"] == pytest.approx(sum((grams[0] & grams[1]).values()) / max(1, sum(grams[0].values())))


# ---- intervals of any length


@pytest.mark.parametrize("closed", [True, False])
def test_intervals_of_any_length(spark, closed):
    r = random.Random(7)
    top = (1 << 63) - 1
    spans = [(r.randrange(3), k, (s := r.randrange(-50_000, 10**7)), s + r.choice([0, 5, 4000, 64_000, 64_001, 10**6, 10**9, 10**15])) for k in range(150)]
    spans += [(0, 1000, 0, top), (1, 1001, -(1 << 62), 1 << 62), (2, 1002, 50, 10), (0, 1003, -top, top)]
    points = [(m, r.randrange(-60_000, 2 * 10**7)) for m in range(3) for _ in range(200)] + [(0, top), (0, 0), (1, -(1 << 62)), (2, 50)]
    a, b = spark.createDataFrame(spans, "media_id long, id long, start_ms long, end_ms long"), spark.createDataFrame(points, "media_id long, t_ms long")
    got = sorted((x["id"], x["t_ms"]) for x in interval_join(a, b, closed=closed).collect())
    assert got == sorted((i, t) for m, i, s, e in spans for n, t in points if m == n and s <= t and (t <= e if closed else t < e))
    left = interval_join(a, b.where("false"), closed=closed, how="left")
    assert {x["id"] for x in left.collect()} == {x[1] for x in spans} and left.count() <= len(spans) * (FACTOR + 1)
    assert widths(4000)[-1] * FACTOR > top - widths(4000)[-1]


# ---- percentiles, lists, rates, names


def test_sketches_keep_their_rank(spark):
    r = random.Random(1)
    frames = spark.createDataFrame([(m, k * 200, r.gauss(0, 1) ** 2, 0.1, 1.0) for m in (1, 2) for k in range(20_000)], "media_id long, t_ms long, rms double, zcr double, centroid double")
    values = {m: sorted(x["rms"] for x in frames.where(F.col("media_id") == m).select("rms").collect()) for m in (1, 2)}
    for row in media.percentiles(frames, F.col("rms"), [0.25, 0.6], 200).collect():
        for q, p in zip(row["q"], (0.25, 0.6)):
            assert abs(sum(v <= q for v in values[row["media_id"]]) - p * 20_000) <= 20_000 / 200 + 1
    exact, near = (media.snr_quality(frames, a).orderBy("media_id").collect() for a in (None, 10_000))
    assert all(abs(a["snr_db"] - b["snr_db"]) < 0.05 for a, b in zip(exact, near))
    few = frames.where("t_ms < 40000")
    for make in (media.detect_pauses, media.energy_minima, media.energy_segments):
        a, b = make(few).count(), make(few, accuracy=10_000).count()
        assert abs(a - b) <= 1 + a // 50


def test_confidence_lists_are_the_first_of_either_kind(spark):
    rows = [(1, "eng", False, k, k * 1000, k * 1000 + 900, "" if k % 3 == 0 else "This is fine.") for k in range(1, 400)] + [(2, "eng", False, 1, 0, 900, "one two three, and more")]
    df = spark.createDataFrame(rows, CUES)
    for block in (16, 4096):
        got = {r["media_id"]: r for r in quality.confidence_summary(df, block=block).collect()}
        assert got[1]["low_cues"] == ",".join(str(k) for k in range(3, 153, 3)) and got[1]["low"] == 133 and got[1]["high"] == 266
        assert got[1]["high_cues"] == ",".join(str(k) for k in range(1, 400) if k % 3)[: len(got[1]["high_cues"])] and got[1]["high_cues"].count(",") == 49
        assert got[2]["low_cues"] == ""


def test_call_rates_over_buckets(spark):
    r = random.Random(2)
    calls = [(r.choice("ab"), r.randrange(-200, 20_000)) for _ in range(3000)]
    df, quotas = spark.createDataFrame(calls, "service string, t_s long"), spark.createDataFrame([("a", 4)], "service string, quota int")
    got = sorted((x["service"], x["t_s"], x["recent"], x["over"], x["wait_s"]) for x in ops.call_rate(df, quotas, bucket_s=100).collect())
    want = []
    for s, t in calls:
        near = [u for v, u in calls if v == s and t - 60 < u <= t]
        over = s == "a" and len(near) > 4
        want.append((s, t, len(near), over, min(near) + 60 - t if over else 0))
    assert got == sorted(want)


def names_of(spark, paths, **more):
    df = spark.createDataFrame(list(enumerate(paths)), "media_id long, path string")
    return [r["name"] for r in merge.safe_output_name(df, **more).orderBy("media_id").collect()]


def test_output_names_are_unique(spark):
    assert names_of(spark, ["a.mp4", "a.mp4", "x/a~2.mp4", "a.mp4"]) == ["a.mp4", "a~3.mp4", "a~2.mp4", "a~4.mp4"]
    r = random.Random(3)
    stems = ["a", "b?", "b_", "a~2", "a~3", "a~5", "x" * 300, "x" * 299, "x" * 188 + "~2", "q" * 196, "q" * 195, "no", "no~2", "y." + "z" * 30, "y." + "z" * 30 + "~2", "~2", "a~02", "n\nm"]
    paths = [r.choice(stems) + r.choice([".mp4", ".mkv", "", ".tar.gz", ".~2"]) for _ in range(900)]
    names = names_of(spark, paths, bucket=50)
    assert len(set(names)) == len(paths) == len(names) and max(map(len, names)) <= 200
    for path, name in zip(paths, names):
        assert not path.endswith((".mp4", ".mkv", ".tar.gz")) or name.endswith(path[path.rindex(".") :])
    assert names_of(spark, paths) == names
