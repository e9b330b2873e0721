"""Rules on Bengali, Hindi and English cues, user rules, fixes and reports."""

import pytest
from pyspark.sql import functions as F

from cuelake.operators import quality, rules, translation

SCHEMA = "media_id long, language string, sdh boolean, seq int, start_ms long, end_ms long, text string"


def cues(spark, language, *texts):
    return spark.createDataFrame([(1, language, False, i + 1, i * 4000, i * 4000 + 3000, t) for i, t in enumerate(texts)], SCHEMA)


def fired(df, group):
    return sorted((r["rule_id"], r["seq"] or 0) for r in rules.validate(df, rules.GROUPS[group]()).collect())


def test_bengali(spark):
    df = cues(spark, "ben", "আমি ভালো আছি।", "আমি English বলি।", "আমি ভালো আছি", "প্রথম। দ্বিতীয়। তৃতীয়।", "শেষ্ হল।")
    assert fired(df, "script") == [("R10", 2)] * 7 + [("R11", 2), ("R12", 2)]
    assert fired(df, "language") == [("R13", 4), ("R13", 4), ("R18", 5), ("R19", 3)]


def test_hindi(spark):
    df = cues(spark, "hin", "मैं ठीक हूँ।", "मैं ठीक हूँ", "अर्थ् है।")
    assert fired(df, "script") == [] and fired(df, "language") == [("R20", 3), ("R21", 2)]


def test_english(spark):
    df = cues(spark, "eng", "He said. then left.", "I cant  go", "Trailing ", "Fine. OK!", "Price €5")
    assert fired(df, "language") == [("R14", 1), ("R15", 2), ("R16", 2), ("R17", 3)]
    assert fired(df, "script") == [("R12", 5)]


def test_content_and_readability(spark):
    df = cues(spark, "eng", "[inaudible] ??? ...", "a\nb", "one two\nlonger line here", "x", "x", "x")
    assert fired(df, "content") == [("R27", 0), ("R28", 0)] + [("R29", 1)] * 3
    assert fired(df, "readability") == [("R30", 2), ("R31", 3)]


def test_user_rule_and_empty_file(spark):
    df = cues(spark, "eng", "Call 5551234.", "Fine.")
    mine = rules.rule("X1", rules.WARNING, "cue", F.col("text").rlike("[0-9]{7}"), F.regexp_extract("text", "[0-9]{7}", 0))
    got = [r for r in rules.validate(df, [mine]).collect()]
    assert [(r["rule_id"], r["seq"], r["detail"]) for r in got] == [("X1", 1, "5551234")]
    files = spark.createDataFrame([(1, "eng", False), (2, "eng", True)], "media_id long, language string, sdh boolean")
    assert [(r["media_id"], r["rule_id"]) for r in rules.empty_files(files, df).collect()] == [(2, "R00")]


def test_auto_fix_leaves_no_order_or_overlap_findings(spark):
    df = spark.createDataFrame([(1, "eng", False, 5, 0, 3000, "A."), (1, "eng", False, 9, 2000, 5000, "B."), (1, "eng", False, 2, 4000, 6000, "C.")], SCHEMA)
    fixed = rules.auto_fix(df)
    assert not {r for r, _ in fired(fixed, "format")} & {"R01", "R08"}


def test_clean_file_is_production_ready(spark):
    r = rules.report(cues(spark, "eng", "This is a fully normal sentence, that reads well.".replace(", ", ",\n"), "Another sentence is here and it is also,\nvery easy.")).first()
    assert r["errors"] == 0 and r["status"] in ("PRODUCTION_READY", "MINOR_ISSUES") and r["production_ready"]


def test_source_language(spark):
    f = spark.createDataFrame([(1, "a_ben_b.mp4", "x"), (2, None, "আমি ভালো আছি"), (3, None, "plain words"), (4, None, ""), (5, None, "আমি abc ভালো xyz আছি")], "media_id long, path string, text string")
    assert [r["source_language"] for r in rules.infer_source_language(f).orderBy("media_id").collect()] == ["ben", "eng", "ben", None, None]


@pytest.mark.parametrize("hyp,ref,want", [("the cat sat on the mat", "the cat sat on the mat", 1.0), ("a b c d", "w x y z", 0.0), ("", "a b c d", 0.0)])
def test_bleu(spark, hyp, ref, want):
    pairs = spark.createDataFrame([(1, "en", "en", ref, hyp)], "media_id long, src_lang string, tgt_lang string, ref string, hyp string")
    assert translation.bleu(pairs).first()["bleu"] == pytest.approx(want)


def test_cultural_profiles(spark):
    rows = [(1, "en", "bn", "Hello 5", "নমস্কার আপনি 5"), (2, "en", "hi", "Hello", "नमस्ते आप"), (3, "en", "fr", "Hello 5", "Bonjour")]
    pairs = spark.createDataFrame(rows, "media_id long, src_lang string, tgt_lang string, ref string, hyp string")
    got = {r["media_id"]: r["c"] for r in pairs.select("media_id", translation.cultural_accuracy(profile="language").alias("c")).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == pytest.approx(1.0) and got[3] == pytest.approx(0.7)


def test_scores_stay_in_range(spark, sf):
    from cuelake.plans import fixtures

    m = quality.basic_score(quality.quality_score(quality.cue_metrics(fixtures.cues(spark, sf))))
    assert m.where("score < 0 or score > 100 or basic_score < 0 or basic_score > 1.11").count() == 0
