"""Cue quality: metrics, scores and reports for each file. Rows of one file meet once (one shuffle); all else is arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.dims import FILE_KEYS, PAIR_KEYS
from cuelake.functions.text import clip, is_blank, listed, tokens, words

KEYS = FILE_KEYS
#: Ranges of duration by their end.
RANGES = [(1000, "0-1s"), (3000, "1-3s"), (5000, "3-5s"), (10000, "5-10s")]
METRICS = ("cues", "words", "chars", "avg_words", "avg_chars", "avg_duration", "reading_speed", "timing_issues", "empty_cues", "overlapping")
#: Weights of the parts of the overall assessment.
WEIGHTS = {"bleu": 0.30, "confidence": 0.25, "sentiment": 0.15, "timing": 0.20, "text": 0.10}


def duration_ms() -> Column:
    return F.col("end_ms") - F.col("start_ms")


def _share(a, b) -> Column:
    """a / b, 0 for b = 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b > 0, a / b).otherwise(0.0)


def cue_metrics(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Counts, averages and issues of each file; speeds are characters a second."""
    before = F.lag("end_ms").over(Window.partitionBy(*keys).orderBy("seq"))
    d, n = duration_ms(), F.char_length("text")
    marked = df.withColumn("_before", before)
    total = marked.groupBy(*keys).agg(
        F.count("*").alias("cues"), F.sum(F.size(words("text"))).alias("words"), F.sum(n).alias("chars"), F.sum(d).alias("duration_ms"),
        F.count(F.when((d > 0) & (n * 1000 > 25 * d), 1)).alias("timing_issues"), F.count(F.when(is_blank("text"), 1)).alias("empty_cues"),
        F.count(F.when((F.col("_before") != 0) & (F.col("start_ms") < F.col("_before")), 1)).alias("overlapping"),
    )
    return total.withColumns({
        "avg_words": F.col("words") / F.col("cues"), "avg_chars": F.col("chars") / F.col("cues"),
        "avg_duration": F.col("duration_ms") / F.lit(1000.0) / F.col("cues"), "reading_speed": _share(F.col("chars") * 1000.0, "duration_ms"),
    })


def quality_score(m: DataFrame) -> DataFrame:
    """Adds the score from 0 to 100."""
    speed, w = F.col("reading_speed"), F.col("avg_words")
    rate = lambda c: F.col(c) / F.col("cues")
    s = F.lit(100.0) - F.when(speed > 25, 2 * (speed - 25)).when(speed < 10, 2 * (10 - speed)).otherwise(0.0) - 20 * rate("timing_issues") - 30 * rate("empty_cues") - 25 * rate("overlapping") - F.when(w > 20, w - 20).when(w < 5, 2 * (5 - w)).otherwise(0.0)
    return m.withColumn("score", F.when(F.col("cues") > 0, clip(s, 0.0, 100.0)).otherwise(0.0))


def basic_score(m: DataFrame) -> DataFrame:
    """Adds the score from 0 to 1.1 that stands in where no detailed one exists."""
    part = lambda c, v: F.when(F.col(c) > 0, v).otherwise(0.0)
    s = F.lit(1.0) - part("timing_issues", 0.2) - part("empty_cues", 0.1) - part("overlapping", 0.15) + F.when(F.col("reading_speed").between(15, 25), 0.1).otherwise(0.0)
    return m.withColumn("basic_score", F.greatest(F.lit(0.0), s))


def recommendations() -> Column:
    speed = F.col("reading_speed")
    return listed(
        (speed > 25, "split long subtitles"), (speed < 10, "combine short subtitles"), (F.col("timing_issues") > 0, "adjust durations"),
        (F.col("empty_cues") > 0, "remove or fill empty subtitles"), (F.col("overlapping") > 0, "remove overlaps"),
    )


def quality_report(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One report for each file: score, metrics, recommendations and a text."""
    m = quality_score(cue_metrics(df, keys)).withColumn("recommendations", recommendations())
    text = F.format_string("Score %.1f/100; %d cues, %d words, %.1f words a cue, %.1f characters a second, %.1f s a cue; %d timing issues, %d empty, %d overlapping", "score", "cues", "words", "avg_words", "reading_speed", "avg_duration", "timing_issues", "empty_cues", "overlapping")
    return m.withColumn("report", text)


def cue_confidence(df: DataFrame) -> DataFrame:
    """Adds confidence in hundredths, from the shape of the text."""
    w = words("text")
    n = F.size(w)
    upper, lower = F.col("text").rlike(r"\p{Lu}"), F.col("text").rlike(r"\p{Ll}")
    c = (
        F.lit(100) - F.when(F.col("text").rlike(r"[^\p{L}\p{N}_\p{Z}\s.,!?\-'\"()]"), 10).otherwise(0) - F.when(n < 2, 10).otherwise(0)
        - F.when(upper != lower, 5).otherwise(0) - F.when(10 * F.size(F.array_distinct(w)) < 7 * n, 10).otherwise(0)
        + F.when(F.col("text").rlike(r"[.!?][\p{Z}\s]*$"), 5).otherwise(0)
    )
    return df.withColumn("confidence", F.when(is_blank("text"), 0).otherwise(clip(c, 0, 100).cast("int")))


def duration_range() -> Column:
    d = duration_ms()
    out = F.when(d < RANGES[0][0], RANGES[0][1])
    for limit, name in RANGES[1:]:
        out = out.when(d < limit, name)
    return out.otherwise("10s+")


def confidence_summary(df: DataFrame, keys: tuple[str, ...] = KEYS, listed_most: int = 50, block: int = 4096) -> DataFrame:
    """Per file: mean, deviation and median (hundredths), counts by tenths, counts by duration range, and numbers of cues with low
    (under 60) and high (over 85) confidence, with the first ``listed_most`` of either by number.

    Cues are first counted by confidence and range within blocks of ``block`` numbers, where lists are cut, before the shuffle in part; files
    are made from those counts, so neither a list of all cues nor a very long file is one task."""
    conf, n = F.col("confidence"), F.col("_n")
    names = [name for _, name in RANGES] + ["10s+"]
    c = cue_confidence(df).select(*keys, "seq", "confidence", duration_range().alias("_range"), F.floor(F.col("seq") / block).alias("_block"))
    first = lambda a: F.slice(F.array_sort(a), 1, listed_most)
    counts = c.groupBy(*keys, "_block", "confidence", "_range").agg(F.count("*").alias("_n"), first(F.collect_list(F.when((conf < 60) | (conf > 85), F.col("seq")))).alias("_s"))
    some = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0))
    joined = lambda tests: F.concat_ws(",", *[some(t).cast("string") for t in tests])
    numbers = lambda test: F.array_join(first(F.flatten(F.collect_list(F.when(test, F.col("_s"))))).cast("array<string>"), ",")
    total, square, cues = F.sum(conf * n), F.sum(conf * conf * n), F.sum(n)
    return counts.groupBy(*keys).agg(
        (total / cues).alias("mean"), (F.sqrt(cues * square - total * total) / cues).alias("std"), F.percentile(conf, 0.5, n).alias("median"),
        joined([F.floor(conf / 10) == k for k in range(11)]).alias("histogram"), joined([F.col("_range") == name for name in names]).alias("by_duration"),
        some(conf < 60).alias("low"), some(conf > 85).alias("high"), numbers(conf < 60).alias("low_cues"), numbers(conf > 85).alias("high_cues"),
    )


def timing_quality(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """1 less hundredths for cues that are too fast, slow, short or long; 0 at least."""
    d, n = duration_ms(), F.char_length("text")
    cost = F.when(d > 0, F.when(n * 1000 > 25 * d, 5).when(n * 1000 < 5 * d, 3).otherwise(0)).otherwise(0) + F.when(d < 500, 2).when(d > 10000, 2).otherwise(0)
    return df.groupBy(*keys).agg((F.greatest(F.lit(0), 100 - F.sum(cost)) / 100).alias("timing_quality"))


def text_quality(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """1 less hundredths for blank cues, lower-case beginnings and missing final punctuation, and for very short or long cues."""
    t = F.regexp_replace("text", r"^[\p{Z}\s]+|[\p{Z}\s]+$", "")
    blank = is_blank("text")
    cost = F.when(blank, 5).otherwise(F.when(t.rlike(r"^\p{Ll}"), 1).otherwise(0) + F.when(~t.rlike(r"[.!?]$"), 1).otherwise(0))
    w = F.sum(F.size(words("text")))
    mean = w / F.count("*")
    return df.groupBy(*keys).agg((F.greatest(F.lit(0), 100 - F.sum(cost) - F.when((w > 0) & ((mean < 2) | (mean > 15)), 10).otherwise(0)) / 100).alias("text_quality"))


def overall_assessment(parts: DataFrame) -> DataFrame:
    """Weighted mean of the parts that are present (columns bleu, confidence, sentiment, timing, text; null: absent), grade, and
    recommendations."""
    have = {k: w for k, w in WEIGHTS.items() if k in parts.columns}
    total = sum((F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in have.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in have.items()), F.lit(0.0))
    overall = F.when(total > 0, value / total).otherwise(0.0)
    grade = F.when(overall >= 0.9, "Excellent").when(overall >= 0.8, "Good").when(overall >= 0.7, "Fair").when(overall >= 0.6, "Poor").otherwise("Very Poor")
    get = lambda k: F.col(k) if k in parts.columns else F.lit(None).cast("double")
    advice = listed((get("bleu") < 0.3, "low translation overlap"), (get("confidence") < 0.7, "low confidence"), (~get("preserved").cast("boolean"), "sentiment changed"), (get("timing") < 0.8, "timing needs improvement"))
    advice = F.when(F.size(advice) == 0, F.array(F.lit("meets production standards"))).otherwise(advice)
    return parts.withColumn("overall", overall).withColumn("grade", grade).withColumn("recommendations", advice)


def sentiment_preservation(pairs: DataFrame, lexicon: DataFrame, a: str = "ref", b: str = "hyp", keys: tuple[str, ...] = PAIR_KEYS) -> DataFrame:
    """Polarity and subjectivity of both texts of a pair (means over the words found in the lexicon), their differences, and whether the sentiment is preserved."""
    sides = F.explode(F.array(F.struct(F.lit("a").alias("side"), tokens(a).alias("w")), F.struct(F.lit("b").alias("side"), tokens(b).alias("w")))).alias("s")
    toks = pairs.select(*keys, sides).select(*keys, "s.side", F.explode("s.w").alias("token"))
    found = toks.join(lexicon, "token")
    mean = lambda c, side: F.coalesce(F.avg(F.when(F.col("side") == side, F.col(c))), F.lit(0.0))
    scores = found.groupBy(*keys).agg(*[mean(c, s).alias(f"{c}_{s}") for c in ("polarity", "subjectivity") for s in "ab"])
    full = pairs.select(*keys).join(scores, list(keys), "left").na.fill(0.0)
    kind = lambda c: F.when(F.col(c) > 0.1, "positive").when(F.col(c) < -0.1, "negative").otherwise("neutral")
    dp, ds = F.abs(F.col("polarity_a") - F.col("polarity_b")), F.abs(F.col("subjectivity_a") - F.col("subjectivity_b"))
    return full.withColumns({"class_a": kind("polarity_a"), "class_b": kind("polarity_b"), "polarity_diff": dp, "subjectivity_diff": ds, "preserved": (dp < 0.3) & (ds < 0.4) & (kind("polarity_a") == kind("polarity_b")), "score": 1 - (dp + ds) / 2})


def repetition(df: DataFrame, keys: tuple[str, ...] = KEYS, approximate: bool = False) -> DataFrame:
    """Share of different texts in a file, flagged below 0.8, and how often its most frequent text stands. Texts are counted by
    their hash, so no text is shuffled."""
    if approximate:
        out = df.groupBy(*keys).agg(F.count("*").alias("cues"), F.approx_count_distinct(F.xxhash64("text")).alias("kinds"))
        return out.withColumn("share", F.col("kinds") / F.col("cues")).withColumn("repetitive", F.col("share") < 0.8)
    each = df.groupBy(*keys, F.md5(F.col("text").cast("binary")).alias("h")).agg(F.count("*").alias("n"))
    out = each.groupBy(*keys).agg(F.sum("n").alias("cues"), F.count("*").alias("kinds"), F.max("n").alias("most"))
    return out.withColumn("share", F.col("kinds") / F.col("cues")).withColumn("repetitive", F.col("share") < 0.8)


def cue_totals(df: DataFrame, keys: tuple[str, ...] = KEYS, corpus: bool = False) -> DataFrame:
    """Durations, characters, words, averages and speeds for each file; with ``corpus`` for each language and for all files."""
    d = duration_ms()
    groups = df.rollup("language") if corpus else df.groupBy(*keys)
    t = groups.agg(F.count("*").alias("entries"), F.sum(d).alias("total_ms"), F.sum(F.char_length("text")).alias("chars"), F.sum(F.size(words("text"))).alias("words"))
    n = F.col("entries")
    return t.withColumns({
        "avg_duration": F.col("total_ms") / F.lit(1000.0) / n, "avg_chars": F.col("chars") / n, "avg_words": F.col("words") / n,
        "cps": _share(F.col("chars") * 1000.0, "total_ms"), "wpm": _share(F.col("words") * 60000.0, "total_ms"),
    })


def compare_versions(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Metric differences (b - a) of two versions of each file in long form, with both scores and the better version."""
    x = quality_score(cue_metrics(a, keys)).select(*keys, *[F.col(c).cast("double").alias(f"a_{c}") for c in (*METRICS, "score")])
    y = quality_score(cue_metrics(b, keys)).select(*keys, *[F.col(c).cast("double").alias(f"b_{c}") for c in (*METRICS, "score")])
    both = x.join(y, list(keys), "full_outer")
    better = F.when(F.coalesce("a_score", F.lit(0.0)) > F.coalesce("b_score", F.lit(0.0)), "a").when(F.coalesce("b_score", F.lit(0.0)) > F.coalesce("a_score", F.lit(0.0)), "b").otherwise("equal")
    wide = both.select(*keys, "a_score", "b_score", better.alias("better"), *[(F.coalesce(f"b_{m}", F.lit(0.0)) - F.coalesce(f"a_{m}", F.lit(0.0))).alias(m) for m in METRICS])
    return wide.unpivot([*keys, "a_score", "b_score", "better"], list(METRICS), "metric", "difference")
