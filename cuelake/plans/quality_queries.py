"""Queries on cue quality, each with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import quality as Q

from . import fixtures as X

R = lambda c: X.rounded(c).alias(c)
NW = r"len(list_filter(regexp_split_to_array(text, '[\p{Z}\s]+'), lambda x: x <> ''))"
BLANK = r"regexp_replace(text, '[\p{Z}\s]+', '', 'g') = ''"


def metrics_sql(source: str = "cues", name: str = "metrics", tag: str = "") -> str:
    return f"""
{tag}prior as (select *, lag(end_ms) over (partition by media_id, language, sdh order by seq) as before, {NW} as nw, length(text) as n, end_ms - start_ms as d from {source}),
{tag}totals as (select media_id, language, sdh, count(*) as cues, sum(nw)::bigint as words, sum(n)::bigint as chars, sum(d)::bigint as duration_ms, count(*) filter (d > 0 and n * 1000 > 25 * d) as timing_issues,
  count(*) filter ({BLANK}) as empty_cues, count(*) filter (before <> 0 and start_ms < before) as overlapping from {tag}prior group by all),
{name} as (select *, words / cues as avg_words, chars / cues as avg_chars, duration_ms / 1000.0::double / cues as avg_duration, case when duration_ms > 0 then chars * 1000.0::double / duration_ms else 0 end as reading_speed from {tag}totals)"""


SCORE = """case when cues > 0 then greatest(0.0::double, least(100.0::double, 100 - case when reading_speed > 25 then 2 * (reading_speed - 25) when reading_speed < 10 then 2 * (10 - reading_speed) else 0 end
  - 20 * timing_issues / cues - 30 * empty_cues / cues - 25 * overlapping / cues - case when avg_words > 20 then avg_words - 20 when avg_words < 5 then 2 * (5 - avg_words) else 0 end)) else 0 end"""
METRICS = f"with {X.CUES}, {metrics_sql()}"
CONF = rf"""
conf as (select *, case when {BLANK} then 0 else greatest(0, least(100, 100 - case when regexp_matches(text, '[^\p{{L}}\p{{N}}_\p{{Z}}\s.,!?\-''"()]') then 10 else 0 end - case when {NW} < 2 then 10 else 0 end
  - case when regexp_matches(text, '\p{{Lu}}') <> regexp_matches(text, '\p{{Ll}}') then 5 else 0 end
  - case when 10 * len(list_distinct(list_filter(regexp_split_to_array(text, '[\p{{Z}}\s]+'), lambda x: x <> ''))) < 7 * {NW} then 10 else 0 end
  + case when regexp_matches(text, '[.!?][\p{{Z}}\s]*$') then 5 else 0 end)) end::int as confidence,
  case when end_ms - start_ms < 1000 then '0-1s' when end_ms - start_ms < 3000 then '1-3s' when end_ms - start_ms < 5000 then '3-5s' when end_ms - start_ms < 10000 then '5-10s' else '10s+' end as dr from cues)"""
SUMMARY = f"""
summary as (select media_id, language, sdh, avg(confidence) as mean, stddev_pop(confidence) as std, median(confidence)::double as median,
  {" || ',' || ".join(f"count(*) filter (confidence // 10 = {k})::varchar" for k in range(11))} as histogram,
  {" || ',' || ".join(f"count(*) filter (dr = '{k}')::varchar" for k in ('0-1s', '1-3s', '3-5s', '5-10s', '10s+'))} as by_duration,
  count(*) filter (confidence < 60) as low, count(*) filter (confidence > 85) as high, coalesce(array_to_string((list(seq order by seq) filter (confidence < 60))[1:50], ','), '') as low_cues,
  coalesce(array_to_string((list(seq order by seq) filter (confidence > 85))[1:50], ','), '') as high_cues from conf group by all)"""
TIMING = """
timing as (select media_id, language, sdh, greatest(0, 100 - sum(case when end_ms > start_ms then case when length(text) * 1000 > 25 * (end_ms - start_ms) then 5 when length(text) * 1000 < 5 * (end_ms - start_ms) then 3 else 0 end else 0 end
  + case when end_ms - start_ms < 500 or end_ms - start_ms > 10000 then 2 else 0 end)) / 100 as timing_quality from cues group by all)"""
TEXT = rf"""
stripped as (select *, regexp_replace(text, '^[\p{{Z}}\s]+|[\p{{Z}}\s]+$', '', 'g') as t, {NW} as nw from cues),
textq as (select media_id, language, sdh, greatest(0, 100 - sum(case when {BLANK} then 5 else case when regexp_matches(t, '^\p{{Ll}}') then 1 else 0 end + case when not regexp_matches(t, '[.!?]$') then 1 else 0 end end)
  - case when sum(nw) > 0 and (sum(nw) / count(*) < 2 or sum(nw) / count(*) > 15) then 10 else 0 end) / 100 as text_quality from stripped group by all)"""
LEXICON = [("the", 0.1, 0.2), ("and", 0.3, 0.4), ("of", -0.2, 0.3), ("worthless", -0.9, 0.9), ("idiot", -0.8, 0.8), ("la", 0.5, 0.5), ("de", -0.4, 0.1), ("und", 0.6, 0.9), ("der", -0.3, 0.6), ("el", 0.7, 0.2)]
_LEX = ", ".join(f"('{t}', {p}::double, {s}::double)" for t, p, s in LEXICON)


def cue_metrics(spark, d):
    m = Q.cue_metrics(X.cues(spark, d))
    return m.select("media_id", "language", "sdh", "cues", "words", "chars", "duration_ms", "timing_issues", "empty_cues", "overlapping", R("avg_words"), R("avg_chars"), R("avg_duration"), R("reading_speed"))


def quality_score_100(spark, d):
    return Q.quality_score(Q.cue_metrics(X.cues(spark, d))).select("media_id", "language", "sdh", "cues", R("score"))


def basic_score(spark, d):
    return Q.basic_score(Q.cue_metrics(X.cues(spark, d))).select("media_id", "language", "sdh", R("basic_score"))


def quality_report(spark, d):
    return Q.quality_report(X.cues(spark, d)).select("media_id", "language", "sdh", R("score"), "cues", "timing_issues", "empty_cues", "overlapping", F.array_join("recommendations", "; ").alias("recommendations"))


def cue_confidence(spark, d):
    return Q.cue_confidence(X.cues(spark, d)).select("media_id", "language", "sdh", "seq", "confidence")


def confidence_summary(spark, d):
    return Q.confidence_summary(X.cues(spark, d)).select("media_id", "language", "sdh", R("mean"), R("std"), R("median"), "histogram", "by_duration", "low", "high", "low_cues", "high_cues")


def timing_quality(spark, d):
    return Q.timing_quality(X.cues(spark, d))


def text_quality(spark, d):
    return Q.text_quality(X.cues(spark, d))


def overall_assessment(spark, d):
    c = X.cues(spark, d)
    conf = Q.cue_confidence(c).groupBy("media_id", "language", "sdh").agg((F.avg("confidence") / 100).alias("confidence"))
    parts = conf.join(Q.timing_quality(c), ["media_id", "language", "sdh"]).join(Q.text_quality(c), ["media_id", "language", "sdh"])
    parts = parts.select("media_id", "language", "sdh", "confidence", F.col("timing_quality").alias("timing"), F.when(F.col("media_id") % 4 != 0, F.col("text_quality")).alias("text"))
    return Q.overall_assessment(parts).select("media_id", "language", "sdh", R("overall"), "grade", F.array_join("recommendations", "; ").alias("recommendations"))


def sentiment_preservation(spark, d):
    lexicon = spark.sql("select * from values " + ", ".join(f"('{t}', {p}D, {s}D)" for t, p, s in LEXICON) + " as t(token, polarity, subjectivity)")
    out = Q.sentiment_preservation(X.pairs(spark, d), lexicon)
    return out.select("media_id", "src_lang", "tgt_lang", R("polarity_a"), R("polarity_b"), R("subjectivity_a"), R("subjectivity_b"), "class_a", "class_b", "preserved", R("score"))


def repetition(spark, d):
    return Q.repetition(X.cues(spark, d)).select("media_id", "language", "sdh", "cues", "kinds", "most", R("share"), "repetitive")


def cue_totals(spark, d):
    return Q.cue_totals(X.cues(spark, d), corpus=True).select("language", "entries", "total_ms", "chars", "words", R("avg_duration"), R("avg_chars"), R("avg_words"), R("cps"), R("wpm"))


def version_compare(spark, d):
    out = Q.compare_versions(X.cues(spark, d), X.versions(spark, d))
    return out.select("media_id", "language", "sdh", R("a_score"), R("b_score"), "better", "metric", R("difference"))


_NAMES = ("cues", "words", "chars", "avg_words", "avg_chars", "avg_duration", "reading_speed", "timing_issues", "empty_cues", "overlapping")
QUERIES = {
    "cue_metrics": (cue_metrics, f"{METRICS} select media_id, language, sdh, cues, words, chars, duration_ms, timing_issues, empty_cues, overlapping, round(avg_words, 6) as avg_words, round(avg_chars, 6) as avg_chars, round(avg_duration, 6) as avg_duration, round(reading_speed, 6) as reading_speed from metrics"),
    "quality_score_100": (quality_score_100, f"{METRICS} select media_id, language, sdh, cues, round({SCORE}, 6) as score from metrics"),
    "basic_score": (basic_score, f"{METRICS} select media_id, language, sdh, round(greatest(0, 1 - case when timing_issues > 0 then 0.2 else 0 end - case when empty_cues > 0 then 0.1 else 0 end - case when overlapping > 0 then 0.15 else 0 end + case when reading_speed between 15 and 25 then 0.1 else 0 end), 6)::double as basic_score from metrics"),
    "quality_report": (quality_report, f"""{METRICS} select media_id, language, sdh, round({SCORE}, 6) as score, cues, timing_issues, empty_cues, overlapping, array_to_string(list_filter([case when reading_speed > 25 then 'split long subtitles' end, case when reading_speed < 10 then 'combine short subtitles' end,
        case when timing_issues > 0 then 'adjust durations' end, case when empty_cues > 0 then 'remove or fill empty subtitles' end, case when overlapping > 0 then 'remove overlaps' end], lambda x: x is not null), '; ') as recommendations from metrics"""),
    "cue_confidence": (cue_confidence, f"with {X.CUES}, {CONF} select media_id, language, sdh, seq, confidence from conf"),
    "confidence_summary": (confidence_summary, f"with {X.CUES}, {CONF}, {SUMMARY} select media_id, language, sdh, round(mean, 6) as mean, round(std, 6) as std, median, histogram, by_duration, low, high, low_cues, high_cues from summary"),
    "timing_quality": (timing_quality, f"with {X.CUES}, {TIMING} select * from timing"),
    "text_quality": (text_quality, f"with {X.CUES}, {TEXT} select * from textq"),
    "overall_assessment": (overall_assessment, f"""with {X.CUES}, {CONF}, {TIMING}, {TEXT}, c as (select media_id, language, sdh, avg(confidence) / 100 as confidence from conf group by all),
        p as (select media_id, language, sdh, confidence, timing_quality as timing, case when media_id % 4 <> 0 then text_quality end as text from c join timing using (media_id, language, sdh) join textq using (media_id, language, sdh)),
        o as (select *, (confidence * 0.25 + timing * 0.2 + coalesce(text * 0.1, 0)) / (0.45 + case when text is not null then 0.1 else 0 end) as overall from p)
        select media_id, language, sdh, round(overall, 6) as overall, case when overall >= 0.9 then 'Excellent' when overall >= 0.8 then 'Good' when overall >= 0.7 then 'Fair' when overall >= 0.6 then 'Poor' else 'Very Poor' end as grade,
        coalesce(nullif(array_to_string(list_filter([case when confidence < 0.7 then 'low confidence' end, case when timing < 0.8 then 'timing needs improvement' end], lambda x: x is not null), '; '), ''), 'meets production standards') as recommendations from o"""),
    "sentiment_preservation": (sentiment_preservation, rf"""with {X.PAIRS}, lexicon as (select * from (values {_LEX}) t(token, polarity, subjectivity)),
        toks as (select media_id, src_lang, tgt_lang, 'a' as side, unnest(regexp_extract_all(lower(ref), '{X.WORD}')) as token from pairs union all select media_id, src_lang, tgt_lang, 'b', unnest(regexp_extract_all(lower(hyp), '{X.WORD}')) from pairs),
        s as (select media_id, src_lang, tgt_lang, {", ".join(f"coalesce(avg({c}) filter (side = '{x}'), 0) as {c}_{x}" for c in ("polarity", "subjectivity") for x in "ab")} from toks join lexicon using (token) group by all),
        f as (select media_id, src_lang, tgt_lang, {", ".join(f"coalesce({c}_{x}, 0) as {c}_{x}" for c in ("polarity", "subjectivity") for x in "ab")} from pairs left join s using (media_id, src_lang, tgt_lang)),
        k as (select *, {", ".join(f"case when polarity_{x} > 0.1 then 'positive' when polarity_{x} < -0.1 then 'negative' else 'neutral' end as class_{x}" for x in "ab")}, abs(polarity_a - polarity_b) as dp, abs(subjectivity_a - subjectivity_b) as ds from f)
        select media_id, src_lang, tgt_lang, round(polarity_a, 6) as polarity_a, round(polarity_b, 6) as polarity_b, round(subjectivity_a, 6) as subjectivity_a, round(subjectivity_b, 6) as subjectivity_b, class_a, class_b, dp < 0.3 and ds < 0.4 and class_a = class_b as preserved, round(1 - (dp + ds) / 2, 6) as score from k"""),
    "repetition": (repetition, f"with {X.CUES}, e as (select media_id, language, sdh, text, count(*) as n from cues group by all) select media_id, language, sdh, sum(n)::bigint as cues, count(*) as kinds, max(n) as most, round(count(*) / sum(n), 6) as share, count(*) / sum(n) < 0.8 as repetitive from e group by all"),
    "cue_totals": (cue_totals, f"""with {X.CUES}, t as (select language, count(*) as entries, sum(end_ms - start_ms)::bigint as total_ms, sum(length(text))::bigint as chars, sum({NW})::bigint as words from cues group by rollup (language))
        select *, round(total_ms / 1000.0::double / entries, 6) as avg_duration, round(chars / entries, 6) as avg_chars, round(words / entries, 6) as avg_words, round(chars * 1000.0::double / total_ms, 6) as cps, round(words * 60000.0::double / total_ms, 6) as wpm from t"""),
    "version_compare": (version_compare, f"""with {X.VERSIONS}, {metrics_sql("cues", "ma", "a")}, {metrics_sql("versions", "mb", "b")}, sa as (select *, {SCORE} as score from ma), sb as (select *, {SCORE} as score from mb),
        j as (select coalesce(a.media_id, b.media_id) as media_id, coalesce(a.language, b.language) as language, coalesce(a.sdh, b.sdh) as sdh, a.score as a_score, b.score as b_score, {", ".join(f"(coalesce(b.{m}, 0) - coalesce(a.{m}, 0))::double as {m}" for m in _NAMES)} from sa a full join sb b on a.media_id = b.media_id and a.language = b.language and a.sdh = b.sdh)
        select media_id, language, sdh, round(a_score, 6) as a_score, round(b_score, 6) as b_score, case when coalesce(a_score, 0) > coalesce(b_score, 0) then 'a' when coalesce(b_score, 0) > coalesce(a_score, 0) then 'b' else 'equal' end as better, metric, round(difference, 6) as difference
        from (unpivot j on {", ".join(_NAMES)} into name metric value difference)"""),
}
