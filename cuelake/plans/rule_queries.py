"""Queries on validation rules, each with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import rules as V
from cuelake.operators.quality import cue_totals

from . import fixtures as X

WS = r"len(list_filter(regexp_split_to_array({0}, '[\p{{Z}}\s]+'), lambda x: x <> ''))"
BASE = X.LINED + r""",
v as (select *, row_number() over w as position, lead(start_ms) over w as nxt, string_split(text, chr(10)) as ls, end_ms - start_ms as d, length(text) as n from lined window w as (partition by media_id, language, sdh order by start_ms, seq)),
files as (select media_id, language, sdh, count(*) as cues, sum(n) as chars, count(distinct text) as kinds, max(end_ms) as last_end from v group by all)"""
AUDIO = "(media_id % 7 + 1) * 20000"


def _one(rule_id: str, severity: str, test: str, source: str = "v") -> str:
    return f"select media_id, language, sdh, '{rule_id}' as rule_id, '{severity}' as severity, {'seq' if source == 'v' else 'null::int as seq'} from {source} where {test}"


def _many(rule_id: str, severity: str, items: str, test: str = "true") -> str:
    return f"select media_id, language, sdh, '{rule_id}' as rule_id, '{severity}' as severity, seq from (select media_id, language, sdh, seq, unnest({items}) from v where {test})"


E_, W_ = "critical", "warning"
SQL = {
    "format": [_one("R01", E_, "seq <> position"), _one("R02", E_, "d <= 0"), _one("R03", W_, "d < 500"), _one("R04", W_, "d > 10000"), _one("R05", E_, r"regexp_replace(text, '[\p{Z}\s]+', '', 'g') = ''"), _one("R06", E_, "len(ls) > 2"),
               _many("R07", E_, "list_filter(ls, lambda x: length(x) > 42)"), _one("R08", E_, "nxt < end_ms"), _one("R09", W_, "nxt - end_ms > 0 and nxt - end_ms < 100")],
    "script": [_one("R12", E_, r"language = 'eng' and regexp_matches(text, '[^\p{L}\p{N}_\s.,!?;:()\-''\"]')")],
    "language": [_many("R14", E_, r"list_filter(regexp_split_to_array(text, '[.!?]+\s*'), lambda x: x <> '' and not regexp_matches(x, '^\p{Lu}'))", "language = 'eng'"),
                 _many("R15", W_, r"list_filter(regexp_split_to_array(text, '[\p{Z}\s]+'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}_'']', '', 'g') in ('cant', 'wont', 'isnt', 'arent', 'dont', 'doesnt'))", "language = 'eng'"),
                 _one("R16", E_, r"language = 'eng' and regexp_matches(text, '\s{2,}')"), _one("R17", E_, "language = 'eng' and suffix(text, ' ')")],
    "timing": [_one("R22", E_, "d > 0 and n * 1000 > 20 * d"), _one("R23", W_, "not (d > 0 and n * 1000 > 20 * d) and (n * 1000 < 15 * d or d <= 0) and n > 10"), _one("R24", W_, "d < 1000"), _one("R25", W_, "d > 7000"), _one("R26", W_, f"last_end < {AUDIO} * 0.95", "files")],
    "content": [_one("R27", W_, "chars < 50", "files"), _one("R28", W_, "kinds * 10 < cues * 8", "files"), _many("R29", E_, "list_filter(['[inaudible]', '???', '...', 'unclear', 'mumble'], lambda x: contains(lower(text), x))")],
    "readability": [_many("R30", W_, f"list_filter(ls[2:], lambda y: {WS.format('y')} = 1)".replace("lambda x: x <> ''", "lambda z: z <> ''")), _one("R31", W_, "len(ls) = 2 and length(ls[2]) * 2 > length(ls[1]) * 3")],
}


def _audio(spark, d):
    """The length of each medium's sound."""
    media = X.table(spark, d, "documents").select(F.expr("doc_id div 4").alias("media_id")).distinct()
    return media.withColumn("audio_ms", (F.col("media_id") % 7 + 1) * 20000)


def _group(name: str):
    def query(spark, d):
        found = V.validate(X.lined_cues(spark, d), V.GROUPS[name](), _audio(spark, d) if name == "timing" else None)
        return found.groupBy("media_id", "language", "sdh", "rule_id", "severity").agg(F.count("*").alias("findings"), F.coalesce(F.sum("seq"), F.lit(0)).cast("long").alias("seqs"))

    sql = f"with {BASE}, f as ({' union all '.join(SQL[name])}) select media_id, language, sdh, rule_id, severity, count(*) as findings, coalesce(sum(seq), 0)::bigint as seqs from f group by all"
    return query, sql


ALL = " union all ".join(x for k, v in SQL.items() for x in v if "'R26'" not in x)
TOTALS = r"""
totals as (select media_id, language, sdh, case when sum(d) > 0 then sum(n) * 1000.0::double / sum(d) else 0 end as cps, sum(d) / 1000.0::double / count(*) as avg_duration from v group by all)"""


def rule_registry(spark, d):
    """The default rules with one of the user's."""
    mine = V.rule("X01", V.WARNING, "cue", F.col("text").rlike("[0-9]{4}"), F.regexp_extract("text", "[0-9]{4}", 0))
    found = V.validate(X.lined_cues(spark, d), [*V.default_rules(), mine])
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("findings"), F.count_distinct("media_id", "language", "sdh").alias("files"))


def validation_report(spark, d):
    return V.report(X.lined_cues(spark, d)).select("media_id", "language", "sdh", "errors", "warnings", X.rounded("human_equivalence").alias("human_equivalence"), "accuracy_score", "status", "production_ready")


def correction_suggestions(spark, d):
    found = V.suggest(V.validate(X.lined_cues(spark, d), [*V.format_rules(), *V.timing_rules()]))
    return found.groupBy("media_id", "language", "sdh", "rule_id", "severity", "category", "suggestion", "auto_fixable").agg(F.count("*").alias("findings"))


def auto_fix(spark, d):
    return V.auto_fix(X.cues(spark, d).withColumn("seq", F.col("seq") * 2)).select("media_id", "language", "sdh", "seq", "start_ms", "end_ms")


def _files(spark, d):
    hint = F.expr("case media_id % 5 when 0 then 'v_hin_1.mp4' when 1 then 'Bengali.mp4' when 2 then 'v_en_.mp4' else 'v.mp4' end")
    return V.infer_source_language(V.file_texts(X.cues(spark, d)).withColumn("path", hint))


FILES = X.CUES + r""",
texts as (select media_id, language, sdh, string_agg(text, ' ' order by seq) as text, case media_id % 5 when 0 then 'v_hin_1.mp4' when 1 then 'Bengali.mp4' when 2 then 'v_en_.mp4' else 'v.mp4' end as path from cues group by all),
shares as (select *, replace(text, ' ', '') as t, len(regexp_extract_all(text, '[a-zA-Z]')) as latin, len(regexp_extract_all(text, '[ঀ-৿]')) as ben, len(regexp_extract_all(text, '[ऀ-ॿ]')) as hin from texts),
sourced as (select media_id, language, sdh, text, case when path = 'Bengali.mp4' then 'ben' when path = 'v_hin_1.mp4' then 'hin' when path = 'v_en_.mp4' then 'eng'
  when ben / length(t) > 0.5 or hin / length(t) > 0.5 then case when latin / length(t) < 0.1 then 'eng' end when latin / length(t) > 0.5 then case when ben / length(t) < 0.1 then 'ben' else 'hin' end end as source_language from shares)"""


def source_language(spark, d):
    return _files(spark, d).select("media_id", "language", "sdh", "source_language")


def validate_translation(spark, d):
    files = _files(spark, d)
    m = F.col("media_id")
    scores = files.select("media_id", "language", "sdh", (m * 37 % 60 + 40).cast("double").alias("overall"), (m % 10 / 10).alias("cultural"), (m % 7 / 7).alias("fluency"))
    return V.validate_translation(files, scores).select("media_id", "language", "sdh", "rule_id", "severity")


_NATURAL = " + ".join(rf"regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_]){p}')::int" for p in (r"(the|a|an)\s+[\p{L}\p{N}_]", r"(is|are|was|were)\s", r"(and|but|or|so)\s"))
_TR = [("R32", E_, "overall < 70"), ("R33", W_, "overall >= 70 and overall < 85"), ("R34", E_, "cultural < 0.8"), ("R35", E_, "fluency < 0.8"), ("R36", E_, f"language = 'eng' and {_NATURAL} < 2"), ("R38", E_, "(length(text) - length(replace(text, '?', ''))) * 20 > length(text)")]
QUERIES = {f"validate_{k}": _group(k) for k in V.GROUPS} | {
    "validate_translation": (validate_translation, f"""with {FILES}, s as (select *, media_id * 37 % 60 + 40 as overall, media_id % 10 / 10 as cultural, media_id % 7 / 7 as fluency, source_language is not null and source_language <> language as known from sourced)
        {" union all ".join(f"select media_id, language, sdh, '{r}' as rule_id, '{s}' as severity from s where known and {t}" for r, s, t in _TR)} union all select media_id, language, sdh, 'R41', 'warning' from s where not known"""),
    "validation_report": (validation_report, f"""with {BASE}, f as ({ALL}), {TOTALS}, c as (select media_id, language, sdh, count(*) filter (severity = 'critical') as errors, count(*) filter (severity = 'warning') as warnings from f group by all),
        r as (select t.*, coalesce(errors, 0) as errors, coalesce(warnings, 0) as warnings from totals t left join c using (media_id, language, sdh)),
        h as (select *, greatest(0.0, least(100.0, 100 - 15 * errors - 3 * warnings + case when cps between 15 and 20 then 5 else 0 end + case when avg_duration between 2 and 6 then 3 else 0 end))::double as human from r),
        s as (select *, case when errors = 0 and warnings <= 3 and human >= 90 then 'PRODUCTION_READY' when errors = 0 and warnings <= 5 and human >= 80 then 'MINOR_ISSUES' when errors <= 2 and warnings <= 8 then 'NEEDS_REVISION' else 'MAJOR_ISSUES' end as status from h)
        select media_id, language, sdh, errors, warnings, round(human, 6) as human_equivalence, (case when errors = 0 then 95.0 - least(2.0 * warnings, 15.0) else greatest(0.0, 70.0 - 10.0 * errors) end)::double as accuracy_score, status, status in ('PRODUCTION_READY', 'MINOR_ISSUES') as production_ready from s"""),
    "correction_suggestions": (correction_suggestions, f"""with {BASE}, f as ({' union all '.join(x for k in ('format', 'timing') for x in SQL[k] if "'R26'" not in x)}),
        g as (select * from (values {", ".join(f"('{a}', '{b}', '{c}', {str(e).lower()})" for a, b, c, e in V.SUGGESTIONS)}) t(rule_id, category, suggestion, auto_fixable))
        select media_id, language, sdh, rule_id, severity, category, suggestion, auto_fixable, count(*) as findings from f join g using (rule_id) group by all"""),
    "auto_fix": (auto_fix, f"with {X.CUES} select media_id, language, sdh, row_number() over w as seq, start_ms, least(end_ms, coalesce(lead(start_ms) over w, end_ms)) as end_ms from cues window w as (partition by media_id, language, sdh order by start_ms, seq)"),
    "rule_registry": (rule_registry, f"with {BASE}, f as ({ALL} union all {_one('X01', W_, "regexp_matches(text, '[0-9]{4}')")}) select rule_id, severity, count(*) as findings, count(distinct (media_id, language, sdh)) as files from f group by all"),
    "source_language": (source_language, f"with {FILES} select media_id, language, sdh, source_language from sourced"),
}
