"""Rule-based validation of cues: all rules of a scope in one projection, findings in long form, and reports on them.

A rule is a name, a severity and an array of details for a row (empty: no finding). Cue rules see a cue with its position and the
start of the next cue; file rules see sums over a file. Users add rules of either scope with ``rule``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake import dims
from cuelake.functions.text import BLANK, clip, is_blank, words

from .quality import duration_ms

KEYS = dims.FILE_KEYS
CRITICAL, WARNING = "critical", "warning"
MOST_CHARS = 42
#: Signs of unclear speech, contractions without their apostrophe, and ranges of scripts.
INDICATORS = ["[inaudible]", "???", "...", "unclear", "mumble"]
CONTRACTIONS = ["cant", "wont", "isnt", "arent", "dont", "doesnt"]
BENGALI, DEVANAGARI = r"[ঀ-৿]", r"[ऀ-ॿ]"
#: Letters outside the script of a language.
FOREIGN = {"ben": r"[\p{L}&&[^ঀ-৿]]", "hin": r"[\p{L}&&[^ऀ-ॿ]]"}
FORBIDDEN = {"eng": r"[^\p{L}\p{N}_\s.,!?;:()\-'\"]", "ben": r"[a-zA-Z0-9](?![০-৯])", "hin": r"[a-zA-Z0-9](?![०-९])"}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    scope: str
    details: Column


def rule(rule_id: str, severity: str, scope: str, predicate: Column, detail: Column | str = "") -> Rule:
    """A rule that gives one finding where the predicate holds."""
    text = F.lit(detail) if isinstance(detail, str) else detail.cast("string")
    return Rule(rule_id, severity, scope, F.when(predicate, F.array(F.coalesce(text, F.lit("")))).otherwise(F.array().cast("array<string>")))


def _each(rule_id: str, severity: str, details: Column, where: Column | None = None, scope: str = "cue") -> Rule:
    none = F.array().cast("array<string>")
    return Rule(rule_id, severity, scope, F.coalesce(F.when(where, details).otherwise(none) if where is not None else details, none))


def _lines() -> Column:
    return F.split("text", "\n")


def format_rules() -> list[Rule]:
    d = duration_ms()
    gap = F.col("next_start") - F.col("end_ms")
    long_lines = F.transform(F.filter(_lines(), lambda x: F.char_length(x) > MOST_CHARS), lambda x: F.char_length(x).cast("string"))
    return [
        rule("R01", CRITICAL, "cue", F.col("seq") != F.col("position"), F.col("position")), rule("R02", CRITICAL, "cue", d <= 0, d), rule("R03", WARNING, "cue", d < 500, d),
        rule("R04", WARNING, "cue", d > 10000, d), rule("R05", CRITICAL, "cue", is_blank("text")), rule("R06", CRITICAL, "cue", F.size(_lines()) > 2, F.size(_lines())),
        _each("R07", CRITICAL, long_lines), rule("R08", CRITICAL, "cue", gap < 0, gap), rule("R09", WARNING, "cue", (gap > 0) & (gap < 100), gap),
    ]


def script_rules() -> list[Rule]:
    language = F.col("language")
    indic = language.isin("ben", "hin")
    foreign = F.when(language == "ben", F.regexp_extract_all("text", F.lit(FOREIGN["ben"]), F.lit(0))).when(language == "hin", F.regexp_extract_all("text", F.lit(FOREIGN["hin"]), F.lit(0)))
    forbidden = F.coalesce(*[F.when(language == k, F.col("text").rlike(v)) for k, v in FORBIDDEN.items()], F.lit(False))
    return [_each("R10", CRITICAL, foreign, indic), rule("R11", CRITICAL, "cue", indic & F.col("text").rlike("[a-zA-Z]")), rule("R12", CRITICAL, "cue", forbidden)]


def language_rules() -> list[Rule]:
    language = F.col("language")
    english, bengali, hindi = (language == x for x in ("eng", "ben", "hin"))
    inner = F.filter(F.split("text", "[.।!?]"), lambda x: ~is_blank(x))
    low = F.filter(F.split("text", r"[.!?]+\s*"), lambda x: (x != "") & ~x.rlike(r"^\p{Lu}"))
    bare = F.filter(words("text"), lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_']", "").isin(*CONTRACTIONS))
    ended = F.regexp_replace("text", rf"{BLANK}$", "").rlike("[।?!]$")
    return [
        _each("R13", WARNING, F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0))), bengali | hindi), _each("R14", CRITICAL, F.transform(low, lambda x: F.substring(x, 1, 20)), english),
        _each("R15", WARNING, bare, english), rule("R16", CRITICAL, "cue", english & F.col("text").rlike(r"\s{2,}")), rule("R17", CRITICAL, "cue", english & F.col("text").endswith(" ")),
        rule("R18", CRITICAL, "cue", bengali & F.col("text").rlike("্(?![ক-হ])")), rule("R19", WARNING, "cue", bengali & ~ended),
        rule("R20", CRITICAL, "cue", hindi & F.col("text").rlike("्(?![क-ह])")), rule("R21", WARNING, "cue", hindi & ~ended),
    ]


def timing_rules() -> list[Rule]:
    """The speed limits of English hold for every language."""
    d, n = duration_ms(), F.char_length("text")
    fast, slow = (d > 0) & (n * 1000 > 20 * d), (n * 1000 < 15 * d) | (d <= 0)
    return [
        rule("R22", CRITICAL, "cue", fast), rule("R23", WARNING, "cue", ~fast & slow & (n > 10)), rule("R24", WARNING, "cue", d < 1000, d), rule("R25", WARNING, "cue", d > 7000, d),
        rule("R26", WARNING, "file", F.col("last_end") < F.col("audio_ms") * 0.95, F.col("last_end")),
    ]


def content_rules() -> list[Rule]:
    found = F.filter(F.array(*map(F.lit, INDICATORS)), lambda x: F.lower("text").contains(x))
    return [rule("R27", WARNING, "file", F.col("chars") < 50), rule("R28", WARNING, "file", F.col("kinds") * 10 < F.col("cues") * 8), _each("R29", CRITICAL, found)]


def readability_rules() -> list[Rule]:
    later = F.slice(_lines(), 2, F.greatest(F.size(_lines()) - 1, F.lit(0)))
    single = F.filter(later, lambda x: F.size(words(x)) == 1)
    two = (F.size(_lines()) == 2) & (F.char_length(F.try_element_at(_lines(), F.lit(2))) * 2 > F.char_length(_lines()[0]) * 3)
    return [_each("R30", WARNING, single), rule("R31", WARNING, "cue", two)]


GROUPS = {"format": format_rules, "script": script_rules, "language": language_rules, "timing": timing_rules, "content": content_rules, "readability": readability_rules}


def default_rules() -> list[Rule]:
    return [r for group in GROUPS.values() for r in group()]


def _findings(rows: DataFrame, rules: list[Rule], keys: tuple[str, ...], seq: Column) -> DataFrame:
    def rows_of(r: Rule) -> Column:
        return F.transform(r.details, lambda x: F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), x.alias("detail")))

    each = F.flatten(F.array(*map(rows_of, rules)))
    return rows.select(*keys, seq.alias("seq"), F.explode(each).alias("f")).select(*keys, "seq", "f.*")


def _placed(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Cues with their position in the file and the start of the next."""
    w = Window.partitionBy(*keys).orderBy("start_ms", "seq")
    return df.withColumn("position", F.row_number().over(w)).withColumn("next_start", F.lead("start_ms").over(w))


def _file_sums() -> list[Column]:
    return [F.count("*").alias("cues"), F.sum(F.char_length("text")).alias("chars"), F.count_distinct(F.xxhash64("text")).alias("kinds"), F.max("end_ms").alias("last_end")]


def _with_audio(sums: DataFrame, audio: DataFrame | None) -> DataFrame:
    return sums.join(audio.select("media_id", "audio_ms"), "media_id", "left") if audio is not None else sums.withColumn("audio_ms", F.lit(None).cast("long"))


def validate(df: DataFrame, rules: list[Rule] | None = None, audio: DataFrame | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Findings (keys, seq, rule_id, severity, detail) of cues; seq is null for findings on a file. audio: media_id, audio_ms. A file
    without cues has no row here; see ``empty_files``."""
    rules = default_rules() if rules is None else rules
    parts = []
    if cue_rules := [r for r in rules if r.scope == "cue"]:
        parts.append(_findings(_placed(df, keys), cue_rules, keys, F.col("seq")))
    if file_rules := [r for r in rules if r.scope == "file"]:
        parts.append(_findings(_with_audio(df.groupBy(*keys).agg(*_file_sums()), audio), file_rules, keys, F.lit(None).cast("int")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def empty_files(files: DataFrame, df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Finding R00 for files without a single cue."""
    none = files.select(*keys).distinct().join(df.select(*keys).distinct(), list(keys), "left_anti")
    return none.select(*keys, F.lit(None).cast("int").alias("seq"), F.lit("R00").alias("rule_id"), F.lit(CRITICAL).alias("severity"), F.lit("").alias("detail"))


def file_texts(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """All text of each file, in order."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("_t"))
    return rows.select(*keys, F.array_join(F.transform("_t", lambda x: x.text), " ").alias("text"))


def _any(terms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda x: F.col("text").contains(x))


def translation_rules() -> list[Rule]:
    """Rules on a file's text with its scores (overall 0 to 100, cultural, fluency) and the language it was made from."""
    language = F.col("language")
    known = F.col("source_language").isNotNull() & (F.col("source_language") != language)
    say = lambda p: F.col("text").rlike(rf"(?i)(^|[^\p{{L}}\p{{N}}_]){p}").cast("int")
    natural = say(r"(the|a|an)\s+[\p{L}\p{N}_]") + say(r"(is|are|was|were)\s") + say(r"(and|but|or|so)\s")
    devanagari = F.col("text").rlike(DEVANAGARI)
    authentic = F.when(language == "ben", _any(dims.BENGALI_CONTEXT) | _any(dims.BENGALI_STRUCTURE)).when(language == "hin", _any(dims.HINDI_CONTEXT) & devanagari).when(language == "eng", natural >= 2).otherwise(True)
    latin = F.regexp_count("text", F.lit(r"(?<![\p{L}\p{N}_])[a-zA-Z]{3,}(?![\p{L}\p{N}_])"))
    n = F.char_length("text")
    f = lambda rule_id, severity, p: rule(rule_id, severity, "file", known & p)
    return [
        f("R32", CRITICAL, F.col("overall") < 70), f("R33", WARNING, (F.col("overall") >= 70) & (F.col("overall") < 85)), f("R34", CRITICAL, F.col("cultural") < 0.8), f("R35", CRITICAL, F.col("fluency") < 0.8),
        f("R36", CRITICAL, ~authentic), f("R37", WARNING, (F.col("source_language") == "eng") & language.isin("ben", "hin") & (latin * 10 > F.size(words("text")) * 3)),
        f("R38", CRITICAL, (n - F.char_length(F.replace("text", F.lit("?"), F.lit("")))) * 20 > n), f("R39", WARNING, (language == "ben") & (n > 100) & ~F.col("text").contains("বাংলা")),
        f("R40", CRITICAL, (language == "hin") & ~devanagari), rule("R41", WARNING, "file", ~known),
    ]


def validate_translation(files: DataFrame, scores: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Findings on translated files (keys, text, source_language) with their scores."""
    return _findings(files.join(scores, list(keys), "left"), translation_rules(), keys, F.lit(None).cast("int"))


def infer_source_language(files: DataFrame) -> DataFrame:
    """Adds source_language: from a hint in the path, else from the shares of scripts in the text (blanks left out)."""
    path = F.lower(F.coalesce(F.col("path"), F.lit("")))
    hint = lambda *t: path.contains(t[0]) | path.contains(t[1]) | path.contains(t[2])
    text = F.replace("text", F.lit(" "), F.lit(""))
    n = F.char_length(text)
    share = lambda p: F.regexp_count(text, F.lit(p)) / n
    ben, hin, latin = share(BENGALI), share(DEVANAGARI), share("[a-zA-Z]")
    by_script = F.when(n > 0, F.when((ben > 0.5) | (hin > 0.5), F.when(latin < 0.1, "eng")).when(latin > 0.5, F.when(ben < 0.1, "ben").otherwise("hin")))
    return files.withColumn("source_language", F.when(hint("bengali", "_ben_", "_bn_"), "ben").when(hint("hindi", "_hin_", "_hi_"), "hin").when(hint("english", "_eng_", "_en_"), "eng").otherwise(by_script))


def validation_report(findings: DataFrame, totals: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Counts, human equivalence, accuracy and status of every file in totals (cps, avg_duration); files without findings too."""
    counts = findings.groupBy(*keys).agg(F.count(F.when(F.col("severity") == CRITICAL, 1)).alias("errors"), F.count(F.when(F.col("severity") == WARNING, 1)).alias("warnings"))
    return _judged(totals.select(*keys, "cps", "avg_duration").join(counts, list(keys), "left").na.fill(0, ["errors", "warnings"]), keys)


def _judged(r: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    e, w = F.col("errors"), F.col("warnings")
    human = clip(F.lit(100.0) - 15 * e - 3 * w + F.when(F.col("cps").between(15, 20), 5).otherwise(0) + F.when(F.col("avg_duration").between(2, 6), 3).otherwise(0), 0.0, 100.0)
    accuracy = F.when(e == 0, 95.0 - F.least(2.0 * w, F.lit(15.0))).otherwise(F.greatest(F.lit(0.0), 70.0 - 10.0 * e))
    status = F.when((e == 0) & (w <= 3) & (human >= 90), "PRODUCTION_READY").when((e == 0) & (w <= 5) & (human >= 80), "MINOR_ISSUES").when((e <= 2) & (w <= 8), "NEEDS_REVISION").otherwise("MAJOR_ISSUES")
    return r.select(*keys, "errors", "warnings", human.alias("human_equivalence"), accuracy.alias("accuracy_score"), status.alias("status"), status.isin("PRODUCTION_READY", "MINOR_ISSUES").alias("production_ready"))


def report(df: DataFrame, rules: list[Rule] | None = None, keys: tuple[str, ...] = KEYS, audio: DataFrame | None = None) -> DataFrame:
    """validation_report of the findings of all rules, in one pass: findings are counted where the cues are, with the sums that file rules
    and totals need, so that the cues are made and shuffled once and no finding is a row."""
    rules = default_rules() if rules is None else rules
    number = lambda scope, severity: sum((F.size(r.details) for r in rules if (r.scope, r.severity) == (scope, severity)), F.lit(0)).cast("long")
    each = _placed(df, keys).withColumns({"_errors": number("cue", CRITICAL), "_warnings": number("cue", WARNING)})
    files = each.groupBy(*keys).agg(*_file_sums(), F.sum(duration_ms()).alias("_ms"), F.sum("_errors").alias("_errors"), F.sum("_warnings").alias("_warnings"))
    files = _with_audio(files, audio).withColumns({"errors": F.col("_errors") + number("file", CRITICAL), "warnings": F.col("_warnings") + number("file", WARNING)})
    speed = F.when(F.col("_ms") > 0, F.col("chars") * 1000.0 / F.col("_ms")).otherwise(0.0)
    return _judged(files.withColumns({"cps": speed, "avg_duration": F.col("_ms") / F.lit(1000.0) / F.col("cues")}), keys)


#: Rules with a suggestion: category, what to do, and whether auto_fix does it.
SUGGESTIONS = [
    ("R01", "format", "Renumber all subtitle entries sequentially starting from 1", True),
    ("R08", "timing", "Adjust end time of first subtitle or start time of second subtitle", True),
    ("R22", "timing", "Increase subtitle duration or split into multiple subtitles", False),
    ("R03", "timing", "Consider combining with adjacent subtitle if contextually appropriate", False),
    ("R24", "timing", "Consider combining with adjacent subtitle if contextually appropriate", False),
]


def suggest(findings: DataFrame) -> DataFrame:
    """Findings that have a suggestion, with it."""
    dim = dims.frame(findings.sparkSession, SUGGESTIONS, "rule_id, category, suggestion, auto_fixable")
    return findings.join(dim, "rule_id")


def auto_fix(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Renumbers cues in order of time and ends a cue where the next one starts, if it ended later."""
    w = Window.partitionBy(*keys).orderBy("start_ms", "seq")
    fixed = df.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("start_ms").over(w))
    return fixed.withColumn("seq", F.col("_n")).withColumn("end_ms", F.least("end_ms", F.coalesce("_next", "end_ms"))).drop("_n", "_next")
