"""Planning, merging and delivery of chunked subtitle work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.dims import FILE_KEYS, UNIT_KEYS
from cuelake.functions.scratch import stored
from cuelake.functions.text import clock

CHUNK_MS = 60_000
FORMATS = ("mp4", "avi", "mkv", "mov", "webm", "flv", "wmv")
LIMITS = {"least_bytes": 100 * 1024, "most_bytes": 50 * 1024**3, "most_ms": 12 * 3600 * 1000}
STAGES = ("validated", "probed", "chunked", "bucket", "uploaded", "client", "generated", "downloaded", "merged", "verified", "completed")
FAILED, COMPLETED = -1, 11


def chunk_manifest(media: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """One row for each chunk of a media item; the last one may be shorter."""
    n = F.ceil(F.col("duration_ms") / chunk_ms).cast("int")
    rows = media.where("duration_ms > 0").select("media_id", "duration_ms", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    start = F.col("chunk_no").cast("long") * chunk_ms
    length = F.least(F.lit(chunk_ms).cast("long"), F.col("duration_ms") - start)
    return rows.select("media_id", "chunk_no", start.alias("start_ms"), length.alias("chunk_ms"), F.substring(clock(length), 1, 8).alias("duration_text"))


def work_units(chunks: DataFrame, languages: DataFrame, sdh: bool = True) -> DataFrame:
    """Every (chunk, language, regular or SDH) with its generation method. languages is a small dimension (language, core); the
    result has a row for each chunk and language, as every one of them is work."""
    kinds = F.explode(F.array(F.lit(False), F.lit(True)) if sdh else F.array(F.lit(False))).alias("sdh")
    units = chunks.crossJoin(languages.select("language", "core")).select("media_id", "chunk_no", "language", "core", kinds)
    method = F.when(F.col("core"), "precision").when(F.col("sdh"), "dual").otherwise("standard")
    return units.select("media_id", "chunk_no", "language", "sdh", method.alias("method"))


def normalise_languages(requests: DataFrame, dim: DataFrame, most: int = 10) -> DataFrame:
    """Requested codes, trimmed and in lower case, with accepted or a reason: bad format, unsupported, duplicate, over the limit."""
    code = F.lower(F.trim(F.coalesce(F.col("language"), F.lit(""))))
    known = dim.select(F.col("language").alias("_k"))
    r = requests.withColumn("code", code).join(known, F.col("code") == F.col("_k"), "left")
    bad = F.when(~F.col("code").rlike(r"^[a-z]{3}$"), "bad format").when(F.col("_k").isNull(), "unsupported")
    r = r.withColumn("_bad", bad)
    again = F.row_number().over(Window.partitionBy("job_id", "code", F.col("_bad").isNull()).orderBy("pos"))
    r = r.withColumn("_again", again)
    fine = F.col("_bad").isNull() & (F.col("_again") == 1)
    place = F.sum(F.when(fine, 1).otherwise(0)).over(Window.partitionBy("job_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    reason = F.coalesce(F.col("_bad"), F.when(F.col("_again") > 1, "duplicate"), F.when(place > most, "over the limit"))
    return r.select("job_id", "pos", "code", reason.alias("reason")).withColumn("accepted", F.col("reason").isNull())


def admit_media(media: DataFrame, limits: dict = LIMITS, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """Media with the reasons against them (array; empty: accepted)."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    path = F.lower("path")
    reasons = F.array_compact(F.array(
        F.when(~extension.isin(*formats), F.lit("format")), F.when(F.col("size_bytes") < limits["least_bytes"], F.lit("too small")),
        F.when(F.col("size_bytes") > limits["most_bytes"], F.lit("too large")), F.when(F.col("duration_ms") <= 0, F.lit("no duration")),
        F.when(F.col("duration_ms") > limits["most_ms"], F.lit("too long")), F.when(F.col("video_streams") < 1, F.lit("no video")),
        F.when(path.contains("../") | path.contains("..\\") | path.contains("%2e%2e"), F.lit("unsafe path")),
    ))
    return media.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)


_EXTENSION = r"(\.[A-Za-z0-9]{1,20})$"
_DIGITS = 12


def _running(rows: DataFrame, keys: tuple[str, ...], value: str, then: str, bucket: int) -> DataFrame:
    """Adds _before: how many rows of the same keys with ``_counts`` stand before each in order of value and then. They are counted within
    ranges of ``bucket`` values, and ranges start from the totals of those before, so that a common key is not one task."""
    rows = rows.withColumn("_b", F.floor(F.col(value) / bucket))
    totals = rows.groupBy(*keys, "_b").agg(F.count(F.when(F.col("_counts"), 1)).alias("_t"))
    earlier = F.sum("_t").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select(*keys, "_b", F.coalesce(earlier, F.lit(0)).alias("_base"))
    within = F.count(F.when(F.col("_counts"), 1)).over(Window.partitionBy(*keys, "_b").orderBy(value, then).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_w", within).join(base, [*keys, "_b"]).withColumn("_before", F.col("_base") + F.col("_w")).drop("_b", "_w", "_base", "_t")


def safe_output_name(media: DataFrame, most: int = 200, bucket: int = 50_000) -> DataFrame:
    """Output names without characters that file systems refuse, all different, at most ``most`` long with their extension (up to 20
    letters and digits).

    Of equal names the smallest media_id keeps its own; the others take the free numbers from 2 on, in order of media_id, as
    stem~number.extension, where the stem leaves room for the number. Such a name says which stem, number and extension it was made from, so
    numbered names can only meet names that media have of themselves; those numbers are left out."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    clean = F.regexp_replace(F.translate(base, '<>:"/\\|?*', "_________"), r"^[. ]+|[. ]+$", "")
    extension = F.regexp_extract(clean, _EXTENSION, 1)
    stem = F.substring(clean, F.lit(1), F.char_length(clean) - F.char_length(extension))
    named = media.select("media_id", stem.alias("stem"), extension.alias("ext")).withColumn("name", F.concat(F.substring("stem", F.lit(1), F.lit(most) - F.char_length("ext")), "ext"))
    first = named.groupBy("name").agg(F.min("media_id").alias("_first"))
    marked = named.join(first, "name").withColumn("stem", F.substring("stem", F.lit(1), F.lit(most - _DIGITS) - F.char_length("ext")))
    own, others = marked.where("media_id = _first").select("media_id", "name"), marked.where("media_id <> _first")
    # i-th of the media that need a number, from 1
    placed = _running(others.select("stem", "ext", "media_id", F.lit(True).alias("_counts"), F.lit(0).alias("_k")), ("stem", "ext"), "media_id", "_k", bucket)
    placed = stored(placed.select("stem", "ext", "media_id", (F.col("_before") + 1).alias("_i")))
    # numbers that names of media already say: those of a stem and an extension, or of a stem alone
    says = lambda end: F.struct(F.regexp_extract("name", rf"(?s)^(.*)~([1-9][0-9]{{0,10}}){end}$", 1).alias("stem"), (F.regexp_extract("name", _EXTENSION, 1) if end else F.lit("")).alias("ext"), F.regexp_extract("name", rf"(?s)^(.*)~([1-9][0-9]{{0,10}}){end}$", 2).alias("n"))
    taken = first.select(F.explode(F.array(says(r"\.[A-Za-z0-9]{1,20}"), says(""))).alias("s")).where("s.n <> ''").select("s.stem", "s.ext", F.col("s.n").cast("long").alias("n")).where("n >= 2").distinct()
    taken = stored(taken.join(placed.select("stem", "ext").distinct(), ["stem", "ext"], "left_semi"))
    # free numbers below each taken one, in order of the numbers
    ordered = _running(taken.withColumn("_counts", F.lit(True)).withColumn("_k", F.lit(0)), ("stem", "ext"), "n", "_k", bucket)
    gaps = ordered.select("stem", "ext", F.lit(None).cast("long").alias("media_id"), (F.col("n") - 2 - F.col("_before")).alias("_i"), F.lit(True).alias("_counts"), F.lit(1).alias("_k"))
    both = placed.select("stem", "ext", F.col("media_id").cast("long"), "_i", F.lit(False).alias("_counts"), F.lit(0).alias("_k")).unionByName(gaps)
    number = _running(both, ("stem", "ext"), "_i", "_k", bucket).where("not _counts").withColumn("_n", F.col("_i") + 1 + F.col("_before"))
    return own.unionByName(number.select(F.col("media_id").cast(dict(media.dtypes)["media_id"]).alias("media_id"), F.concat("stem", F.lit("~"), F.col("_n").cast("string"), "ext").alias("name")))


def latest_states(states: DataFrame) -> DataFrame:
    """The last state of each job; the maximum is taken map-side."""
    last = states.groupBy("job_id").agg(F.max_by(F.struct(*states.columns), F.struct("updated_us", "event_id")).alias("_m"))
    return last.select("_m.*")


def incomplete_jobs(states: DataFrame, path: str | None = None, id_part: str | None = None) -> DataFrame:
    """Latest state of each job that is not completed, and the stage to run next: a failed job begins anew, others run their
    stage again."""
    latest = latest_states(states).where(F.col("stage") != COMPLETED)
    if path is not None:
        latest = latest.where(F.col("media") == path)
    if id_part is not None:
        latest = latest.where(F.col("job_id").cast("string").contains(id_part))
    return latest.withColumn("next_stage", F.when(F.col("stage") <= 0, 1).otherwise(F.col("stage")))


def retention_split(t: DataFrame, ts_us: str, max_age_us: int, now_us: int, bytes_col: str | None = None) -> DataFrame:
    """Rows and bytes that are older than an age, and those that are not."""
    size = F.sum(bytes_col) if bytes_col else F.lit(0).cast("long")
    expired = F.col(ts_us) < now_us - max_age_us
    return t.groupBy(F.when(expired, "expired").otherwise("kept").alias("state")).agg(F.count("*").alias("n_rows"), size.alias("bytes"))


def merge_chunks(cues: DataFrame, chunk_ms: int = CHUNK_MS, keys: tuple[str, ...] = FILE_KEYS) -> DataFrame:
    """Cues of chunks on the time line of their media, renumbered from 1 in order of chunk and position."""
    shift = F.col("chunk_no").cast("long") * chunk_ms
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("chunk_no", "seq"))
    return cues.select(*keys, number.alias("seq"), (F.col("start_ms") + shift).alias("start_ms"), (F.col("end_ms") + shift).alias("end_ms"), "text")


def latest_file(files: DataFrame, fmt: str = "srt", keys: tuple[str, ...] = UNIT_KEYS) -> DataFrame:
    """The newest delivery of each file in a format. The maximum is taken map-side, so re-deliveries are not shuffled."""
    rest = [c for c in files.columns if c not in (*keys, "modified")]
    newest = files.where(F.col("format") == fmt).groupBy(*keys).agg(F.max(F.struct("modified", *rest)).alias("_m"))
    return newest.select(*keys, "_m.*")


def missing_units(units: DataFrame, files: DataFrame, keys: tuple[str, ...] = UNIT_KEYS) -> DataFrame:
    return units.join(files.select(*keys), list(keys), "left_anti")


def delivery_rate(units: DataFrame, files: DataFrame, least: float = 0.3, keys: tuple[str, ...] = UNIT_KEYS) -> DataFrame:
    """Share of units delivered by language and in all (language null), and what it amounts to."""
    done = files.select(*keys).distinct().withColumn("_d", F.lit(1))
    rate = units.join(done, list(keys), "left").rollup("language").agg(F.count("*").alias("units"), F.count("_d").alias("delivered"))
    share = F.col("delivered") / F.col("units")
    status = F.when(share == 1, "success").when(share >= least, "partial_success").otherwise("failed")
    return rate.select("language", "units", "delivered", share.alias("rate"), (share >= least).alias("accepted"), status.alias("status"))


def short_coverage(cues: DataFrame, media: DataFrame | None = None, least_ms: int = 30_000, share: float = 0.95, keys: tuple[str, ...] = UNIT_KEYS) -> DataFrame:
    """Files whose last cue ends too early: before ``least_ms`` of a chunk, or before ``share`` of the media's duration."""
    last = cues.groupBy(*keys).agg(F.max("end_ms").alias("last_end_ms"), F.count("*").alias("cues"))
    if media is None:
        return last.where(F.col("last_end_ms") < least_ms)
    return last.join(media.select("media_id", "duration_ms"), "media_id").where(F.col("last_end_ms") < F.col("duration_ms") * share)


def best_attempt(attempts: DataFrame, enough: int = 95, most: int = 3) -> DataFrame:
    """Of each unit's first ``most`` attempts, the first that scores enough, else the best above 0 (then the earliest)."""
    good = F.col("score") >= enough
    rank = F.struct(good.alias("g"), F.when(good, -F.col("attempt")).otherwise(F.col("score")).alias("s"), (-F.col("attempt")).alias("a"))
    rows = attempts.where((F.col("attempt") < most) & (F.col("score") > 0))
    best = rows.groupBy("unit").agg(F.max(F.struct(rank.alias("_r"), F.col("attempt"), F.col("score"))).alias("_m"))
    return best.select("unit", "_m.attempt", "_m.score")


def prefer_method(candidates: DataFrame, order: tuple[str, ...] = ("direct", "translate")) -> DataFrame:
    """One candidate of each unit: by method in the order given, then the earliest."""
    place = F.coalesce(*[F.when(F.col("method") == m, k) for k, m in enumerate(order)], F.lit(len(order)))
    best = candidates.groupBy("unit").agg(F.min(F.struct(place.alias("p"), "attempt", "method", "score")).alias("_m"))
    return best.select("unit", "_m.attempt", "_m.method", "_m.score")


def context_window(df: DataFrame, n: int = 3, width: int = 100, keys: tuple[str, ...] = FILE_KEYS) -> DataFrame:
    """The n texts before each cue of its file, cut to ``width`` characters, joined with blanks."""
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(-n, -1)
    return df.withColumn("context", F.array_join(F.collect_list(F.substring("text", 1, width)).over(w), " | "))


def batch_summary(states: DataFrame, newest: int = 20) -> tuple[DataFrame, DataFrame]:
    """Jobs by status with the time since their first state, and the newest jobs."""
    first = states.groupBy("job_id").agg(F.min("updated_us").alias("created_us"))
    status = F.when(F.col("stage") == COMPLETED, "completed").when(F.col("stage") == FAILED, "failed").otherwise("in_progress")
    jobs = latest_states(states).join(first, "job_id").withColumn("status", status)
    total = jobs.groupBy("status").agg(F.count("*").alias("jobs"), F.sum(F.col("updated_us") - F.col("created_us")).alias("duration_us"))
    return total, jobs.orderBy(F.desc("updated_us"), "job_id").limit(newest)
