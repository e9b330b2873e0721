"""Queries on sources, planning, merging and delivery, each with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake import dims
from cuelake.operators import merge as M
from cuelake.sources import srt

from . import fixtures as X

_VALUES = ", ".join(f"('{c}', {str(k).lower()})" for c, _, k in dims.LANGUAGES)
LANGUAGE_CTE = f"\nlanguage_dim as (select * from (values {_VALUES}) t(language, core))"
_CLOCK = lambda c, sep: f"lpad(({c} // 3600000)::varchar, 2, '0') || ':' || lpad(({c} // 60000 % 60)::varchar, 2, '0') || ':' || lpad(({c} // 1000 % 60)::varchar, 2, '0') || '{sep}' || lpad(({c} % 1000)::varchar, 3, '0')"
SAFE = X.CUES + r""",
plain as (select media_id, language, sdh, seq, start_ms, end_ms, regexp_replace(text, '\s+', ' ', 'g') as text from cues)"""


def _plain(spark, d):
    """Cues whose text is one line without outer blanks, so that files read back as they were written."""
    return X.cues(spark, d).withColumn("text", F.regexp_replace("text", r"[ \t\n\f\r]+", " "))


def srt_ingest(spark, d):
    back = srt.srt_ingest(srt.srt_render(_plain(spark, d)))
    return back.groupBy(*dims.FILE_KEYS).agg(F.count("*").alias("cues"), F.sum("seq").alias("seqs"), F.sum("start_ms").alias("starts"), F.sum("end_ms").alias("ends"), F.sum(F.char_length(F.trim("text"))).alias("chars"))


_BACK = "select media_id, language, sdh, count(*) as cues, sum(seq)::bigint as seqs, sum(start_ms)::bigint as starts, sum(end_ms)::bigint as ends, sum(length(trim(text)))::bigint as chars from plain group by all"


def srt_ingest_plain(spark, d):
    """Rendered files whose numbers are words in every second medium, read without them."""
    files = srt.srt_render(_plain(spark, d))
    named = files.withColumn("content", F.when(F.col("media_id") % 2 == 0, F.regexp_replace("content", r"(^|\n)\d+\n(\d\d:)", "$1cue\n$2")).otherwise(F.col("content")))
    back = srt.srt_ingest(named, "plain")
    return back.groupBy(*dims.FILE_KEYS).agg(F.count("*").alias("cues"), F.sum("seq").alias("seqs"), F.sum("start_ms").alias("starts"), F.sum("end_ms").alias("ends"), F.sum(F.char_length(F.trim("text"))).alias("chars"))


def _damaged(spark, d):
    """Rendered files with a broken time line in the second block of every third media."""
    files = srt.srt_render(_plain(spark, d))
    return files.withColumn("content", F.when(F.col("media_id") % 3 == 0, F.regexp_replace("content", r"(\n2\n\d\d:\d\d:\d\d),", "$1.")).otherwise(F.col("content")))


def srt_ingest_strict(spark, d):
    return srt.strict_blocks(_damaged(spark, d)).groupBy(*dims.FILE_KEYS).agg(F.count(F.when(F.col("reason").isNull(), 1)).alias("accepted"), F.count("reason").alias("refused"), F.coalesce(F.max("reason"), F.lit("")).alias("reason"), F.sum("end_ms").alias("ends"))


def model_response_repair(spark, d):
    fence = F.concat(F.lit("Here it is:\n```srt\n"), F.col("content"), F.lit("```\nDone.\n"))
    bodies = srt.srt_render(_plain(spark, d)).select(*dims.FILE_KEYS, F.when(F.col("media_id") % 2 == 0, fence).otherwise(F.replace("content", F.lit("\n\n"), F.lit("\n"))).alias("body"))
    back = srt.repair_responses(bodies)
    return back.groupBy(*dims.FILE_KEYS).agg(F.count("*").alias("cues"), F.sum("seq").alias("seqs"), F.sum("start_ms").alias("starts"), F.sum("end_ms").alias("ends"), F.sum(F.char_length(F.trim("text"))).alias("chars"))


def _render_sql(sep: str, head: str, number: str) -> str:
    return f"with {X.CUES} select media_id, language, sdh, {head} string_agg({number}{_CLOCK('start_ms', sep)} || ' --> ' || {_CLOCK('end_ms', sep)} || chr(10) || text || chr(10), chr(10) order by seq) as content from cues group by 1, 2, 3"


def output_summary(spark, d):
    files = srt.srt_render(X.cues(spark, d)).withColumn("name", F.concat(F.col("media_id").cast("string"), F.lit("_"), "language", F.when(F.col("sdh"), "_sdh").otherwise(""), F.lit(".srt")))
    return srt.output_summary(files)


def chunk_manifest(spark, d):
    return M.chunk_manifest(X.media(spark, d)).groupBy("media_id").agg(F.count("*").alias("chunks"), F.sum("chunk_ms").alias("total_ms"), F.max("start_ms").alias("last_start"), F.max_by("duration_text", "chunk_no").alias("last_text"))


def work_units(spark, d):
    chunks = X.units(spark, d).select("media_id", "chunk_no").distinct()
    return M.work_units(chunks, dims.languages(spark)).groupBy("language", "method").agg(F.count("*").alias("units"), F.sum(F.col("sdh").cast("int")).alias("sdh_units"))


def _requests(spark, d):
    """Requested codes with repeats, unknown and malformed ones, from events."""
    e = X.table(spark, d, "events")
    code = F.expr("element_at(array('eng', ' HIN', 'ben', 'xx', 'zzz', 'tel', 'Mar', 'tam', 'guj', 'kan', 'mal', 'ori', 'asm', 'urd', 'san'), int(event_id % 15) + 1)")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("pos"), code.alias("language"))


def language_normalise(spark, d):
    out = M.normalise_languages(_requests(spark, d), dims.languages(spark))
    return out.select("job_id", "pos", "code", "reason", "accepted")


def media_admission(spark, d):
    return M.admit_media(X.media(spark, d)).select("media_id", "accepted", F.array_join("reasons", ",").alias("reasons"))


def safe_output_name(spark, d):
    """Names that repeat, some of which say a number themselves."""
    n = F.col("media_id")
    said = F.when(n % 3 == 0, F.concat(F.lit("~"), (F.expr("media_id div 3 % 4") + 2).cast("string"))).otherwise("")
    m = X.media(spark, d).withColumn("path", F.concat(F.lit("v/ clip:"), (n % 6).cast("string"), said, F.lit(".mp4. ")))
    return M.safe_output_name(m)


def incomplete_jobs(spark, d):
    return M.incomplete_jobs(X.job_states(spark, d)).select("job_id", "stage", "next_stage", "updated_us")


def retention_split(spark, d):
    return M.retention_split(X.job_states(spark, d).withColumn("b", F.col("event_id") % 1000), "updated_us", 30 * 86_400_000_000, 1_706_745_600_000_000, "b")


def merge_chunks(spark, d):
    return M.merge_chunks(X.chunk_cues(spark, d)).select("media_id", "language", "sdh", "seq", "start_ms", "end_ms", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def latest_file(spark, d):
    return M.latest_file(X.files(spark, d)).select("media_id", "language", "sdh", "chunk_no", "modified", "format")


def missing_units(spark, d):
    return M.missing_units(X.units(spark, d), X.files(spark, d))


def delivery_rate(spark, d):
    return M.delivery_rate(X.units(spark, d), X.files(spark, d).where("format = 'srt'"), 0.3)


def short_coverage(spark, d):
    return M.short_coverage(X.chunk_cues(spark, d)).select("media_id", "language", "sdh", "chunk_no", "last_end_ms", "cues")


def best_attempt(spark, d):
    return M.best_attempt(X.attempts(spark, d))


def method_preference(spark, d):
    return M.prefer_method(X.attempts(spark, d))


def context_window(spark, d):
    return M.context_window(X.cues(spark, d)).select("media_id", "language", "sdh", "seq", F.char_length("context").alias("n"), F.md5(F.col("context").cast("binary")).alias("context_md5"))


def batch_summary(spark, d):
    total, newest = M.batch_summary(X.job_states(spark, d))
    return total.select("status", "jobs", F.col("duration_us").alias("value")).union(newest.select(F.concat(F.lit("newest "), "status"), F.lit(1).cast("long"), "updated_us"))


LATEST = X.JOB_STATES + ",\nlatest as (select * from job_states qualify row_number() over (partition by job_id order by updated_us desc, event_id desc) = 1)"
QUERIES = {
    "srt_ingest": (srt_ingest, f"with {SAFE} {_BACK}"),
    "srt_ingest_plain": (srt_ingest_plain, f"with {SAFE} {_BACK}"),
    "srt_ingest_strict": (srt_ingest_strict, f"""with {SAFE} select media_id, language, sdh, count(*) filter (not (media_id % 3 = 0 and seq = 2)) as accepted, count(*) filter (media_id % 3 = 0 and seq = 2) as refused,
        coalesce(max(case when media_id % 3 = 0 and seq = 2 then 'bad times' end), '') as reason, sum(end_ms) filter (not (media_id % 3 = 0 and seq = 2))::bigint as ends from plain group by all"""),
    "model_response_repair": (model_response_repair, f"with {SAFE} {_BACK}"),
    "srt_render": (lambda s, d: srt.srt_render(X.cues(s, d)), _render_sql(",", "", "seq::varchar || chr(10) || ")),
    "vtt_render": (lambda s, d: srt.vtt_render(X.cues(s, d)), _render_sql(".", "'WEBVTT' || chr(10) || chr(10) ||", "")),
    "output_summary": (output_summary, f"with r as ({_render_sql(',', '', 'seq::varchar || chr(10) || ')}) select media_id, count(*) as files, sum(strlen(content))::bigint as bytes, string_agg(media_id::varchar || '_' || language || case when sdh then '_sdh' else '' end || '.srt', ',' order by media_id::varchar || '_' || language || case when sdh then '_sdh' else '' end || '.srt') as names from r group by 1"),
    "chunk_manifest": (chunk_manifest, f"""with {X.MEDIA}, rows as (select media_id, c, least(60000, duration_ms - c * 60000) as chunk_ms from media, unnest(range(ceil(duration_ms / 60000)::bigint)) u(c) where duration_ms > 0)
        select media_id, count(*) as chunks, sum(chunk_ms)::bigint as total_ms, max(c * 60000)::bigint as last_start, substr(max_by({_CLOCK('chunk_ms', ',')}, c), 1, 8) as last_text from rows group by 1"""),
    "work_units": (work_units, f"""with {X.UNITS}, {LANGUAGE_CTE}, c as (select distinct media_id, chunk_no from units), u as (select language, core, sdh from c, language_dim, (values (false), (true)) s(sdh))
        select language, case when core then 'precision' when sdh then 'dual' else 'standard' end as method, count(*) as units, sum(sdh::int)::bigint as sdh_units from u group by 1, 2"""),
    "language_normalise": (language_normalise, f"""with {LANGUAGE_CTE},
        req as (select user_id as job_id, event_id as pos, lower(trim(['eng', ' HIN', 'ben', 'xx', 'zzz', 'tel', 'Mar', 'tam', 'guj', 'kan', 'mal', 'ori', 'asm', 'urd', 'san'][event_id % 15 + 1])) as code from events),
        bad as (select job_id, pos, code, case when not regexp_full_match(code, '[a-z]{{3}}') then 'bad format' when language is null then 'unsupported' end as bad from req left join language_dim on code = language),
        ag as (select *, row_number() over (partition by job_id, code, bad is null order by pos) as again from bad),
        pl as (select *, sum(case when bad is null and again = 1 then 1 else 0 end) over (partition by job_id order by pos) as place from ag)
        select job_id, pos, code, coalesce(bad, case when again > 1 then 'duplicate' when place > 10 then 'over the limit' end) as reason, coalesce(bad, case when again > 1 then 'duplicate' when place > 10 then 'over the limit' end) is null as accepted from pl"""),
    "media_admission": (media_admission, f"""with {X.MEDIA}, r as (select media_id, list_filter([
        case when lower(regexp_extract(path, '\\.([^./]+)$', 1)) not in ('mp4', 'avi', 'mkv', 'mov', 'webm', 'flv', 'wmv') then 'format' end, case when size_bytes < 102400 then 'too small' end,
        case when size_bytes > 53687091200 then 'too large' end, case when duration_ms <= 0 then 'no duration' end, case when duration_ms > 43200000 then 'too long' end,
        case when video_streams < 1 then 'no video' end, case when contains(lower(path), '../') or contains(lower(path), '..\\') or contains(lower(path), '%2e%2e') then 'unsafe path' end], lambda x: x is not null) as reasons from media)
        select media_id, len(reasons) = 0 as accepted, coalesce(array_to_string(reasons, ','), '') as reasons from r"""),
    "safe_output_name": (safe_output_name, f"""with {X.MEDIA}, n as (select media_id, 'clip_' || (media_id % 6)::varchar || case when media_id % 3 = 0 then '~' || (media_id // 3 % 4 + 2)::varchar else '' end as stem from media),
        k as (select *, row_number() over (partition by stem order by media_id) - 1 as i from n),
        free as (select stem, f, row_number() over (partition by stem order by f) as i from (select distinct stem from k where i > 0), unnest(range(2, (select count(*) + 100 from media)::bigint)) u(f) where stem || '~' || f::varchar not in (select stem from k))
        select media_id, case when k.i = 0 then stem || '.mp4' else stem || '~' || f::varchar || '.mp4' end as name from k left join free using (stem, i)"""),
    "incomplete_jobs": (incomplete_jobs, f"with {LATEST} select job_id, stage, case when stage <= 0 then 1 else stage end as next_stage, updated_us from latest where stage <> 11"),
    "retention_split": (retention_split, f"with {X.JOB_STATES} select case when updated_us < 1706745600000000 - 30 * 86400000000 then 'expired' else 'kept' end as state, count(*) as n_rows, sum(event_id % 1000)::bigint as bytes from job_states group by 1"),
    "merge_chunks": (merge_chunks, f"with {X.CUES} select media_id, language, sdh, seq, start_ms, end_ms, md5(text) as text_md5 from cues"),
    "latest_file": (latest_file, f"with {X.FILES} select media_id, language, sdh, chunk_no, modified, format from files where format = 'srt' qualify row_number() over (partition by media_id, language, sdh, chunk_no order by modified desc) = 1"),
    "missing_units": (missing_units, f"with {X.FILES} select * from units u where not exists (select 1 from files f where f.media_id = u.media_id and f.language = u.language and f.sdh = u.sdh and f.chunk_no = u.chunk_no)"),
    "delivery_rate": (delivery_rate, f"""with {X.FILES}, f as (select distinct media_id, language, sdh, chunk_no, 1 as d from files where format = 'srt'),
        r as (select u.language, count(*) as units, count(d) as delivered from units u left join f using (media_id, language, sdh, chunk_no) group by rollup (u.language))
        select language, units, delivered, delivered / units as rate, delivered / units >= 0.3 as accepted, case when delivered = units then 'success' when delivered / units >= 0.3 then 'partial_success' else 'failed' end as status from r"""),
    "short_coverage": (short_coverage, f"with {X.CHUNK_CUES} select media_id, language, sdh, chunk_no, max(end_ms)::bigint as last_end_ms, count(*) as cues from chunk_cues group by 1, 2, 3, 4 having max(end_ms) < 30000"),
    "best_attempt": (best_attempt, f"""with {X.ATTEMPTS} select unit, attempt, score from attempts where attempt < 3 and score > 0
        qualify row_number() over (partition by unit order by score >= 95 desc, case when score >= 95 then -attempt else score end desc, attempt) = 1"""),
    "method_preference": (method_preference, f"with {X.ATTEMPTS} select unit, attempt, method, score from attempts qualify row_number() over (partition by unit order by case method when 'direct' then 0 else 1 end, attempt) = 1"),
    "context_window": (context_window, f"""with {X.CUES}, c as (select media_id, language, sdh, seq, coalesce(array_to_string(list(substr(text, 1, 100)) over (partition by media_id, language, sdh order by seq rows between 3 preceding and 1 preceding), ' | '), '') as context from cues)
        select media_id, language, sdh, seq, length(context)::int as n, md5(context) as context_md5 from c"""),
    "batch_summary": (batch_summary, f"""with {LATEST}, f as (select job_id, min(updated_us) as created_us from job_states group by 1),
        jobs as (select *, case stage when 11 then 'completed' when -1 then 'failed' else 'in_progress' end as status from latest join f using (job_id))
        select status, count(*) as jobs, sum(updated_us - created_us)::bigint as value from jobs group by 1
        union all (select 'newest ' || status, 1, updated_us from jobs order by updated_us desc, job_id limit 20)"""),
}
