"""Queries on operational tables, and streams run over what the tables hold, each with the same in DuckDB SQL."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from cuelake import dims
from cuelake.functions.scratch import scratch
from cuelake.operators import ops as L
from cuelake.sources import files
from cuelake.streaming import streams as S

from . import fixtures as X

R = lambda c: X.rounded(c).alias(c)
NOW = 1_704_500_000_000_000
_HEALTH = "case metric when 'disk_free_gb' then case when value < 1 then 2 when value < 5 then 1 else 0 end when 'rss_mb' then case when value > 6144 then 2 when value > 4096 then 1 else 0 end else case when value > 2048 then 2 when value > 1024 then 1 else 0 end end"
_NAME = lambda c: f"case {c} when 2 then 'critical' when 1 then 'warning' else 'healthy' end"
_FAIL = ", ".join(f"('{a}', {str(b).lower()}, '{c}')" for a, b, c in L.FAILURES)
_SAYS = " or ".join(f"contains(message, '{p}')" for p in L.RETRYABLE)


def _quotas(spark, n: int):
    return dims.frame(spark, [(s, n) for s in ("signup", "purchase", "error", "view", "click")], "service, quota")


def operation_timers(spark, d):
    return L.operation_timers(X.logs(spark, d)).select("operation", "calls", R("total_ms"), R("mean_ms"), "min_ms", "max_ms")


def error_summary(spark, d):
    return L.error_summary(X.logs(spark, d))


def event_counters(spark, d):
    return L.event_counters(X.logs(spark, d)).select("event_id", "operation", "counter")


def health_rollup(spark, d):
    return L.health_rollup(X.health_samples(spark, d))


def call_rate(spark, d):
    return L.call_rate(X.calls(spark, d), _quotas(spark, 30)).select("event_id", "host", "service", "t_s", "recent", "over", "wait_s")


def due_retries(spark, d):
    return L.due_retries(X.retry_queue(spark, d), NOW).select("item", "state")


def failure_classes(spark, d):
    logs = X.logs(spark, d).withColumn("error_type", F.when(F.col("error_type") == "QuotaExceeded", "QuotaExceededError").otherwise(F.col("error_type")))
    return L.classify_failures(logs).select("event_id", "error_type", "retryable", "action")


def stage_funnel(spark, d):
    return L.stage_funnel(X.job_states(spark, d)).select("stage", "jobs", "failed")


def log_ingest(spark, d):
    """Log lines written as JSON, every fiftieth broken off, and read back."""
    logs = X.logs(spark, d)
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "level", "message", F.col("job_id").cast("string").alias("job_id"), "duration_ms", "error_type", F.create_map(F.lit("operation"), F.col("operation")).alias("context")))
    lines = logs.select("event_id", line.alias("line")).withColumn("line", F.when(F.col("event_id") % 50 == 0, F.substring("line", 1, 30)).otherwise(F.col("line")))
    path = scratch(spark)
    lines.select("line").write.text(path)
    p = files.log_ingest(spark, path)
    return p.groupBy(F.col("context")["operation"].alias("operation")).agg(F.count("*").alias("lines"), F.count("_corrupt_record").alias("corrupt"), F.count("error_type").alias("errors"), X.rounded(F.sum("duration_ms")).alias("total_ms"), F.max(F.unix_micros("timestamp")).alias("last_us"))


def job_state_ingest(spark, d):
    """Job documents written as JSON, every thirtieth without a job, and read back."""
    j = X.job_states(spark, d)
    body = F.to_json(F.struct(F.when(F.col("event_id") % 30 != 0, F.concat(F.lit("j"), F.col("job_id").cast("string"))).alias("job_id"), F.lit("v.mp4").alias("video_path"), F.array(F.lit("eng"), F.lit("hin")).alias("languages"), F.col("stage").alias("current_stage"), F.expr("updated_us div 1000000").cast("double").alias("updated_at")))
    p = files.parse_job_states(j.select(body.alias("body")))
    return p.groupBy("job_id").agg(F.count("*").alias("states"), F.sum("stage").alias("stages"), F.max(F.unix_seconds("updated_at")).alias("last_s"), F.max(F.size("languages")).alias("languages"))


def media_inventory(spark, d):
    """Addresses written as one folder of text files for each format, listed again by their folder."""
    path = scratch(spark)
    X.media(spark, d).select(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("kind"), "path").write.partitionBy("kind").text(path)
    found = files.media_inventory(spark, path, formats=("txt",))
    return found.where("format = 'txt' and name like 'part-%'").groupBy(F.regexp_extract("path", "kind=([^/]*)", 1).alias("kind")).agg(F.sum("size_bytes").alias("bytes"), F.count_distinct("format").alias("formats"))


@contextmanager
def _rocks(spark):
    """State of own operators needs the RocksDB store. A batch opens and commits the store of every shuffle partition, with rows or
    without, so there are no more of them than cores: what a place holds at a time does not depend on their number."""
    name, parts = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    before = {c: spark.conf.get(c, None) for c in (name, parts)}
    spark.conf.set(name, S.PROVIDER)
    spark.conf.set(parts, min(int(spark.conf.get(parts)), max(4, spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        for c, value in before.items():
            spark.conf.set(c, value) if value else spark.conf.unset(c)


def stream_timers(spark, d):
    t = S.as_table(S.stream_timers(X.logs(spark, d, X.arriving)), ("window_start", "operation"), "update")
    return t.select(F.unix_seconds("window_start").alias("window_s"), "operation", "calls", R("total_ms"), R("mean_ms"), "min_ms", "max_ms")


def stream_call_rate(spark, d):
    calls = X.arriving(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("service"))
    r = S.as_table(S.stream_call_rate(calls, _quotas(spark, 1)), ("window_start", "service"), "update")
    return r.groupBy("service", "calls", "over").agg(F.count("*").alias("windows"), F.sum(F.unix_seconds("window_start") % 100000).alias("starts"))


def _services(events):
    return events.select(F.col("event_type").alias("service"), (F.col("event_id") * 7 + 7).alias("t_s"), (F.col("value") < 60).alias("ok"))


def failure_streak(spark, d):
    return S.failure_streak(_services(X.table(spark, d, "events")))


def _out_of_order(rows, key: str, parts: int = 4):
    """Rows (with ts) as a stream of files in which every fifth row comes a quarter of the time later than it should, how many seconds the
    stream has to wait for them, and the seconds of its stretches. A last row of a key of its own, far ahead, lets the watermark pass all others."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    first, last = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    step = max(1, ((last or 0) - (first or 0)) // parts + 1)
    part = F.least(F.lit(parts - 1), F.expr(f"int((unix_micros(ts) - {first or 0}) div {step})") + F.when(F.pmod(F.xxhash64(*rows.columns), F.lit(5)) == 0, 1).otherwise(0))
    for k in range(parts):
        rows.where(part == k).write.parquet(f"{path}/{k}")
    rows.limit(1).withColumn(key, F.lit("~").cast(dict(rows.dtypes)[key])).withColumn("ts", F.timestamp_micros(F.lit((last or 0) + 3 * step + 3_600_000_000))).coalesce(1).write.parquet(f"{path}/{parts}")
    many = max(1, -(-len(spark.read.parquet(f"{path}/*").inputFiles()) // (parts + 1)))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", many).parquet(f"{path}/*")
    late = 2 * step // 1_000_000 + 61
    return stream, f"{late} seconds", max(60, late // 10)


def stream_failure_streak(spark, d):
    calls = _services(X.table(spark, d, "events")).withColumn("ts", F.timestamp_seconds("t_s"))
    stream, late, hold = _out_of_order(calls, "service")
    with _rocks(spark):
        return S.as_table(S.stream_failure_streak(stream.withColumn("t_s", F.unix_seconds("ts")), late, hold))


def health_changes(spark, d):
    return S.health_changes(X.health_samples(spark, d))


def stream_health(spark, d):
    samples = X.health_samples(spark, d).withColumn("host", F.col("host").cast("string")).select("host", "ts", "metric", "value", "event_id")
    stream, late, hold = _out_of_order(samples, "host")
    with _rocks(spark):
        return S.as_table(S.stream_health(stream, late, hold))


def stream_merge(spark, d):
    """Deliveries of every chunk, for some media an older one of other text beside it, merged by the stream."""
    c = X.chunk_cues(spark, d, X.arriving)
    new, old = F.struct(F.lit(20).alias("s"), "text"), F.struct(F.lit(10).alias("s"), F.lit("old").alias("text"))
    both = c.withColumn("_v", F.explode(F.when(F.col("media_id") % 3 == 0, F.array(old, new)).otherwise(F.array(new))))
    arrivals = both.select("media_id", "language", "sdh", "chunk_no", "seq", "start_ms", "end_ms", F.col("_v.text").alias("text"), F.timestamp_seconds("_v.s").alias("modified"))
    path = scratch(spark)
    S.stream_merge(arrivals, f"{path}/table", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return S.merged_cues(spark, f"{path}/table").groupBy("media_id", "language", "sdh").agg(F.max("seq").alias("cues"), F.max("end_ms").alias("last_ms"), F.sum(F.char_length("text")).alias("chars"))


#: Breaker states by islands of calls since the last success.
STREAKS = f"""with n as (select event_type as service, event_id * 7 + 7 as t_s, value < 60 as ok, row_number() over (partition by event_type order by event_id) as n from events),
        s as (select *, n - coalesce(max(case when ok then n end) over (partition by service order by n rows unbounded preceding), 0) as failures, t_s - lag(t_s) over (partition by service order by n) as waited from n),
        r as (select *, coalesce(lag(failures) over (partition by service order by n), 0) as met from s)
        select service, t_s, ok, case when met < {S.OPEN_AFTER} then 'CLOSED' when waited >= {S.RECOVERY_S} then 'HALF_OPEN' else 'OPEN' end as state, failures from r"""
HEALTH_CHANGES = f"""with {X.HEALTH}, s as (select host::varchar as host, epoch_us(ts) as t_us, metric, {_HEALTH} as level from health),
        g as (select host, t_us, metric, level, {", ".join(f"last_value(case when metric = '{m}' then level end ignore nulls) over (partition by host order by t_us, metric, level rows unbounded preceding) as l{k}" for k, m in enumerate(("disk_free_gb", "rss_mb", "temp_mb")))} from s),
        n as (select host, t_us, greatest(l0, l1, l2) as now, lag(greatest(l0, l1, l2)) over (partition by host order by t_us, metric, level) as b from g)
        select host, t_us, case b when 2 then 'critical' when 1 then 'warning' when 0 then 'healthy' end as before, {_NAME('now')} as status from n where b is distinct from now"""

QUERIES = {
    "log_ingest": (log_ingest, f"""with {X.LOGS}, p as (select case when event_id % 50 <> 0 then operation end as operation, event_id % 50 = 0 as bad, error_type, duration_ms, ts from logs)
        select operation, count(*) as lines, count(*) filter (bad) as corrupt, count(error_type) filter (not bad) as errors, round(sum(duration_ms) filter (not bad), 6) as total_ms, max(epoch_us(ts)) filter (not bad) as last_us from p group by 1"""),
    "job_state_ingest": (job_state_ingest, f"with {X.JOB_STATES} select 'j' || job_id::varchar as job_id, count(*) as states, sum(stage)::bigint as stages, max(updated_us // 1000000) as last_s, 2 as languages from job_states where event_id % 30 <> 0 group by 1"),
    "operation_timers": (operation_timers, f"with {X.LOGS} select operation, count(duration_ms) as calls, round(sum(duration_ms), 6) as total_ms, round(avg(duration_ms), 6) as mean_ms, min(duration_ms) as min_ms, max(duration_ms) as max_ms from logs group by 1"),
    "error_summary": (error_summary, f"with {X.LOGS} select error_type, count(*) as errors, max(epoch_us(ts)) as last_us from logs where level = 'ERROR' group by rollup (error_type)"),
    "event_counters": (event_counters, f"with {X.LOGS} select event_id, operation, count(*) over (partition by operation order by ts, event_id rows unbounded preceding) as counter from logs"),
    "health_rollup": (health_rollup, f"""with {X.HEALTH}, s as (select *, {_HEALTH} as s from health) select host, {_NAME('max(s)')} as status, count(*) filter (s = 0) as healthy, count(*) filter (s = 1) as warning, count(*) filter (s = 2) as critical,
        coalesce(string_agg(distinct metric || ':' || {_NAME('s')}, ',' order by metric || ':' || {_NAME('s')}) filter (s > 0), '') as issues from s group by 1"""),
    "call_rate": (call_rate, f"with {X.CALLS}, r as (select event_id, host, service, t_s, count(*) over w as recent, min(t_s) over w as f from calls window w as (partition by service order by t_s range between 59 preceding and current row)) select event_id, host, service, t_s, recent, recent > 30 as over, case when recent > 30 then f + 60 - t_s else 0 end as wait_s from r"),
    "due_retries": (due_retries, f"with {X.RETRIES} select item, case when attempts >= max_attempts then 'exhausted' when retry_after_us <= {NOW} then 'ready' else 'waiting' end as state from retries"),
    "failure_classes": (failure_classes, f"""with {X.LOGS}, f as (select * from (values {_FAIL}) t(error_type, known_retry, known_action)), e as (select event_id, case when error_type = 'QuotaExceeded' then 'QuotaExceededError' else error_type end as error_type, lower(message) as message from logs where level = 'ERROR'),
        c as (select event_id, error_type, coalesce(known_retry, {_SAYS}) as retryable, coalesce(known_action, case when contains(message, 'quota') or contains(message, 'rate limit') then 'skip' when contains(message, 'permission') or contains(message, 'access') then 'skip' when {_SAYS} then 'retry_later' else 'use_alternative' end) as action from e left join f using (error_type))
        select event_id, error_type, retryable, action from c"""),
    "stage_funnel": (stage_funnel, f"""with {X.JOB_STATES}, b as (select job_id, max(stage) as reached from job_states where stage >= 0 group by 1), l as (select job_id, stage = -1 as failed from job_states qualify row_number() over (partition by job_id order by updated_us desc, event_id desc) = 1), j as (select * from b join l using (job_id))
        select s::int as stage, count(reached) as jobs, count(*) filter (reached = s and failed) as failed from unnest(range(12)) u(s) left join j on reached >= s group by 1"""),
    "stream_timers": (stream_timers, f"with {X.LOGS} select (epoch_us(ts) // 300000000 * 300)::bigint as window_s, operation, count(*) as calls, round(sum(duration_ms), 6) as total_ms, round(avg(duration_ms), 6) as mean_ms, min(duration_ms) as min_ms, max(duration_ms) as max_ms from logs group by 1, 2"),
    "stream_call_rate": (stream_call_rate, """with w as (select event_type as service, (epoch_us(ts) // 10000000 - k) * 10 as s from events, unnest(range(6)) u(k)), c as (select service, s, count(*) as calls from w group by 1, 2)
        select service, calls, calls > 1 as over, count(*) as windows, sum(s % 100000)::bigint as starts from c group by 1, 2, 3"""),
    "failure_streak": (failure_streak, STREAKS),
    "stream_failure_streak": (stream_failure_streak, STREAKS),
    "health_changes": (health_changes, HEALTH_CHANGES),
    "stream_health": (stream_health, HEALTH_CHANGES),
    "media_inventory": (media_inventory, f"with {X.MEDIA} select regexp_extract(lower(path), '[.]([^./]+)$', 1) as kind, sum(strlen(path) + 1)::bigint as bytes, 1::bigint as formats from media group by 1"),
    "stream_merge": (stream_merge, f"with {X.CUES} select media_id, language, sdh, max(seq) as cues, max(end_ms) as last_ms, sum(length(text))::bigint as chars from cues group by 1, 2, 3"),
}
