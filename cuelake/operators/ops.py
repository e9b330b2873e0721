"""Operational tables: timers, errors, counters, health, call rates, retries, failures and the funnel of job stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake import dims

#: Calls a minute of each service.
QUOTAS = [("generate", 30), ("storage", 100), ("translate", 60)]
#: Error type, whether a retry helps, and what to do instead.
FAILURES = [
    ("NetworkError", True, "retry_later"), ("CloudStorageError", True, "retry_later"), ("QuotaExceededError", True, "skip"), ("RetryableError", True, "retry_later"), ("ConfigurationError", False, "fail"),
    ("ValidationError", False, "fail"), ("AuthenticationError", False, "skip"), ("NonRetryableError", False, "fail"), ("VertexAIError", False, "use_alternative"),
]
#: Parts of messages that speak for a retry.
RETRYABLE = ["timeout", "connection", "network", "temporary", "rate limit", "quota", "throttle", "busy", "unavailable", "service error", "502", "503", "504"]
#: Metric, least for critical, least for warning, most for warning, most for critical.
LIMITS = [("disk_free_gb", 1.0, 5.0, None, None), ("disk_used_pct", None, None, 90.0, None), ("rss_mb", None, None, 4096.0, 6144.0), ("rss_pct", None, None, 80.0, None), ("temp_mb", None, None, 1024.0, 2048.0), ("temp_files", None, None, 1000.0, None)]
SEVERITY = ("healthy", "warning", "critical")


def operation_timers(logs: DataFrame, *more: str) -> DataFrame:
    d = F.col("duration_ms")
    return logs.groupBy(*more, "operation").agg(F.count(d).alias("calls"), F.sum(d).alias("total_ms"), F.avg(d).alias("mean_ms"), F.min(d).alias("min_ms"), F.max(d).alias("max_ms"))


def error_summary(logs: DataFrame) -> DataFrame:
    """Errors by type and in all (error_type null), with the time of the last."""
    e = logs.where("level in ('ERROR', 'CRITICAL')").withColumn("error_type", F.coalesce("error_type", F.lit("unknown")))
    return e.rollup("error_type").agg(F.count("*").alias("errors"), F.max(F.unix_micros("ts")).alias("last_us"))


def event_counters(logs: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """Adds the number of events of the same operation so far. Events are numbered within hours, and hours start from the totals of
    the hours before, so that an operation with most of the events is not one task."""
    b = F.floor(F.unix_seconds("ts") / bucket_s)
    rows = logs.withColumn("_b", b)
    sums = rows.groupBy("operation", "_b").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("operation").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select("operation", "_b", before.alias("_base"))
    within = F.row_number().over(Window.partitionBy("operation", "_b").orderBy("ts", "event_id"))
    return rows.withColumn("_n", within).join(base, ["operation", "_b"]).withColumn("counter", F.col("_base") + F.col("_n")).drop("_b", "_n", "_base")


def severity(limits: list[tuple] = LIMITS, metric: str = "metric", value: str = "value") -> Column:
    """0 healthy, 1 warning, 2 critical of a sample; metrics without limits are warnings."""
    m, v = F.col(metric), F.col(value)
    out = F.when(v.isNull(), 1)
    for name, low2, low1, high1, high2 in limits:
        is_it = m == name
        for level, test in ((2, v < low2 if low2 is not None else None), (2, v > high2 if high2 is not None else None), (1, v < low1 if low1 is not None else None), (1, v > high1 if high1 is not None else None)):
            if test is not None:
                out = out.when(is_it & test, level)
        out = out.when(is_it, 0)
    return out.otherwise(1)


def named(level: Column) -> Column:
    return F.when(level == 2, SEVERITY[2]).when(level == 1, SEVERITY[1]).otherwise(SEVERITY[0])


def health_rollup(samples: DataFrame, limits: list[tuple] = LIMITS) -> DataFrame:
    """Per host: worst status, samples by status, and the metrics that were not healthy."""
    s = samples.withColumn("_s", severity(limits))
    return s.groupBy("host").agg(named(F.max("_s")).alias("status"), *[F.count(F.when(F.col("_s") == k, 1)).alias(n) for k, n in enumerate(SEVERITY)], F.array_join(F.array_sort(F.collect_set(F.when(F.col("_s") > 0, F.concat("metric", F.lit(":"), named(F.col("_s")))))), ",").alias("issues"))


def call_rate(calls: DataFrame, quotas: DataFrame, keys: tuple[str, ...] = ("service",), window_s: int = 60, bucket_s: int = 3600) -> DataFrame:
    """Calls in the ``window_s`` seconds up to each call (the call itself counts), over quota or not, and the seconds to wait until the
    oldest of them has left the window. Calls are counted within buckets of ``bucket_s`` seconds (at least a window), to which those of
    the last window before are lent, so that a busy service is not one task."""
    size = max(bucket_s, window_s)
    own = F.floor(F.col("t_s") / size)
    lent = F.when(F.col("t_s") > (own + 1) * size - window_s, F.array(own, own + 1)).otherwise(F.array(own))
    rows = calls.withColumn("_own", own).withColumn("_b", F.explode(lent))
    w = Window.partitionBy(*keys, "_b").orderBy("t_s").rangeBetween(-(window_s - 1), 0)
    x = rows.withColumn("recent", F.count("*").over(w)).withColumn("_first", F.min("t_s").over(w)).where("_b = _own").drop("_b", "_own").join(quotas, "service", "left")
    over = F.col("recent") > F.col("quota")
    return x.withColumn("over", F.coalesce(over, F.lit(False))).withColumn("wait_s", F.when(over, F.col("_first") + window_s - F.col("t_s")).otherwise(0)).drop("_first")


def due_retries(queue: DataFrame, now_us: int) -> DataFrame:
    state = F.when(F.col("attempts") >= F.col("max_attempts"), "exhausted").when(F.col("retry_after_us") <= now_us, "ready").otherwise("waiting")
    return queue.withColumn("state", state)


def classify_failures(logs: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Errors with retryable and action: by type, else by the message."""
    dim = dim if dim is not None else dims.frame(logs.sparkSession, FAILURES, "error_type, known_retry, known_action")
    e = logs.where("level in ('ERROR', 'CRITICAL')").join(dim, "error_type", "left")
    text = F.lower(F.coalesce("message", F.lit("")))
    says = F.exists(F.array(*map(F.lit, RETRYABLE)), lambda p: text.contains(p))
    action = F.when(text.contains("quota") | text.contains("rate limit"), "skip").when(text.contains("permission") | text.contains("access"), "skip").when(text.contains("safety") | text.contains("blocked"), "skip").otherwise(F.when(says, "retry_later").otherwise("use_alternative"))
    return e.withColumn("retryable", F.coalesce("known_retry", says)).withColumn("action", F.coalesce("known_action", action)).drop("known_retry", "known_action")


def stage_funnel(states: DataFrame, stages: int = 12) -> DataFrame:
    """For each stage: jobs that reached it or a later one, and jobs whose last state is a failure after having reached it last."""
    best = states.where("stage >= 0").groupBy("job_id").agg(F.max("stage").alias("reached"))
    last = states.groupBy("job_id").agg(F.max(F.struct("updated_us", "event_id", "stage")).alias("_m")).select("job_id", (F.col("_m.stage") == -1).alias("failed"))
    at = best.join(last, "job_id").groupBy("reached").agg(F.count("*").alias("n"), F.count(F.when(F.col("failed"), 1)).alias("failed"))
    every = states.sparkSession.range(stages).select(F.col("id").cast("int").alias("stage"))
    # a dozen rows on either side
    return every.join(F.broadcast(at), F.col("reached") >= F.col("stage"), "left").groupBy("stage").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("jobs"), F.coalesce(F.sum(F.when(F.col("reached") == F.col("stage"), F.col("failed"))), F.lit(0)).alias("failed"))
