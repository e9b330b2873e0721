"""Input tables that the registered queries derive from the star-schema, text and event tables, in Spark and, word for word the
same, as DuckDB common table expressions. They stand in for a library of subtitle files, audio frames and job records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

WORD = r"[\p{L}\p{N}_]+"


def rounded(c: str | Column, digits: int = 6) -> Column:
    """A double rounded as DuckDB does it: scaled, to a whole number, and back. Spark's round goes by the shortest decimal form instead, so
    0.0640625, whose millionfold is 64062.49999999999, would come out one higher."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 10.0**digits, 0) / 10.0**digits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Documents of less than a scan partition, which one row group may hold, are dealt to all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "documents" and int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 128 << 20:
        return df.repartition(spark.sparkContext.defaultParallelism, "doc_id")
    return df


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of its files; as a pattern, the name may be that of a file or of a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def cues(spark: SparkSession, sf_dir: str, read: Callable = table) -> DataFrame:
    """One cue for each non-blank line of a document. Four documents in a row are the files of a medium: regular and SDH, in English and in
    one or two other languages."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    lines = d.select("doc_id", "lang", F.posexplode_outer(F.expr(r"filter(split(text, '\n'), x -> trim(x) <> '')")).alias("pos", "text")).where("text is not null")
    n = F.char_length("text").cast("long")
    start = (F.col("pos") * 3000 + F.col("doc_id") % 7 * 100).cast("long")
    return lines.select(
        F.expr("doc_id div 4").alias("media_id"), F.expr("case when doc_id % 4 < 2 then 'eng' when lang = 'en' then 'fr' else lang end").alias("language"), (F.col("doc_id") % 2 == 1).alias("sdh"),
        (F.col("pos") + 1).cast("int").alias("seq"), start.alias("start_ms"), (start + 400 + n * 53 % 4200).alias("end_ms"), "text",
    )


CUES = r"""
lines0 as (select doc_id, lang, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) as text, unnest(range(1, 1 + len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))) as seq from documents where text is not null),
cues as (select doc_id // 4 as media_id, case when doc_id % 4 < 2 then 'eng' when lang = 'en' then 'fr' else lang end as language, doc_id % 2 = 1 as sdh, seq::int as seq,
  ((seq - 1) * 3000 + doc_id % 7 * 100)::bigint as start_ms, ((seq - 1) * 3000 + doc_id % 7 * 100 + 400 + length(text) * 53 % 4200)::bigint as end_ms, text from lines0)"""


def lined_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues with a line break after each comma."""
    return cues(spark, sf_dir).withColumn("text", F.replace("text", F.lit(", "), F.lit(",\n")))


LINED = CUES + r""",
lined as (select media_id, language, sdh, seq, start_ms, end_ms, replace(text, ', ', ',' || chr(10)) as text from cues)"""


def chunk_cues(spark: SparkSession, sf_dir: str, read: Callable = table) -> DataFrame:
    """Cues with times from the start of their minute."""
    c = cues(spark, sf_dir, read).withColumn("chunk_no", F.expr("int(start_ms div 60000)"))
    return c.withColumn("start_ms", F.expr("start_ms - chunk_no * 60000L")).withColumn("end_ms", F.expr("end_ms - chunk_no * 60000L"))


CHUNK_CUES = CUES + """,
chunk_cues as (select media_id, language, sdh, (start_ms // 60000)::int as chunk_no, seq, start_ms % 60000 as start_ms, end_ms - (start_ms // 60000) * 60000 as end_ms, text from cues)"""


def pairs(spark: SparkSession, sf_dir: str, mapped: bool = False) -> DataFrame:
    """A reference text, a hypothesis without every seventh word, and a back-translation without every eleventh. A medium has a pair in each
    of two target languages; ``mapped``: from Hindi and from Bengali into English, which have least scores."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    cut = lambda n: F.expr(f"array_join(filter(split(text, ' '), (w, i) -> i % {n} <> 0), ' ')")
    src, tgt = ("case when doc_id % 2 = 0 then 'hi' else 'bn' end", "'en'") if mapped else ("'en'", "case when doc_id % 2 = 0 then lang else 'it' end")
    return d.select(F.expr("doc_id div 2").alias("media_id"), F.expr(src).alias("src_lang"), F.expr(tgt).alias("tgt_lang"), F.col("text").alias("ref"), cut(7).alias("hyp"), cut(11).alias("back"))


PAIRS = """
pairs as (select doc_id // 2 as media_id, 'en' as src_lang, case when doc_id % 2 = 0 then lang else 'it' end as tgt_lang, text as ref, array_to_string(list_filter(string_split(text, ' '), lambda w, i: i % 7 <> 1), ' ') as hyp,
  array_to_string(list_filter(string_split(text, ' '), lambda w, i: i % 11 <> 1), ' ') as back from documents where text is not null)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio frames every 200 ms from a user's events."""
    e = table(spark, sf_dir, "events")
    no = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("media_id"), (no * 200).cast("long").alias("t_ms"), (F.col("value") / 500).alias("rms"), (F.col("event_id") * 37 % 100 / 100).alias("zcr"), (F.col("event_id") * 91 % 1000).cast("double").alias("centroid"))


FRAMES = """
frames as (select user_id as media_id, ((row_number() over (partition by user_id order by ts, event_id) - 1) * 200)::bigint as t_ms, value / 500 as rms, (event_id * 37 % 100) / 100 as zcr, (event_id * 91 % 1000)::double as centroid from events)"""


def speaker_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") % 20).alias("media_id"), (F.col("vec_id") * 1000).alias("start_ms"), (F.col("vec_id") * 1000 + 700).alias("end_ms"), F.col("label").alias("speaker_id"), F.col("embedding").cast("array<double>").alias("features"))


SEGMENTS = """
segments as (select vec_id % 20 as media_id, vec_id * 1000 as start_ms, vec_id * 1000 + 700 as end_ms, label as speaker_id, embedding::double[] as features from embeddings)"""


def visual_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.expr("case event_type when 'click' then 'scene' when 'view' then 'appearance' else 'motion' end")
    return e.select(F.col("user_id").alias("media_id"), kind.alias("kind"), (F.col("event_id") * 137 % 30000).alias("t_ms"))


VISUAL = """
visual as (select user_id as media_id, case event_type when 'click' then 'scene' when 'view' then 'appearance' else 'motion' end as kind, event_id * 137 % 30000 as t_ms from events)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_cues(spark, sf_dir).select("media_id", "language", "sdh", "chunk_no").distinct()


UNITS = CHUNK_CUES + """,
units as (select distinct media_id, language, sdh, chunk_no from chunk_cues)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered files of units: some missing, some delivered twice, and a VTT twin that is not merged."""
    u = units(spark, sf_dir).where("(media_id + chunk_no + int(sdh)) % 5 <> 0")
    copies = F.explode(F.expr("case when media_id % 3 = 0 then array(named_struct('modified', 2L, 'format', 'srt'), named_struct('modified', 1L, 'format', 'srt'), named_struct('modified', 3L, 'format', 'vtt')) else array(named_struct('modified', 2L, 'format', 'srt'), named_struct('modified', 3L, 'format', 'vtt')) end"))
    return u.select("media_id", "language", "sdh", "chunk_no", copies.alias("x")).select("media_id", "language", "sdh", "chunk_no", "x.modified", "x.format")


FILES = UNITS + """,
files as (select media_id, language, sdh, chunk_no, modified, format from units, (values (2::bigint, 'srt', 1), (1, 'srt', 3), (3, 'vtt', 1)) v(modified, format, m)
  where (media_id + chunk_no + sdh::int) % 5 <> 0 and media_id % m = 0)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("unit"), F.col("turn").alias("attempt"), (F.char_length("text").cast("long") * 7 % 101).alias("score"), F.expr("case when turn % 2 = 0 then 'direct' else 'translate' end").alias("method"))


ATTEMPTS = """
attempts as (select conv_id as unit, turn as attempt, length(text) * 7 % 101 as score, case when turn % 2 = 0 then 'direct' else 'translate' end as method from conversations)"""


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("job_id"), (F.col("event_id") * 7 % 13 - 1).cast("int").alias("stage"), F.unix_micros(F.col("ts").cast("timestamp")).alias("updated_us"), "event_id")


JOB_STATES = """
job_states as (select user_id as job_id, (event_id * 7 % 13 - 1)::int as stage, epoch_us(ts) as updated_us, event_id from events)"""


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    ext = F.expr("element_at(array('.mp4', '.MKV', '.avi', '.mov', '.webm', '.txt', '.wmv', '.flv'), int(page_id % 8) + 1)")
    return p.select(F.col("page_id").alias("media_id"), F.concat("url", F.when(F.col("page_id") % 11 == 0, "/../x").otherwise(""), ext).alias("path"), (F.char_length("html").cast("long") * (F.col("page_id") % 50) * 1000).alias("size_bytes"), (F.col("page_id") * 977 % 50000 * 1000).alias("duration_ms"), (F.col("page_id") % 3).cast("int").alias("video_streams"))


MEDIA = """
media as (select page_id as media_id, url || case when page_id % 11 = 0 then '/../x' else '' end || ['.mp4', '.MKV', '.avi', '.mov', '.webm', '.txt', '.wmv', '.flv'][page_id % 8 + 1] as path,
  length(html) * (page_id % 50) * 1000 as size_bytes, page_id * 977 % 50000 * 1000 as duration_ms, (page_id % 3)::int as video_streams from pages)"""


def logs(spark: SparkSession, sf_dir: str, read: Callable = table) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.expr("element_at(array('ConnectionError', 'ValidationError', 'QuotaExceeded', 'TimeoutError'), int(event_id % 4) + 1)")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("operation"), F.col("value").alias("duration_ms"), F.col("user_id").alias("job_id"), F.expr("case when event_type = 'error' then 'ERROR' else 'INFO' end").alias("level"), F.when(F.col("event_type") == "error", kind).alias("error_type"), F.concat(F.lit("step "), F.expr("case when event_id % 3 = 0 then 'rate limit hit' else 'bad input' end")).alias("message"))


LOGS = """
logs as (select event_id, ts, event_type as operation, value as duration_ms, user_id as job_id, case when event_type = 'error' then 'ERROR' else 'INFO' end as level,
  case when event_type = 'error' then ['ConnectionError', 'ValidationError', 'QuotaExceeded', 'TimeoutError'][event_id % 4 + 1] end as error_type, 'step ' || case when event_id % 3 = 0 then 'rate limit hit' else 'bad input' end as message from events)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service calls seven seconds apart for each user."""
    e = table(spark, sf_dir, "events")
    no = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("host"), F.col("event_type").alias("service"), (no * 7).cast("long").alias("t_s"), (F.col("event_type") != "error").alias("ok"), "event_id", "value")


CALLS = """
calls as (select user_id as host, event_type as service, (row_number() over (partition by user_id order by ts, event_id) * 7)::bigint as t_s, event_type <> 'error' as ok, event_id, value from events)"""


def health_samples(spark: SparkSession, sf_dir: str, read: Callable = table) -> DataFrame:
    e = read(spark, sf_dir, "events")
    metric = F.expr("element_at(array('disk_free_gb', 'rss_mb', 'temp_mb'), int(event_id % 3) + 1)")
    value = F.expr("case event_id % 3 when 0 then value / 20 when 1 then value * 20 else value * 8 end")
    return e.select(F.col("user_id").alias("host"), "event_id", F.col("ts").cast("timestamp").alias("ts"), metric.alias("metric"), value.alias("value"))


HEALTH = """
health as (select user_id as host, event_id, ts, ['disk_free_gb', 'rss_mb', 'temp_mb'][event_id % 3 + 1] as metric, case event_id % 3 when 0 then value / 20 when 1 then value * 20 else value * 8 end as value from events)"""


def retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("item"), (F.unix_micros(F.col("ts").cast("timestamp")) + 30_000_000).alias("retry_after_us"), (F.col("event_id") % 5).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"))


RETRIES = """
retries as (select event_id as item, epoch_us(ts) + 30000000 as retry_after_us, (event_id % 5)::int as attempts, 3 as max_attempts from events)"""


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    return e.select((v % 20).alias("media_id"), F.expr("vec_id div 3 * 250").alias("t_ms"), (v * 13 % 600).alias("x"), (v * 29 % 440).alias("y"), (40 + v % 90).alias("w"), (40 + v % 70).alias("h"), v.alias("face_id"))


FACES = """
faces as (select vec_id % 20 as media_id, vec_id // 3 * 250 as t_ms, vec_id * 13 % 600 as x, vec_id * 29 % 440 as y, 40 + vec_id % 90 as w, 40 + vec_id % 70 as h, vec_id as face_id from embeddings)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues(spark, sf_dir).where("seq % 10 <> 0").withColumn("end_ms", F.col("end_ms") + 250)


VERSIONS = CUES + """,
versions as (select media_id, language, sdh, seq, start_ms, end_ms + 250 as end_ms, text from cues where seq % 10 <> 0)"""

Query = Callable[[SparkSession, str], DataFrame]
