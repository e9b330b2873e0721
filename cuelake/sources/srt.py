"""Subtitle files as tables: reading SRT (lenient and strict), repairing model responses, and writing SRT and WebVTT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.dims import FILE_KEYS
from cuelake.functions.text import clock

TIME = r"(\d+):(\d{1,2}):(\d{1,2})[,.](\d{1,3})"
PLAIN_TIME = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})"
#: Two digits of hours: strict files end before 100 hours.
STRICT_TIME = r"(\d{2}):(\d{2}):(\d{2}),(\d{3})"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path, content, modified."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.srt").load(path)
    return files.select("path", F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("modified"))


def _ms(line: Column, pattern: str, first: int) -> Column:
    part = lambda k: F.regexp_extract(line, pattern, first + k).cast("long")
    fraction = F.rpad(F.regexp_extract(line, pattern, first + 3), 3, "0").cast("long")
    return ((part(0) * 60 + part(1)) * 60 + part(2)) * 1000 + fraction


def srt_ingest(files: DataFrame, mode: str = "lenient", content_col: str = "content") -> DataFrame:
    """Cues of SRT texts: the columns of files but its content, and pos, seq, start_ms, end_ms, text.

    ``lenient``: a byte-order mark is dropped, blocks are cut at blank lines, a block needs a number, a line with two times
    (comma or point, one to three digits of fraction) and text; others are skipped. ``plain``: a block needs any line, a line that
    begins with two times, and text; seq is its place among these. ``strict`` returns what the strict rules accept; see
    srt_ingest_strict."""
    if mode == "strict":
        return srt_ingest_strict(files, content_col)[0]
    if mode == "plain":
        return _plain(files, content_col)
    if mode != "lenient":
        raise ValueError("mode is lenient, plain or strict")
    keep = [c for c in files.columns if c != content_col]
    text = F.replace(F.replace(F.col(content_col), F.lit("﻿"), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    blocks = files.select(*keep, F.posexplode_outer(F.split(text, r"\n[ \t]*\n\s*")).alias("pos", "_block")).where("_block is not null")
    lines = F.split(F.regexp_replace(F.col("_block"), r"^\s+|\s+$", ""), "\n")
    pattern = rf"^\s*{TIME}\s*-->\s*{TIME}.*"
    parts = blocks.select(*keep, "pos", F.trim(lines[0]).alias("_n"), F.try_element_at(lines, F.lit(2)).alias("_t"), F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1))).alias("_l"))
    good = parts.where(F.col("_n").rlike(r"^\d{1,9}$") & F.col("_t").rlike(pattern) & (F.size("_l") > 0))
    out = good.select(*keep, "pos", F.col("_n").cast("int").alias("seq"), _ms(F.col("_t"), pattern, 1).alias("start_ms"), _ms(F.col("_t"), pattern, 5).alias("end_ms"), F.array_join("_l", "\n").alias("text"))
    return out.where(F.trim("text") != "")


def _plain(files: DataFrame, content_col: str) -> DataFrame:
    keep = [c for c in files.columns if c != content_col]
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    content = F.replace(F.col(content_col), F.lit("\r\n"), F.lit("\n"))
    pattern = rf"(?s)^[^\n]*\n{PLAIN_TIME}\s*-->\s*{PLAIN_TIME}[^\n]*\n(.*)$"
    blocks = F.filter(F.transform(F.split(trimmed(content), r"\n\s*\n"), trimmed), lambda b: b.rlike(pattern))
    rows = files.select(*keep, F.posexplode_outer(blocks).alias("pos", "_block")).where("_block is not null")
    return rows.select(*keep, "pos", (F.col("pos") + 1).alias("seq"), _ms(F.col("_block"), pattern, 1).alias("start_ms"), _ms(F.col("_block"), pattern, 5).alias("end_ms"), F.regexp_extract("_block", pattern, 9).alias("text"))


def strict_blocks(files: DataFrame, content_col: str = "content") -> DataFrame:
    """Every block of strict SRT texts with its fields and the reason why it is refused (null: accepted). Hours have two digits, so
    times from 100 hours on are refused as bad times; the lenient mode reads them."""
    keep = [c for c in files.columns if c != content_col]
    text = F.regexp_replace(F.replace(F.col(content_col), F.lit("\r\n"), F.lit("\n")), r"^\s+|\s+$", "")
    blocks = files.select(*keep, F.posexplode_outer(F.split(text, "\n\n")).alias("pos", "block")).where("block is not null and block <> ''")
    lines = F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")
    pattern = rf"^{STRICT_TIME} --> {STRICT_TIME}$"
    parts = blocks.withColumn("_l", lines).withColumn("_t", F.trim(F.coalesce(F.try_element_at("_l", F.lit(2)), F.lit(""))))
    number = F.trim(F.coalesce(F.try_element_at("_l", F.lit(1)), F.lit("")))
    reason = F.when(F.size("_l") < 3, "too few lines").when(~number.rlike(r"^\d{1,9}$"), "bad number").when(~F.col("_t").rlike(pattern), "bad times")
    fields = parts.withColumn("reason", reason).withColumn("text_lines", F.slice("_l", 3, F.greatest(F.size("_l"), F.lit(1))))
    accepted = F.col("reason").isNull()
    return fields.select(*keep, "pos", "block", "reason", F.when(accepted, number.try_cast("int")).alias("seq"), F.when(accepted, _ms(F.col("_t"), pattern, 1)).alias("start_ms"), F.when(accepted, _ms(F.col("_t"), pattern, 5)).alias("end_ms"), F.when(accepted, F.array_join("text_lines", "\n")).alias("text"))


def srt_ingest_strict(files: DataFrame, content_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """Accepted cues and refused blocks (pos, block, reason)."""
    blocks = strict_blocks(files, content_col)
    return blocks.where("reason is null").drop("block", "reason"), blocks.where("reason is not null").drop("seq", "start_ms", "end_ms", "text")


def repair_responses(responses: DataFrame, body_col: str = "body", strict_compat: bool = False) -> DataFrame:
    """Cue blocks of model responses: the columns of responses but the body, and block, seq, start_ms, end_ms, text.

    The part in a ```srt (or plain) fence is used if there is one. A line of digits followed by a line of times starts a block;
    with ``strict_compat`` only after a blank line or at the beginning. Blocks without text are dropped."""
    keep = [c for c in responses.columns if c != body_col]
    body = F.replace(F.col(body_col), F.lit("\r\n"), F.lit("\n"))
    fenced = F.regexp_extract(body, r"(?s)```(?:srt)?[ \t]*\n(.*?)(?:```|\z)", 1)
    lines = F.split(F.when(fenced != "", fenced).otherwise(body), "\n")
    times = rf"^\s*{TIME}\s*-->\s*{TIME}.*"
    starts = lambda i: F.lit(True) if not strict_compat else (i == 0) | (F.trim(F.col("_lines")[F.greatest(i - 1, F.lit(0))]) == "")
    n = F.size("_lines")
    marked = responses.select(*keep, lines.alias("_lines")).withColumn("_at", F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: (n > 1) & F.trim(F.get("_lines", i)).rlike(r"^\d{1,9}$") & F.get("_lines", i + 1).rlike(times) & starts(i)))
    blocks = marked.select(*keep, "_lines", "_at", F.posexplode_outer("_at").alias("block", "_i")).where("_i is not null")
    after = F.coalesce(F.get("_at", F.col("block") + 1), n)
    stop = blocks.withColumn("_text", F.slice("_lines", F.col("_i") + 3, F.greatest(after - F.col("_i") - 2, F.lit(0)))).withColumn("_time", F.get("_lines", F.col("_i") + 1))
    text = F.regexp_replace(F.array_join(F.filter("_text", lambda x: F.trim(x) != ""), "\n"), r"^\s+|\s+$", "")
    out = stop.select(*keep, "block", F.trim(F.get("_lines", F.col("_i"))).cast("int").alias("seq"), _ms(F.col("_time"), times, 1).alias("start_ms"), _ms(F.col("_time"), times, 5).alias("end_ms"), text.alias("text"))
    return out.where("text <> ''")


KEYS = FILE_KEYS


def _rendered(cues: DataFrame, block: Column, keys: tuple[str, ...]) -> DataFrame:
    """Blocks of each file joined in order of their number. A file's text is one row, as it is written."""
    rows = cues.select(*keys, F.struct("seq", block.alias("b")).alias("_b"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_b")), lambda x: x.b), "\n").alias("content"))


def srt_render(cues: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One SRT text for each file. Hours have two digits or, from 100 hours on, as many as they need, which only the lenient mode reads."""
    block = F.concat(F.col("seq").cast("string"), F.lit("\n"), clock("start_ms"), F.lit(" --> "), clock("end_ms"), F.lit("\n"), F.col("text"), F.lit("\n"))
    return _rendered(cues, block, keys)


def vtt_render(cues: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One WebVTT text for each file: a header, times with points, no numbers."""
    block = F.concat(clock("start_ms", "."), F.lit(" --> "), clock("end_ms", "."), F.lit("\n"), F.col("text"), F.lit("\n"))
    return _rendered(cues, block, keys).withColumn("content", F.concat(F.lit("WEBVTT\n\n"), "content"))


def write_srt(rendered: DataFrame, path: str) -> None:
    """Writes texts partitioned by language and sdh, one media a file row."""
    rendered.select("language", "sdh", "content").write.mode("overwrite").partitionBy("language", "sdh").text(path)


def output_summary(files: DataFrame, name_col: str = "name", content_col: str = "content") -> DataFrame:
    """Per media: files, bytes, and sorted names."""
    return files.groupBy("media_id").agg(F.count("*").alias("files"), F.sum(F.octet_length(content_col)).alias("bytes"), F.array_join(F.sort_array(F.collect_list(name_col)), ",").alias("names"))


