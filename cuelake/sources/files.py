"""Media inventories, logs and job records from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()), T.StructField("level", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("module", T.StringType()), T.StructField("function", T.StringType()), T.StructField("line_number", T.IntegerType()),
    T.StructField("job_id", T.StringType()), T.StructField("user_id", T.StringType()), T.StructField("duration_ms", T.DoubleType()),
    T.StructField("memory_mb", T.DoubleType()), T.StructField("error_type", T.StringType()), T.StructField("error_code", T.StringType()),
    T.StructField("context", T.MapType(T.StringType(), T.StringType())), T.StructField("_corrupt_record", T.StringType()),
])
JOB_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("video_path", T.StringType()), T.StructField("languages", T.ArrayType(T.StringType())),
    T.StructField("current_stage", T.IntegerType()), T.StructField("created_at", T.DoubleType()), T.StructField("updated_at", T.DoubleType()),
    T.StructField("completed_at", T.DoubleType()), T.StructField("error_message", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
FORMATS = ("mp4", "avi", "mkv", "mov", "webm", "flv", "wmv")


def media_inventory(spark: SparkSession, path: str, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """Media files below a folder by extension in either case: path, name, format, size_bytes, modified. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return found.withColumn("format", extension).where(F.col("format").isin(*formats)).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))


def log_ingest(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON-lines logs with an explicit schema; lines that are not JSON stand in _corrupt_record."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(LOG_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def parse_log_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """As log_ingest, for lines in a column; the other columns are kept."""
    parsed = F.from_json(F.col(line_col), LOG_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.withColumn("_p", parsed).select(*[c for c in lines.columns if c != line_col], "_p.*")


def parse_job_states(documents: DataFrame, body_col: str = "body") -> DataFrame:
    """As job_state_ingest, for documents in a column; the other columns are kept."""
    keep = [c for c in documents.columns if c != body_col]
    parsed = documents.withColumn("_p", F.from_json(F.col(body_col), JOB_SCHEMA)).where("_p.job_id is not null")
    return _jobs(parsed.select(*keep, "_p.*"), keep)


def _jobs(raw: DataFrame, keep: list[str]) -> DataFrame:
    stamp = lambda c: F.timestamp_seconds(F.col(c))
    return raw.select(*keep, "job_id", F.col("video_path").alias("media"), "languages", F.col("current_stage").alias("stage"), stamp("created_at").alias("created_at"), stamp("updated_at").alias("updated_at"), stamp("completed_at").alias("completed_at"), F.col("error_message").alias("error"), "metadata")


def job_state_ingest(spark: SparkSession, path: str) -> DataFrame:
    """Job records (job_*.json, one document a file); unreadable ones are skipped, backups are not read."""
    raw = spark.read.schema(JOB_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "job_*.json").json(path)
    return _jobs(raw.where("job_id is not null"), [])
