"""Shared parts: durable intermediate tables, label folds, bounded training samples, and byte-level text in numpy.

Texts reach Python in Arrow batches. ``chunks`` cuts a batch into pieces of about a megabyte, so that the working set of the
vectorised code does not depend on the batch; operators that can take a text in parts join them so that the result is that of
the whole text.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20


def tune(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that long texts do not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _folder(spark: SparkSession) -> str:
    """A new name in the shared folder of spark.checkpoint.dir. Without that setting a temporary folder serves a local master;
    a cluster, whose machines would not share it, gets an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared}/{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: no later job computes it again, a lost executor takes nothing with it, and the plan that
    reads it has neither df's lineage nor its estimates, so that loops do not grow their plans."""
    path = _folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``durable`` that nothing will read any more."""
    for t in tables:
        spark = t.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as the empty text."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names (in any case), so that results can take the names."""
    lowered = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lowered])


def sample_ids(classes: DataFrame, class_col: str, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``per_class`` ids of each class, those with the smallest id hashes: a bounded sample of labelled rows that
    does not depend on the order or partitioning of the rows, nor on how often an id is repeated. One row per id and class. Counts of
    the distinct ids of the thousand most frequent classes (a thousand rows, broadcast) first leave about twice as many of each as are
    wanted, so that ranking sees few, however frequent a class is."""
    from pyspark.sql import Window

    named = classes.where(F.col(id_col).isNotNull() & F.col(class_col).isNotNull()).select(id_col, class_col).distinct()
    named = named.withColumn("_h", F.xxhash64(id_col).bitwiseAND(F.lit((1 << 62) - 1)))
    counts = named.groupBy(class_col).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), class_col).limit(1000)
    few = named.join(F.broadcast(counts), class_col, "left").where("_n is null or _h < double(%d) * %d / _n" % (1 << 62, 2 * per_class + 50))
    order = Window.partitionBy(class_col).orderBy("_h", id_col)
    return few.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_class).drop("_rank", "_h")


@dataclass
class Chunk:
    """Consecutive pieces of texts: ``data`` holds their bytes, piece i is data[starts[i]:ends[i]] and belongs to row docs[i]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES, cuts: np.ndarray | None = None) -> Iterator[Chunk]:
    """The texts in order, about ``limit`` bytes at a time. A longer text is a chunk of its own; with ``cuts`` (a table of bytes) it comes
    in several chunks, each ending with the last such byte before the limit, or with the first one after it."""
    data, at = raw(texts)
    lo = 0

    def chunk(a: int, z: int) -> Chunk:
        return Chunk(data[at[a] : at[z]], at[a:z] - at[a], at[a + 1 : z + 1] - at[a], np.arange(a, z))

    for i in range(len(at) - 1):
        s, e = int(at[i]), int(at[i + 1])
        if i > lo and e - int(at[lo]) > limit:
            yield chunk(lo, i)
            lo = i
        if e - s > limit:
            while cuts is not None and e - s > limit:
                step, found = limit, np.flatnonzero(cuts[data[s : s + limit]])[-1:]
                while not len(found) and s + step < e:
                    found = np.flatnonzero(cuts[data[s + step : min(s + 2 * step, e)]])[:1] + step
                    step *= 2
                if not len(found):
                    break
                cut = s + int(found[0]) + 1
                yield Chunk(data[s:cut], np.zeros(1, np.int64), np.array([cut - s]), np.array([i]))
                s = cut
            yield Chunk(data[s:e], np.zeros(1, np.int64), np.array([e - s]), np.array([i]))
            lo = i + 1
    if lo < len(at) - 1:
        yield chunk(lo, len(at) - 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (multiply and xor-shift rounds)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A 64-bit value for each byte; letters A-Z count as a-z in the second table.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOWER_VALUES = BYTE_VALUES[_LOWER]
LOWER = _LOWER
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse, modulo 2^64; kept for later calls."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Polynomial prefix hashes: out[i] covers data[:i]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]], equal for equal bytes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def spans(chunk: Chunk, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes with member[byte], never across pieces: starts, ends, and the piece of each."""
    inside = member[chunk.data]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    full = chunk.starts < chunk.ends
    before[chunk.starts[full]] = False
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after[chunk.ends[full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(chunk.starts, starts, "right") - 1


def summed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:ends[i]] along the first axis; 0 for empty ranges."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[ends] - total[starts]


def batch_udf(func, schema: str):
    """An Arrow UDF from an iterator of text arrays to an iterator of result arrays."""
    func.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(func, schema)
