"""Quality scores: random Fourier features approximate a Gaussian kernel over document statistics; partition-summed normal
equations fit ridge scores, followed by isotonic calibration.

The statistics (shares of byte classes and symbols, word and line lengths, repetition, each over the whole text) are made once,
in one pass over the texts, and kept as a narrow table; fitting and scoring read only that. All labelled rows train: each
partition sums its part of the normal equations, Spark adds the parts row by row of the matrix, and the driver solves one
``FEATURES`` x ``FEATURES`` system. Calibration pools adjacent violators over ``BINS`` score bins counted in Spark, so
the driver's share does not depend on the number of rows.

Edge cases: null and empty texts have all-zero statistics and are scored like any other; labels that are null, not 0 or 1, or of
unknown documents are ignored; without labels every score is 0.5; with one class it is that class; copies get equal scores;
extra columns pass through ``score``, columns named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, LOWER_VALUES, Chunk, batch_udf, chunks, durable, fold, prefix_sums, span_hashes, spans, summed, tune, without

FEATURES, BINS, RIDGE, LIMIT = 256, 512, 1e-2, 0.3
OUT = ("score", "predicted")

_byte = np.arange(256)
_letter = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
CLASSES = {
    "continuation": (_byte >= 128) & (_byte < 192), "high": _byte >= 192, "upper": (_byte >= 65) & (_byte <= 90),
    "lower": (_byte >= 97) & (_byte <= 122), "digit": (_byte >= 48) & (_byte <= 57), "space": _byte == 32, "line": _byte == 10,
    "stop": np.isin(_byte, [46, 33, 63]), "comma": np.isin(_byte, [44, 59, 58]), "shout": _byte == 33,
    "symbol": np.isin(_byte, [ord(c) for c in "#$%&*+=<>^~@"]), "bar": np.isin(_byte, [ord(c) for c in "|\\/_"]),
    "quote": np.isin(_byte, [34, 39, 40, 41, 91, 93, 123, 125]),
}
_WORD = _letter | (_byte >= 128) | CLASSES["digit"]
_NOT_SPACE = ~np.isin(_byte, [32, 9, 10, 11, 12, 13])
_NOT_LINE = _byte != 10
_IDS = np.zeros(256, np.int64)
for _k, _m in enumerate(CLASSES.values(), 1):
    _IDS[_m & (_IDS == 0)] = _k
COUNTS = len(CLASSES) + 1
SUMS = COUNTS + 9
STATS = COUNTS - 1 + 13


def _piece_sums(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each piece, and the hashes of the chunk's words and of its lines."""
    m = len(chunk.starts)
    out = np.zeros((m, SUMS))
    piece = np.repeat(np.arange(m), chunk.ends - chunk.starts)
    out[:, :COUNTS] = np.bincount(piece * COUNTS + _IDS[chunk.data], minlength=m * COUNTS).reshape(m, COUNTS)
    out[:, 0] = chunk.ends - chunk.starts
    s, e, p = spans(chunk, _WORD)
    n = e - s
    sums = prefix_sums(chunk.data, LOWER_VALUES)
    upper = summed(CLASSES["upper"][chunk.data].astype(np.float64), s, e)
    ls, le, lp = spans(chunk, _NOT_LINE)
    ts, _, tp = spans(chunk, _NOT_SPACE)
    words, lines = span_hashes(sums, s, e), span_hashes(sums, ls, le)
    distinct = lambda h, q: np.bincount(_first(h, q), minlength=m)
    for k, v in enumerate((np.bincount(p, minlength=m), np.bincount(p, n, m), np.bincount(p, n * n, m), np.bincount(p, n <= 3, m), np.bincount(p, (upper == n) & (n > 1), m), distinct(words, p), np.bincount(lp, minlength=m), distinct(lines, lp), np.bincount(tp, minlength=m))):
        out[:, COUNTS + k] = v
    return out, words, lines


def _first(key: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The piece of each distinct (piece, key)."""
    order = np.lexsort((key, piece))
    k, q = key[order], piece[order]
    return q[np.r_[True, (k[1:] != k[:-1]) | (q[1:] != q[:-1])]] if len(q) else q


def statistics(texts: pa.Array) -> np.ndarray:
    """STATS numbers for each text. A long text is counted line by line group; its distinct words and lines are those of the whole."""
    total = np.zeros((len(texts), SUMS))
    parts: dict[int, list[np.ndarray]] = {}
    last = -1
    for chunk in chunks(texts, CHUNK_BYTES, ~_NOT_LINE):
        sums, words, lines = _piece_sums(chunk)
        total[chunk.docs] += sums
        if len(chunk.docs) == 1 and len(chunk.data):
            doc = int(chunk.docs[0])
            old = parts.get(doc, [np.zeros(0, np.uint64)] * 2) if doc == last else [np.zeros(0, np.uint64)] * 2
            parts = {doc: [np.union1d(old[0], words), np.union1d(old[1], lines)]}
            total[doc, COUNTS + 5], total[doc, COUNTS + 7] = map(len, parts[doc])
            last = doc
    size = np.maximum(total[:, :1], 1)
    words, letters, squares, short, capital, kinds, lines, line_kinds, tokens = total[:, COUNTS:].T
    w, n = np.maximum(words, 1), np.maximum(lines, 1)
    mean = letters / w
    rest = [np.log1p(total[:, 0]), np.log1p(words), mean, np.sqrt(np.maximum(squares / w - mean**2, 0)), short / w, capital / w, kinds / w, np.log1p(lines), line_kinds / n, np.log1p(total[:, 0] / n), words / np.maximum(tokens, 1), np.log1p(tokens / n), total[:, 0] / (tokens + 1)]
    return np.concatenate([np.sqrt(total[:, 1:COUNTS] / size), np.stack(rest, 1)], 1)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text, with the column stats (array of STATS doubles)."""
    tune(docs.sparkSession)

    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = statistics(texts)
            yield pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())

    return docs.withColumn("stats", batch_udf(made, "array<double>")(F.col(text_col))).drop(text_col)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fourier(x: np.ndarray, m: dict) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    z = np.clip((x - m["mean"]) / m["scale"], -6, 6)
    return np.concatenate([np.cos(z @ m["freq"] + m["phase"]) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))], 1)


def raw_score(x: np.ndarray, m: dict) -> np.ndarray:
    return fourier(x, m) @ m["weight"]


def isotonic(count: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Non-decreasing shares closest to ones/count (pooled adjacent violators); bins without rows follow their left neighbour."""
    blocks: list[list[float]] = []
    for c, o in zip(count, ones):
        blocks.append([float(o), float(c), 1])
        while len(blocks) > 1 and (blocks[-1][1] == 0 or blocks[-2][1] == 0 or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            o2, c2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + o2, blocks[-1][1] + c2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), o / c if c else 0.5) for o, c, k in blocks])


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", seed: int = 5, gamma: float = 0.02) -> dict:
    """Ridge weights and calibration from all labelled rows of the statistics table."""
    labels = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    rows = durable(stats.select("doc_id", "stats").join(labels, "doc_id").select("stats", "label"))
    moments = rows.select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).orderBy("i").collect()
    if not moments:
        return {"bins": None, "constant": 0.5}
    rng = np.random.default_rng(seed)
    m = {"mean": np.array([r["mean"] for r in moments]), "scale": np.array([max(r["std"], 1e-3) for r in moments]), "freq": rng.normal(0, np.sqrt(2 * gamma), (STATS, FEATURES)), "phase": rng.uniform(0, 2 * np.pi, FEATURES)}
    n = FEATURES + 1

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n + 1))
        for b in batches:
            z = fourier(_matrix(b.column(0)), m)
            total[:, :n] += z.T @ z
            total[:, n] += z.T @ b.column(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (n + 1), total.ravel())], names=["i", "part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, total = None, np.zeros(n + 1)
        for b in batches:
            i = b.column(0)[:1]
            total += _matrix(b.column(1)).sum(0)
        yield pa.RecordBatch.from_arrays([i, pa.ListArray.from_arrays(np.array([0, n + 1], np.int32), total)], names=["i", "part"])

    added.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    schema = "i long, part array<double>"
    system = np.array([r["part"] for r in rows.mapInArrow(parts, schema).groupBy("i").applyInArrow(added, schema).orderBy("i").collect()])
    m["weight"] = np.linalg.solve(system[:, :n] + RIDGE * np.eye(n) * max(1.0, system[FEATURES, FEATURES] / 1000), system[:, n])

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(np.clip(np.round(raw_score(_matrix(b), m) * BINS), 0, BINS - 1).astype(np.int32))

    counts = rows.select(batch_udf(scored, "int")("stats").alias("bin"), "label").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).collect()
    count, ones = np.zeros(BINS), np.zeros(BINS)
    for r in counts:
        count[r["bin"]], ones[r["bin"]] = r["n"], r["ones"]
    m["bins"] = isotonic(count, ones)
    return m


def score(stats: DataFrame, model: dict) -> DataFrame:
    """Adds score (double, the calibrated share of label 1) and predicted (int, 1 from LIMIT on) to a statistics table."""
    stats = without(stats, *OUT)
    if model["bins"] is None:
        return stats.withColumn("score", F.lit(model["constant"])).withColumn("predicted", F.lit(1))
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        centres = np.arange(BINS) / BINS
        for b in batches:
            s = raw_score(_matrix(b), m)
            exact = np.interp(s, centres, m["bins"])
            yield pa.array(np.clip(exact + 1e-4 * np.clip(s - 0.5, -0.5, 0.5), 0, 1))

    return stats.withColumn("score", batch_udf(scored, "double")("stats")).withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: crc32(doc_id) mod 5 is not 0."""
    return labels.where(fold("doc_id", 5) != 0)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stats = durable(with_statistics(docs))
    model = fit(stats, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(stats, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
