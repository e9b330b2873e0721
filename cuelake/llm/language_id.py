"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient
descent in numpy, with calibrated rejection.

Subwords are the byte 2-, 3- and 4-grams of the lower-cased text in which every run of ASCII bytes other than letters counts as
one blank. A text is the mean of its subwords' embeddings; a linear layer and a softmax follow. Since both are linear,
scoring adds up per-subword logits. Training sees a sample of ``per_language`` documents of each language, each as the counts of the
subwords of its whole text; its size does not depend on the corpus. A tenth of those documents is kept out to fit the
temperature of the scores and the rejection limit.

Edge cases: null, empty and letterless texts are ``und`` with score 0 and are rejected; rows with a null label or id do not
train; a corpus without labelled rows gives ``und`` everywhere; copies are scored alike; extra columns pass through and
columns named as the results are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, LOWER, Chunk, batch_udf, chunks, durable, fold, sample_ids, tune, without

BITS = 15
ORDERS = (2, 3, 4)
BUCKETS = len(ORDERS) << BITS
DIM = 12
TRAIN_BYTES = 256 << 20
OUT = ("lang_pred", "score", "rejected")

_CLASS = LOWER.copy()
_CLASS[[b for b in range(128) if not 97 <= LOWER[b] <= 122]] = 32


def _grams(b: np.ndarray, piece: np.ndarray, held: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and piece of each subword of reduced bytes; those within the first ``held`` bytes have been counted before."""
    b = b.astype(np.uint32)
    buckets, pieces = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    h = b
    for k, n in enumerate(range(2, max(ORDERS) + 1)):
        h = h[:-1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)
        if len(h) <= 0:
            break
        x = h * np.uint32(0x9E3779B1)
        whole = piece[: len(h)] == piece[n - 1 :]
        whole[: max(held - n + 1, 0)] = False
        buckets.append(((x >> np.uint32(32 - BITS)).astype(np.int32) + np.int32(k << BITS))[whole])
        pieces.append(piece[: len(h)][whole])
    return np.concatenate(buckets), np.concatenate(pieces)


def subwords(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each subword of a chunk, and the piece it starts in. Subwords over a piece's end are left out."""
    data = _CLASS[chunk.data]
    blank = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[chunk.starts[chunk.starts < chunk.ends]] = True
    return _grams(data[keep], np.repeat(np.arange(len(chunk.starts)), chunk.ends - chunk.starts)[keep])


def all_subwords(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, row of each, rows concerned) of about a megabyte of texts at a time. The parts of a longer text share the bytes
    that a subword may reach over, so that the subwords are those of the whole text."""
    for chunk in chunks(texts, CHUNK_BYTES):
        if len(chunk.data) <= CHUNK_BYTES or len(chunk.docs) > 1:
            bucket, piece = subwords(chunk)
            yield bucket, chunk.docs[piece], chunk.docs
            continue
        tail = np.zeros(0, np.uint8)
        for lo in range(0, len(chunk.data), CHUNK_BYTES):
            data = np.concatenate([tail[-1:], _CLASS[chunk.data[lo : lo + CHUNK_BYTES]]])
            data = data[np.r_[True, (data[1:] != 32) | (data[:-1] != 32)]]
            data = np.concatenate([tail[:-1], data])
            bucket, _ = _grams(data, np.zeros(len(data), np.int64), len(tail))
            yield bucket, np.full(len(bucket), chunk.docs[0]), chunk.docs
            tail = data[-(max(ORDERS) - 1) :]


def logit_sums(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of table rows over each text's subwords, and the subword counts."""
    n, k = len(texts), table.shape[1]
    sums, counts = np.zeros((n, k)), np.zeros(n)
    for bucket, row, rows in all_subwords(texts):
        lo, m = (int(rows[0]), len(rows)) if len(rows) else (0, 0)
        sums[lo : lo + m] += np.stack([np.bincount(row - lo, table[:, c][bucket], m) for c in range(k)], 1)
        counts[lo : lo + m] += np.bincount(row - lo, minlength=m)
    return sums, counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training texts as their subwords (32-bit buckets, ascending) and how often each stands in the text."""
    for batch in batches:
        found: dict[int, np.ndarray] = {}
        for bucket, row, rows in all_subwords(batch.column(1)):
            order = np.argsort(row, kind="stable")
            cut = np.searchsorted(row[order], np.append(rows, rows[-1] + 1))
            for i, a, z in zip(rows.tolist(), cut[:-1], cut[1:]):
                if a < z:
                    found[i] = found.get(i, 0) + np.bincount(bucket[order[a:z]], minlength=BUCKETS)
            # all but the last text are complete
            for i in [i for i in found if i != rows[-1]]:
                yield _features(batch, i, found.pop(i))
        for i, count in found.items():
            yield _features(batch, i, count)


def _features(batch: pa.RecordBatch, i: int, count: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(count)
    one = batch.slice(i, 1)
    return pa.RecordBatch.from_arrays([one.column(0), one.column(2), pa.array([used.astype("<i4").tobytes()]), pa.array([count[used].astype("<f4").tobytes()])], names=["doc_id", "label", "buckets", "counts"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _joined(texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, shares of their text and texts of several texts."""
    share = [c / max(c.sum(), 1) for _, c in texts]
    return np.concatenate([b for b, _ in texts]), np.concatenate(share).astype(np.float32), np.repeat(np.arange(len(texts)), [len(b) for b, _ in texts])


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, steps: int = 240, size: int = 48, seed: int = 7) -> np.ndarray:
    """Stochastic gradient descent with per-bucket step sizes over mini-batches of texts (buckets, counts); returns per-bucket logits."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weight = rng.normal(0, 0.3, (DIM, classes)).astype(np.float32)
    seen_e, seen_w = np.full(BUCKETS, 1e-6, np.float32), np.full(classes, 1e-6, np.float32)
    order = np.zeros(0, np.int64)
    for step in range(steps):
        if len(order) < min(size, len(texts)):
            order = rng.permutation(len(texts))
        pick, order = order[:size], order[size:]
        rate = 0.3 * (1 - step / steps)
        bucket, share, text = _joined([texts[i] for i in pick])
        mean = np.stack([np.bincount(text, embed[bucket, d] * share, len(pick)) for d in range(DIM)], 1).astype(np.float32)
        p = _softmax(mean @ weight)
        p[np.arange(len(pick)), labels[pick]] -= 1
        p /= len(pick)
        down = (p @ weight.T).astype(np.float32)
        g_w = mean.T @ p
        used, inverse = np.unique(bucket, return_inverse=True)
        g_e = np.stack([np.bincount(inverse, down[text, d] * share, len(used)) for d in range(DIM)], 1).astype(np.float32)
        seen_e[used] += (g_e**2).mean(1)
        embed[used] -= rate * g_e / np.sqrt(seen_e[used])[:, None]
        seen_w += (g_w**2).mean(0)
        weight -= rate * g_w / np.sqrt(seen_w)
    return (embed @ weight).astype(np.float64)


def fit(docs: DataFrame, label_col: str = "lang", per_language: int = 400) -> dict:
    """Trains on the rows of docs with a label. Bounded: ``per_language`` documents of each language (of a repeated id, one text), and
    ``TRAIN_BYTES`` of their counts, shared by the languages; beyond that the documents with the smallest hashes serve."""
    tune(docs.sparkSession)
    ids = sample_ids(docs.select("doc_id", F.col(label_col).cast("string").alias("label")), "label", per_language)
    picked = docs.select("doc_id", "text", F.col(label_col).cast("string").alias("label")).join(F.broadcast(ids), ["doc_id", "label"]).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    counted = durable(picked.select("doc_id", "text", "label").mapInArrow(_counted, f"doc_id {dict(docs.dtypes)['doc_id']}, label string, buckets binary, counts binary"))
    sizes = counted.select("doc_id", "label", (F.octet_length("buckets") + F.octet_length("counts")).alias("size")).collect()  # a row for each sampled document
    held, kept = {}, set()
    for r in sorted(sizes, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["label"])):
        held[r["label"]] = held.get(r["label"], 0) + r["size"]
        if held[r["label"]] <= TRAIN_BYTES // len({x["label"] for x in sizes}):
            kept.add((r["doc_id"], r["label"]))
    if len(kept) < len(sizes):
        few = docs.sparkSession.createDataFrame(sorted(kept), f"doc_id {dict(docs.dtypes)['doc_id']}, label string")
        counted = counted.join(F.broadcast(few), ["doc_id", "label"])
    rows = counted.collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["buckets"]), bytes(r["counts"])))
    classes = sorted({r["label"] for r in rows})
    if not rows:
        return {"classes": [], "table": np.zeros((BUCKETS, 1)), "heat": 1.0, "limit": 0.0}
    y = np.array([classes.index(r["label"]) for r in rows])
    out = np.array([zlib.crc32(f"v{r['doc_id']}".encode()) % 10 == 7 for r in rows])
    if out.all() or not out.any():
        out = np.arange(len(rows)) % 10 == 7
    texts = [(np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["counts"], "<f4")) for r in rows]
    fit_at = np.flatnonzero(~out)
    table = train([texts[i] for i in fit_at], y[fit_at], len(classes))
    heat, limit = 1.0, 0.0
    if out.any():
        bucket, share, text = _joined([texts[i] for i in np.flatnonzero(out)])
        t = y[out]
        z = np.stack([np.bincount(text, table[bucket, c] * share, len(t)) for c in range(len(classes))], 1)
        loss = {h: -np.log(_softmax(z * h)[np.arange(len(t)), t] + 1e-12).mean() for h in np.geomspace(0.25, 8, 16)}
        heat = min(loss, key=loss.get)
        p = _softmax(z * heat)
        right = p.max(1)[p.argmax(1) == t]
        limit = min(0.5, float(np.quantile(right, 0.001))) * 0.8 if len(right) else 0.0
    return {"classes": classes, "table": table, "heat": float(heat), "limit": limit}


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Adds lang_pred (string), score (double, calibrated probability of it) and rejected (boolean: ``und`` or a score below
    the calibrated limit) to docs."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        classes = pa.array(m["classes"] or ["und"], pa.string())
        for texts in batches:
            sums, n = logit_sums(texts, m["table"])
            p = _softmax(sums / np.maximum(n, 1)[:, None] * m["heat"])
            best = p.argmax(1)
            yield pa.StructArray.from_arrays([classes.take(pa.array(best)), pa.array(p[np.arange(len(best)), best])], ["lang", "score"])

    udf = batch_udf(scored, "lang string, score double")
    known = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model["classes"]))
    found = without(docs, "_lid", *OUT).withColumn("_lid", udf(F.col(text_col)))
    return (
        found.withColumn("lang_pred", F.when(known, F.col("_lid.lang")).otherwise("und"))
        .withColumn("score", F.when(known, F.col("_lid.score")).otherwise(0.0))
        .withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("score") < model["limit"]))
        .drop("_lid")
    )


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32(doc_id) mod 3 is not 1 and lang is known."""
    return docs.where((fold("doc_id", 3) != 1) & F.col("lang").isNotNull())


def held_out() -> Column:
    return fold("doc_id", 3) == 1


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(training_rows(docs.select("doc_id", "text", "lang")))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
