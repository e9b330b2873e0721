"""Toxicity scores: a bidirectional gated recurrent network with attention pooling over character and word inputs, trained
in numpy; every overlapping window of a text is scored and the text takes its highest window.

Words are runs of ASCII letters, digits and bytes over 127, lower-cased. A word's input joins a hashed word embedding and the
mean of hashed embeddings of its letter trigrams; the first component of either starts as the smoothed log-odds of that bucket
among the training documents. Windows are ``WINDOW`` words, ``STRIDE`` apart, the last one ending with the text (texts
over a megabyte are scored in overlapping parts that hold the windows of the whole text). Labels say only whether a document is toxic somewhere, so the network
begins with each document's windows of highest log-odds and plain windows of clean documents; then it looks at all windows of the
sampled documents itself and learns from the highest one of each, which is the one that decides a document's score. The maximum
of the window logits becomes a probability by Platt scaling on sampled documents that were kept out of training, weighted to the
class shares of all training labels.

Training sees at most ``per_class`` documents of each class (those with the smallest id hashes). Edge cases: texts without
words (null, empty, punctuation) get the score of an empty window; labels that are null or of unknown documents are ignored,
a document with both labels counts once under each; with labels of one class only the score is that class's share; copies get
equal scores; extra columns pass through, columns named as the results are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (CHUNK_BYTES, LOWER, LOWER_VALUES, Chunk, batch_udf, chunks, durable, fold, prefix_sums, sample_ids, span_hashes, spans, tune, without)

WINDOW, STRIDE = 32, 16
WORD_BITS, CHAR_BITS, WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 16, 13, 5, 5, 8, 8
INPUTS = WORD_DIM + CHAR_DIM
OUT = ("score", "predicted")
LIMIT = 0.3

MEMBER = np.zeros(256, bool)
MEMBER[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = True


def _flat(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges one after the other, and the range of each."""
    n = ends - starts
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + starts[owner], owner


class Words:
    """The distinct words of a chunk (word bucket, letter trigram buckets) and the windows over its pieces."""

    def __init__(self, chunk: Chunk) -> None:
        starts, ends, piece = spans(chunk, MEMBER)
        sums = prefix_sums(chunk.data, LOWER_VALUES)
        _, first, self.word = np.unique(span_hashes(sums, starts, ends), return_index=True, return_inverse=True)
        s, e = starts[first], ends[first]
        self.word_bucket = (span_hashes(sums, s, e) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        at, self.owner = _flat(s, e)
        b = LOWER[chunk.data].astype(np.uint32)
        left = np.where(at > s[self.owner], b[at - 1] if len(b) else 0, 1)
        right = np.where(at + 1 < e[self.owner], b[np.minimum(at + 1, len(b) - 1)] if len(b) else 0, 2)
        x = ((left * np.uint32(263) + b[at]) * np.uint32(263) + right) * np.uint32(0x9E3779B1)
        self.char_bucket = (x.astype(np.uint32) >> np.uint32(32 - CHAR_BITS)).astype(np.int64)
        self.letters = np.maximum(e - s, 1)
        self.piece_of_word, self.starts, self.ends = piece, starts, ends
        n = np.bincount(piece, minlength=len(chunk.starts))
        base = np.cumsum(n) - n
        windows = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, 1)
        self.piece = np.repeat(np.arange(len(n)), windows)
        k = np.arange(len(self.piece)) - np.repeat(np.cumsum(windows) - windows, windows)
        offset = np.minimum(k * STRIDE, np.maximum(n - WINDOW, 0)[self.piece])
        self.begin = base[self.piece] + offset
        self.length = np.minimum(n[self.piece] - offset, WINDOW)

    def __len__(self) -> int:
        return len(self.word_bucket)

    def inputs(self, m: dict) -> np.ndarray:
        """One input vector for each distinct word, then a zero vector for padding."""
        x = np.zeros((len(self) + 1, INPUTS), np.float32)
        x[:-1, :WORD_DIM] = m["word"][self.word_bucket]
        chars = m["char"][self.char_bucket]
        for d in range(CHAR_DIM):
            x[:-1, WORD_DIM + d] = np.bincount(self.owner, chars[:, d], len(self)) / self.letters
        return x

    def grid(self, pick: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of windows (padded) and a mask, both windows x WINDOW."""
        begin, length = self.begin[pick], self.length[pick]
        steps = np.arange(WINDOW)
        mask = steps < length[:, None]
        padded = np.append(self.word, len(self))
        return padded[np.where(mask, begin[:, None] + steps, len(self.word))], mask


def parts(texts: pa.Array) -> Iterator[Chunk]:
    """Chunks of the texts. A long text comes in parts that begin at a multiple of STRIDE words and overlap, so that their windows, one
    after the other, are those of the whole text."""
    for chunk in chunks(texts, CHUNK_BYTES):
        if len(chunk.data) <= CHUNK_BYTES or len(chunk.docs) > 1:
            yield chunk
            continue
        data, s, size, earlier = chunk.data, 0, CHUNK_BYTES, None
        while True:
            z = min(s + size, len(data))
            if z < len(data):
                gap = np.flatnonzero(~MEMBER[data[s:z]])
                z = s + int(gap[-1]) + 1 if len(gap) else s
            starts, ends, _ = spans(_one(data[s:z], chunk), MEMBER)
            n = len(starts)
            if z < len(data) or s + size < len(data):
                if n < WINDOW + STRIDE:
                    size *= 2
                    continue
                k = (n - WINDOW) // STRIDE
                yield _one(data[s : s + ends[k * STRIDE + WINDOW - 1]], chunk)
                earlier = s + starts[: (k + 1) * STRIDE]
                s, size = s + int(starts[(k + 1) * STRIDE]), CHUNK_BYTES
                continue
            if n < WINDOW and earlier is not None:
                s = int(earlier[n - WINDOW])
            yield _one(data[s:], chunk)
            break


def _one(data: np.ndarray, of: Chunk) -> Chunk:
    return Chunk(data, np.zeros(1, np.int64), np.array([len(data)]), of.docs)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _gru(m: dict, way: str, x: np.ndarray, grid: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states, steps x windows x HIDDEN, in the order of the words; padding leaves the state as it is."""
    projected = x @ m[f"w{way}"] + m[f"b{way}"]
    u, H = m[f"u{way}"], HIDDEN
    steps = range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1)
    h = np.zeros((len(grid), H), np.float32)
    out = np.empty((WINDOW, len(grid), H), np.float32)
    for t in steps:
        a, g = projected[grid[:, t]], h @ u
        zr = _sigmoid(a[:, : 2 * H] + g[:, : 2 * H])
        z, r = zr[:, :H], zr[:, H:]
        n = np.tanh(a[:, 2 * H :] + r * g[:, 2 * H :])
        fresh = n + z * (h - n)
        if not mask[:, t].all():
            fresh = np.where(mask[:, t, None], fresh, h)
        if keep is not None:
            keep.append((t, h, z, r, n, g[:, 2 * H :]))
        out[t] = h = fresh
    return out


def _attend(m: dict, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    t = np.tanh(states @ m["a"])
    e = np.where(mask.T, t @ m["v"], np.float32(-1e4))
    e = np.exp(e - e.max(0))
    alpha = e / e.sum(0)
    context = np.einsum("tb,tbh->bh", alpha, states)
    context[~mask.any(1)] = 0
    return context @ m["o"] + m["c"], context, alpha, t


def window_logits(m: dict, words: Words, x: np.ndarray | None = None, block: int = 4096) -> np.ndarray:
    x = words.inputs(m) if x is None else x
    out = np.empty(len(words.begin), np.float32)
    for lo in range(0, len(out), block):
        grid, mask = words.grid(slice(lo, lo + block))
        states = np.concatenate([_gru(m, w, x, grid, mask) for w in "fb"], axis=2)
        out[lo : lo + block] = _attend(m, states, mask)[0]
    return out


def _backward(m: dict, way: str, x: np.ndarray, grid: np.ndarray, mask: np.ndarray, kept: list, down: np.ndarray, grads: dict, dx: np.ndarray) -> None:
    u, H = m[f"u{way}"], HIDDEN
    carry = np.zeros((len(grid), H), np.float32)
    da_all = np.empty((WINDOW, len(grid), 3 * H), np.float32)
    for t, h, z, r, n, gn in reversed(kept):
        live = mask[:, t, None]
        full = carry + down[t]
        d = np.where(live, full, 0)
        dz, dn = d * (h - n) * z * (1 - z), d * (1 - z) * (1 - n * n)
        dr = dn * gn * r * (1 - r)
        da_all[t] = np.concatenate([dz, dr, dn], 1)
        dg = np.concatenate([dz, dr, dn * r], 1)
        grads[f"u{way}"] += h.T @ dg
        carry = np.where(live, d * z + dg @ u.T, full)
    flat = da_all.transpose(1, 0, 2).reshape(-1, 3 * H)
    where = grid.reshape(-1)
    per_word = np.stack([np.bincount(where, flat[:, k], len(x)) for k in range(3 * H)], 1).astype(np.float32)
    grads[f"w{way}"] += x.T @ per_word
    grads[f"b{way}"] += per_word[:-1].sum(0)
    dx += per_word @ m[f"w{way}"].T


def _initial(word_odds: np.ndarray, char_odds: np.ndarray, seed: int = 11) -> dict:
    rng = np.random.default_rng(seed)
    f = lambda *s: rng.normal(0, 0.25, s).astype(np.float32)
    m = {"word": f(1 << WORD_BITS, WORD_DIM) * 0.2, "char": f(1 << CHAR_BITS, CHAR_DIM) * 0.4, "a": f(2 * HIDDEN, ATTEND), "v": f(ATTEND), "o": f(2 * HIDDEN), "c": np.zeros(1, np.float32)}
    for w in "fb":
        m |= {f"w{w}": f(INPUTS, 3 * HIDDEN), f"u{w}": f(HIDDEN, 3 * HIDDEN), f"b{w}": np.zeros(3 * HIDDEN, np.float32)}
    m["word"][:, 0], m["char"][:, 0] = word_odds, char_odds
    return m


def train(texts: list[bytes], labels: np.ndarray, m: dict, epochs: int = 4, size: int = 256, seed: int = 3) -> dict:
    """Adam on the logistic loss of single windows (each text is one window); all weights and embeddings are trained. Small
    samples are passed over more often, up to 80 steps in all."""
    size = min(size, max(32, len(texts) // 8))
    epochs = max(epochs, 80 // -(-len(texts) // size))
    rng = np.random.default_rng(seed)
    mean, var, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), size):
            pick = order[lo : lo + size]
            (chunk,) = chunks(pa.array([texts[i] for i in pick], pa.binary()), 1 << 30)
            words = Words(chunk)
            first = np.flatnonzero(np.r_[True, words.piece[1:] != words.piece[:-1]])
            x, (grid, mask) = words.inputs(m), words.grid(first)
            kept = {"f": [], "b": []}
            states = np.concatenate([_gru(m, w, x, grid, mask, kept[w]) for w in "fb"], axis=2)
            logit, context, alpha, t = _attend(m, states, mask)
            d = ((_sigmoid(logit) - labels[pick]) / len(pick)).astype(np.float32)
            g = {k: np.zeros_like(v) for k, v in m.items() if k not in ("word", "char")}
            g["o"], g["c"] = context.T @ d, np.array([d.sum()], np.float32)
            dcontext = d[:, None] * m["o"]
            dstates = alpha[:, :, None] * dcontext
            dalpha = np.einsum("bh,tbh->tb", dcontext, states)
            de = alpha * (dalpha - (alpha * dalpha).sum(0))
            g["v"] = np.einsum("tb,tba->a", de, t)
            dt = de[:, :, None] * m["v"] * (1 - t * t)
            g["a"] = np.einsum("tbh,tba->ha", states, dt)
            dstates = (dstates + dt @ m["a"].T).astype(np.float32)
            dx = np.zeros_like(x)
            for k, w in enumerate("fb"):
                _backward(m, w, x, grid, mask, kept[w], dstates[:, :, k * HIDDEN : (k + 1) * HIDDEN], g, dx)
            step += 1
            rate = 0.01 * (1 - epoch / (epochs + 1)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            for k, grad in g.items():
                mean[k] += 0.1 * (grad - mean[k])
                var[k] += 0.01 * (grad * grad - var[k])
                m[k] -= rate * mean[k] / (np.sqrt(var[k]) + 1e-8)
            dx = dx[:-1]
            per_char = dx[words.owner, WORD_DIM:] / words.letters[words.owner, None]
            for name, bucket, grad in (("word", words.word_bucket, dx[:, :WORD_DIM]), ("char", words.char_bucket, per_char)):
                used, inverse = np.unique(bucket, return_inverse=True)
                total = np.stack([np.bincount(inverse, grad[:, c], len(used)) for c in range(grad.shape[1])], 1).astype(np.float32)
                var[name][used] += total * total
                m[name][used] -= 0.05 * total / (np.sqrt(var[name][used]) + 1e-4)
    return m


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, bucket, label, documents with it) of sampled documents."""
    for batch in batches:
        label, seen = batch.column(2).to_numpy(zero_copy_only=False).astype(int), {"w": [], "c": []}
        for chunk in chunks(batch.column(1), CHUNK_BYTES, ~MEMBER):
            w = Words(chunk)
            doc = chunk.docs[w.piece_of_word]
            pairs = np.unique(doc * (len(w) + 1) + w.word)
            doc, word = pairs // (len(w) + 1), pairs % (len(w) + 1)
            seen["w"].append(np.unique(doc << WORD_BITS | w.word_bucket[word]))
            count = np.bincount(w.owner, minlength=len(w))
            by = np.argsort(w.owner, kind="stable")
            begin = np.cumsum(count) - count
            at, owner = _flat(begin[word], begin[word] + count[word])
            seen["c"].append(np.unique(doc[owner] << CHAR_BITS | w.char_bucket[by[at]]))
        for kind, bits in (("w", WORD_BITS), ("c", CHAR_BITS)):
            pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *seen[kind]]))  # a document in several chunks counts once
            bucket, of = pairs & ((1 << bits) - 1), label[pairs >> bits]
            key, inverse = np.unique(bucket, return_inverse=True)
            total = np.stack([np.bincount(inverse, of == c, len(key)) for c in (0, 1)], 1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(key), pa.string()), pa.array(key, pa.int64()), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["kind", "bucket", "clean", "toxic"])


def _candidates(odds: np.ndarray):
    """Of each sampled document: its two windows of highest log-odds among all, and an ordinary one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, rows = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            found: list[tuple] = []

            def picked() -> None:
                doc, high, lo, hi = (np.concatenate([f[k] for f in found]) for k in range(4))
                data = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                order = np.lexsort((-high, doc))
                rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
                n = np.bincount(doc - doc.min())
                middle = n[doc - doc.min()] // 2
                for k, i in zip(rank, order):
                    if (k < 2 or k == middle[i]) and lo[i] < hi[i]:
                        rows.append((ids[doc[i]], int(labels[doc[i]]), int(k), found[data[i]][4][lo[i] : hi[i]].tobytes()))
                found.clear()

            for chunk in parts(batch.column(1)):
                if found and found[-1][0][-1] != chunk.docs[0]:
                    picked()
                w = Words(chunk)
                value = np.append(np.maximum(odds[w.word_bucket], 0) ** 2, 0)
                grid, _ = w.grid()
                starts, ends = np.append(w.starts, 0), np.append(0, w.ends)
                found.append((chunk.docs[w.piece], value[grid].sum(1), starts[w.begin], np.where(w.length > 0, ends[w.begin + w.length], 0), chunk.data))
            if found:
                picked()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((batch.schema.field(0).type, pa.int32(), pa.int32(), pa.binary()))], names=["doc_id", "label", "rank", "piece"])

    return run


def _highest(m: dict):
    """Of each sampled document: its window of highest logit among all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, best = batch.column(0).to_pylist(), batch.column(2).to_pylist(), {}
            for chunk in parts(batch.column(1)):
                w = Words(chunk)
                logit = window_logits(m, w)
                order = np.lexsort((-logit, w.piece))
                for i in order[np.r_[True, w.piece[order[1:]] != w.piece[order[:-1]]]]:
                    doc = int(chunk.docs[w.piece[i]])
                    if w.length[i] and (doc not in best or logit[i] > best[doc][0]):
                        best[doc] = logit[i], chunk.data[w.starts[w.begin[i]] : w.ends[w.begin[i] + w.length[i] - 1]].tobytes()
            rows = [(ids[d], int(labels[d]), 0, piece) for d, (_, piece) in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((batch.schema.field(0).type, pa.int32(), pa.int32(), pa.binary()))], names=["doc_id", "label", "rank", "piece"])

    return run


def _platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of y on z, slightly regularised. Targets are a little inside 0 and 1, and steps are halved until
    they lower the loss, so that classes which z separates give a finite slope."""
    x, start, n = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0]), y.sum()
    target = np.where(y == 1, (n + 1) / (n + 2), 1 / (len(y) - n + 2))

    def loss(b: np.ndarray) -> float:
        s = x @ b
        return float((weight * (np.logaddexp(0, s) - target * s)).sum() + 5e-4 * ((b - start) ** 2).sum())

    beta = start
    for _ in range(50):
        p = _sigmoid(np.clip(x @ beta, -30, 30))
        grad = x.T @ (weight * (p - target)) + 1e-3 * (beta - start)
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 1e-3 * np.eye(2), grad)
        while loss(beta - step) > loss(beta) and np.abs(step).max() > 1e-9:
            step = step / 2
        if np.abs(step).max() < 1e-9:
            break
        beta = beta - step
    return float(beta[0]), float(beta[1])


def text_logits(texts: pa.Array, m: dict) -> np.ndarray:
    """Highest window logit of each text."""
    out = np.full(len(texts), -np.inf)
    for chunk in parts(texts):
        w = Words(chunk)
        np.maximum.at(out, chunk.docs[w.piece], window_logits(m, w))
    return out


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = 1500) -> dict:
    """Trains on documents with a label of 0 or 1; ``per_class`` bounds the documents of each class that are looked at."""
    tune(docs.sparkSession)
    labels = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    share = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    ids = F.broadcast(sample_ids(labels, "label", per_class))
    # of a repeated id, one text
    picked = durable(docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label"))
    rate = share.get(1, 0) / max(1, sum(share.values()))
    apart = F.crc32(F.concat(F.lit("v"), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0
    learn = picked.where(~apart)
    odds = {"w": np.zeros(1 << WORD_BITS, np.float32), "c": np.zeros(1 << CHAR_BITS, np.float32)}
    counts = learn.mapInArrow(_presence, "kind string, bucket long, clean double, toxic double").groupBy("kind", "bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()
    n = {r["label"]: r["count"] for r in learn.groupBy("label").count().collect()}
    if len(n) < 2:
        return {"net": None, "scale": (0.0, 0.0), "rate": rate}
    for r in counts:
        p, q = (r["toxic"] + 2) / (n[1] + 4), (r["clean"] + 2) / (n[0] + 4)
        odds[r["kind"]][r["bucket"]] = np.clip(np.log(p / q), -3, 3)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, label int, rank int, piece binary"

    def windows(pick) -> list:
        rows = learn.mapInArrow(pick, schema).collect()
        rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["rank"], bytes(r["piece"])))
        return [r for r in rows if not (r["label"] and r["rank"] > 1)]

    def learned(rows: list, m: dict, epochs: int) -> dict:
        return train([bytes(r["piece"]) for r in rows], np.array([r["label"] for r in rows], np.float32), m, epochs)

    rows = windows(_candidates(odds["w"]))
    m = learned(rows, _initial(odds["w"], odds["c"]), 4)
    m = learned(rows + windows(_highest(m)), m, 2)
    model = {"net": m, "scale": (1.0, 0.0), "rate": rate}
    tested = score(picked.where(apart), model, keep_logit=True).select("label", "logit").toPandas().sort_values(["logit", "label"])
    y = tested["label"].to_numpy(float)
    if 0 < y.sum() < len(y):
        weight = np.where(y == 1, rate / y.sum(), (1 - rate) / (len(y) - y.sum())) * len(y)
        model["scale"] = _platt(tested["logit"].to_numpy(), y, weight)
    return model


def score(docs: DataFrame, model: dict, text_col: str = "text", keep_logit: bool = False) -> DataFrame:
    """Adds score (double, 0 to 1) and predicted (int, 1 from LIMIT on) to docs."""
    docs = without(docs, *OUT, "logit")
    if model["net"] is None:
        return docs.withColumn("score", F.lit(float(model["rate"]))).withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model["net"])

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(text_logits(texts, shared.value), pa.float64())

    a, b = model["scale"]
    docs = docs.withColumn("logit", batch_udf(scored, "double")(F.col(text_col)))
    docs = docs.withColumn("score", 1 / (1 + F.exp(-(F.col("logit") * a + b)))).withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))
    return docs if keep_logit else docs.drop("logit")


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: crc32(doc_id) mod 4 is not 2."""
    return labels.where(fold("doc_id", 4) != 2)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, training_labels(labels))
    return score(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
