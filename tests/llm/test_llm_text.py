"""Classifiers, tokenizer and language identification: edge cases, held-out accuracy, round trips."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelake.llm import byte_bpe, common, language_id, quality, registry, toxicity

ODD = "doc_id long, text string, lang string, source string, score string"
ROWS = [(1, None, None, None, "x"), (2, "", "en", "a", "x"), (3, "!!! 123", "en", None, "x"), (4, "the and of it " * 30, "en", "a", "y"), (4, "the and of it " * 30, "en", "a", "y"), (5, "der die und das " * 30, "de", "b", "z"), (6, "a" * 5000, None, "b", "z")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


def test_chunks_cover_every_byte_once():
    texts = pa.array(["ab cd " * 500, None, "", "x" * 3000, "é" * 10])
    for cuts in (None, np.arange(256) == 32):
        got, seen = [b""] * 5, 0
        for c in common.chunks(texts, 1000, cuts):
            seen += 1
            for d, s, e in zip(c.docs, c.starts, c.ends):
                got[d] += c.data[s:e].tobytes()
        assert got == [(t or "").encode() for t in texts.to_pylist()] and seen == 4 if cuts is None else seen > 4


def test_chunks_are_cut_after_a_byte():
    text = b"a" * 2500 + b" " + b"b" * 700 + b" " + b"c" * 900 + b"  d"
    got = [c.data.tobytes() for c in common.chunks(pa.array([text], pa.binary()), 1000, np.arange(256) == 32)]
    assert b"".join(got) == text and [len(x) for x in got] == [2501, 701, 903]


def long_text(seed, size=3_000_000, line=True):
    rng = np.random.default_rng(seed)
    words = np.array(["alpha", "Beta", "gamma", "d", "été", "QUX", "12", "x-y", "the", "  ", "..", "zeta!"] + [f"w{i}" for i in range(3000)])
    ends = np.array([" ", " ", " ", " ", "\n", "  ", ", "]) if line else np.array([" ", "  ", ", "])
    n = size // 6
    return "".join(np.char.add(rng.choice(words, n), rng.choice(ends, n)))


def test_samples_are_the_smallest_hashes(spark):
    rows = [(i, "common" if i % 10 else "rare") for i in range(5000)] * 2 + [(None, "common"), (7000, None), (7001, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, label string")
    got = {}
    for r in common.sample_ids(df, "label", 100).collect():
        got.setdefault(r["label"], []).append(r["doc_id"])
    hashed = {r[0]: r[1] for r in spark.range(8000).selectExpr("id", "xxhash64(id) & %d" % ((1 << 62) - 1)).collect()}
    for name, ids in (("common", [i for i in range(5000) if i % 10]), ("rare", range(0, 5000, 10)), ("alone", [7001])):
        assert sorted(got.pop(name)) == sorted(sorted(ids, key=hashed.get)[:100])
    assert not got


def test_samples_do_not_depend_on_repeats(spark):
    """One id repeated 50,000 times beside 200 others, and a classifier's sample of such rows."""
    ids = spark.range(200).union(spark.range(50_000).select(F.lit(900).cast("long")))
    assert {r["doc_id"] for r in common.sample_ids(ids.select(F.col("id").alias("doc_id"), F.lit("a").alias("label")), "label", 400).collect()} == {*range(200), 900}
    text = F.when(F.col("id") % 2 == 0, "the and of that with this").otherwise("der und das nicht mit ein")
    docs = ids.select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    model = language_id.fit(docs)
    assert model["classes"] == ["de", "en"]
    got = language_id.predict(docs.distinct(), model).groupBy("lang").agg(F.min("lang_pred").alias("low"), F.max("lang_pred").alias("high")).collect()
    assert all(r["low"] == r["high"] == r["lang"] for r in got)


def test_language_training_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TRAIN_BYTES", 4000)
    docs = spark.createDataFrame([(i, ("the and of that " if i % 2 else "der und das nicht ") + str(i), "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    assert language_id.fit(docs)["classes"] == ["de", "en"]


def test_span_hashes_depend_on_bytes_only():
    data = np.frombuffer(b"hello world hello", np.uint8)
    sums = common.prefix_sums(data)
    h = common.span_hashes(sums, np.array([0, 12, 6]), np.array([5, 17, 11]))
    assert h[0] == h[1] != h[2]


def test_language_edge_cases(spark, odd, empty):
    model = language_id.fit(odd.where("lang is not null"))
    rows = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert [rows[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and all(rows[k]["rejected"] and rows[k]["score"] == 0 for k in (1, 2, 3))
    assert rows[4]["lang_pred"] == "en" and rows[5]["lang_pred"] == "de" and rows[4]["source"] == "a"
    assert language_id.predict(odd, model).count() == len(ROWS)
    nothing = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.predict(odd, nothing).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def naive_subwords(text):
    """Buckets of the 2-, 3- and 4-grams of the reduced text, one by one."""
    import re

    b = re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    out = {}
    for k, n in enumerate(language_id.ORDERS):
        for i in range(len(b) - n + 1):
            h = b[i]
            for j in range(1, n):
                h = (h * 0x01000193 + b[i + j] + j + 1) & 0xFFFFFFFF
            bucket = (((h * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - language_id.BITS)) + (k << language_id.BITS)
            out[bucket] = out.get(bucket, 0) + 1
    return out


def test_language_is_a_dictionary_of_subwords(monkeypatch):
    table = np.random.default_rng(2).normal(size=(language_id.BUCKETS, 3))
    texts = ["Der  Hund, 12 und -- die Katze", None, "", "a", "!!", "Ünïcödé  wörd\n\nZ", "ab   " * 400 + "cd", " x" * 700, "abc" * 500]
    for limit in (1 << 20, 64, 7):
        monkeypatch.setattr(language_id, "CHUNK_BYTES", limit)
        sums, counts = language_id.logit_sums(pa.array(texts), table)
        for t, s, n in zip(texts, sums, counts):
            want = naive_subwords(t)
            assert n == sum(want.values()) and np.allclose(s, sum((table[b] * c for b, c in want.items()), np.zeros(3)))
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(["x"] * len(texts))], names=["doc_id", "text", "label"])
        found = {}
        for b in language_id._counted(iter([batch])):
            for d, _, used, count in zip(*(c.to_pylist() for c in b.columns)):
                found[d] = dict(zip(np.frombuffer(used, "<i4").tolist(), np.frombuffer(count, "<f4").tolist()))
        assert found == {i: w for i, t in enumerate(texts) if (w := naive_subwords(t))}


def test_long_texts_are_one_piece(monkeypatch):
    """Texts of 3 MB in parts and at once: subwords, statistics and windows are the same."""
    texts = pa.array(["short one", long_text(1), None, long_text(2, line=False), "x" * 1_500_000 + " tail of few words"])
    table = np.random.default_rng(2).normal(size=(language_id.BUCKETS, 3))
    m = toxicity._initial(np.random.default_rng(1).normal(size=1 << toxicity.WORD_BITS), np.zeros(1 << toxicity.CHAR_BITS, np.float32))
    stride = 16

    def all_windows():
        out = {}
        for chunk in toxicity.parts(texts):
            w = toxicity.Words(chunk)
            for piece, begin, length in zip(w.piece, w.begin, w.length):
                span = chunk.data[w.starts[begin] : w.ends[begin + length - 1]].tobytes() if length else b""
                out.setdefault(int(chunk.docs[piece]), []).append(hash(span))
        return out

    got = language_id.logit_sums(texts, table), quality.statistics(texts), all_windows()
    sample = pa.array([long_text(3, 120_000), long_text(4, 70_000, line=False), "few words"])
    for module in (language_id, quality, toxicity):
        monkeypatch.setattr(module, "CHUNK_BYTES", 1 << 30)
    once = language_id.logit_sums(texts, table), quality.statistics(texts), all_windows()
    assert np.allclose(got[0][0], once[0][0]) and (got[0][1] == once[0][1]).all() and np.allclose(got[1], once[1]) and got[2] == once[2]
    whole = toxicity.text_logits(sample, m)
    odds = np.random.default_rng(3).normal(size=1 << toxicity.WORD_BITS)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), sample, pa.array([0, 1, 1])], names=["doc_id", "text", "label"])
    tables = [[b.to_pylist() for b in toxicity._candidates(odds)(iter([batch]))], [b.to_pylist() for b in toxicity._presence(iter([batch]))]]
    monkeypatch.setattr(toxicity, "CHUNK_BYTES", 20_000)
    assert np.allclose(toxicity.text_logits(sample, m), whole, atol=1e-4) and stride == toxicity.STRIDE
    assert [[b.to_pylist() for b in toxicity._candidates(odds)(iter([batch]))], [b.to_pylist() for b in toxicity._presence(iter([batch]))]] == tables


def test_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = registry.QUERIES["op6_language_id"](spark, sf).join(docs, "doc_id").where("held_out")
    right = got.where("lang = lang_pred").count()
    assert right >= 0.95 * got.count() > 0


def test_toxicity_edge_cases(spark, odd, empty):
    labels = spark.createDataFrame([(4, 0), (5, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows) and len({r["score"] for r in rows if r["doc_id"] == 4}) == 1
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    one = toxicity.fit(odd, labels.where("toxic = 1"))
    assert {r["score"] for r in toxicity.score(odd, one).collect()} == {1.0}
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_gradients():
    """The backward pass agrees with finite differences."""
    rng = np.random.default_rng(0)
    m = toxicity._initial(np.zeros(1 << toxicity.WORD_BITS, np.float32), np.zeros(1 << toxicity.CHAR_BITS, np.float32))
    m = {k: v.astype(np.float64) for k, v in m.items()}
    (chunk,) = common.chunks(pa.array(["one two three", "four"]))
    w = toxicity.Words(chunk)
    x, (grid, mask) = w.inputs(m).astype(np.float64), w.grid()
    up = rng.normal(size=(toxicity.WINDOW, 2, toxicity.HIDDEN))
    for way in "fb":
        kept = []
        toxicity._gru(m, way, x, grid, mask, kept)
        g = {k: np.zeros_like(v) for k, v in m.items() if k[0] in "wub"}
        toxicity._backward(m, way, x, grid, mask, kept, up, g, np.zeros_like(x))
        for name in (f"w{way}", f"u{way}"):
            old = m[name][1, 2]
            f = []
            for d in (1e-2, -1e-2):
                m[name][1, 2] = old + d
                f.append(float((toxicity._gru(m, way, x, grid, mask) * up).sum()))
            m[name][1, 2] = old
            assert abs((f[0] - f[1]) / 2e-2 - g[name][1, 2]) < 5e-3 * max(1, abs(g[name][1, 2]))


def slow_score(text, m):
    """Highest logit of a text's windows, word by word and number by number."""
    import math
    import re

    sig = lambda x: 1 / (1 + math.exp(-x))
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
    H = toxicity.HIDDEN

    def vector(word):
        data = np.frombuffer(word, np.uint8)
        h = common.span_hashes(common.prefix_sums(data, common.LOWER_VALUES), np.array([0]), np.array([len(data)]))[0]
        b = [1, *word.lower(), 2] if word.isascii() else [1, *(x + 32 if 65 <= x <= 90 else x for x in word), 2]
        chars = [m["char"][(((b[i - 1] * 263 + b[i]) * 263 + b[i + 1]) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - toxicity.CHAR_BITS)] for i in range(1, len(b) - 1)]
        return [*m["word"][int(h) >> (64 - toxicity.WORD_BITS)], *(sum(c[d] for c in chars) / len(chars) for d in range(toxicity.CHAR_DIM))]

    def gru(way, xs):
        h, out = [0.0] * H, []
        for x in xs:
            a = [sum(v * m[f"w{way}"][i, k] for i, v in enumerate(x)) + m[f"b{way}"][k] for k in range(3 * H)]
            g = [sum(h[i] * m[f"u{way}"][i, k] for i in range(H)) for k in range(3 * H)]
            z, r = [sig(a[k] + g[k]) for k in range(H)], [sig(a[H + k] + g[H + k]) for k in range(H)]
            n = [math.tanh(a[2 * H + k] + r[k] * g[2 * H + k]) for k in range(H)]
            h = [(1 - z[k]) * n[k] + z[k] * h[k] for k in range(H)]
            out.append(h)
        return out

    starts = sorted({*range(0, max(len(words) - toxicity.WINDOW, 0), toxicity.STRIDE), max(len(words) - toxicity.WINDOW, 0)})
    best = -math.inf
    for s in starts:
        xs = [vector(w) for w in words[s : s + toxicity.WINDOW]]
        states = [f + b for f, b in zip(gru("f", xs), gru("b", xs[::-1])[::-1])]
        e = [sum(math.tanh(sum(h[i] * m["a"][i, j] for i in range(2 * H))) * m["v"][j] for j in range(toxicity.ATTEND)) for h in states]
        top = max(e, default=0)
        alpha = [math.exp(v - top) for v in e]
        context = [sum(a * h[i] for a, h in zip(alpha, states)) / sum(alpha) for i in range(2 * H)] if xs else [0.0] * (2 * H)
        best = max(best, sum(c * o for c, o in zip(context, m["o"])) + float(m["c"][0]))
    return best


def test_toxicity_is_the_slow_network():
    rng = np.random.default_rng(6)
    m = toxicity._initial(rng.normal(size=1 << toxicity.WORD_BITS), rng.normal(size=1 << toxicity.CHAR_BITS))
    m |= {k: rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in m.items() if k[0] == "b" or k == "c"}
    texts = ["", "One two, THREE", "été Über naïve 12 " * 3, None, " ".join(f"w{i % 17}" for i in range(32)), " ".join(f"w{i % 17}x" for i in range(33)), " ".join(f"v{i * i % 23}" for i in range(75))]
    assert np.allclose(toxicity.text_logits(pa.array(texts), m), [slow_score(t, m) for t in texts], atol=1e-4)


def test_toxicity_held_out(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")  # thousands of labels: the labels are noisy
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = registry.QUERIES["op1_toxicity"](spark, sf).join(labels, "doc_id").where("held_out")
    assert got.where("predicted = toxic").count() >= 0.92 * got.count()
    assert got.where("predicted = 1 and toxic = 1").count() >= 0.75 * got.where("toxic = 1").count()


def test_toxicity_scale_of_separated_classes():
    """Logits that separate the classes, on however short a stretch, give a rising, finite scale between them."""
    for seed, gap in ((0, 0.01), (1, 3.0), (2, -1.0)):
        rng = np.random.default_rng(seed)
        z, y = np.concatenate([rng.uniform(-6, 0, 300), rng.uniform(gap, 6, 60)]), np.repeat([0.0, 1.0], [300, 60])
        a, b = toxicity._platt(z, y, np.where(y == 1, 0.1 / 60, 0.9 / 300) * 360)
        p = 1 / (1 + np.exp(-(a * z + b)))
        assert 0 < a < 1e4 and ((p >= 0.3) == (y == 1)).mean() > 0.85 and p[y == 1].min() >= p[z < -2].max()


def test_toxicity_finds_a_word_in_a_long_text():
    words = ["alpha", "beta", "gamma", "delta"]
    rng = np.random.default_rng(1)
    plain = [" ".join(rng.choice(words, 32)).encode() for _ in range(400)]
    y = np.arange(400) % 2
    texts = [p.replace(b"alpha", b"scum", 1) if t else p for p, t in zip(plain, y)]
    odds = np.zeros(1 << toxicity.WORD_BITS, np.float32)
    m = toxicity.train(texts, y.astype(np.float32), toxicity._initial(odds, np.zeros(1 << toxicity.CHAR_BITS, np.float32)), epochs=8)
    clean, dirty = " ".join(rng.choice(words, 500)), " ".join(rng.choice(words, 400)) + " scum " + " ".join(rng.choice(words, 100))
    a, b = toxicity.text_logits(pa.array([clean, dirty]), m)
    assert b > a + 1


def test_quality_edge_cases(spark, odd, empty):
    stats = quality.with_statistics(odd)
    labels = spark.createDataFrame([(4, 1), (5, 0), (3, None)], "doc_id long, quality int")
    model = quality.fit(stats, labels)
    rows = quality.score(stats, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(stats, quality.fit(stats, labels.where("doc_id = 0"))).select("score").distinct().collect()[0][0] == 0.5
    assert quality.score(quality.with_statistics(empty), model).count() == 0


def test_isotonic_is_monotone_and_exact():
    got = quality.isotonic(np.array([2, 0, 2, 4]), np.array([2, 0, 0, 3]))
    assert got.tolist() == [0.5, 0.5, 0.5, 0.75]


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    m = {"mean": 0.0, "scale": 1.0, "freq": rng.normal(0, np.sqrt(2 * 0.02), (quality.STATS, quality.FEATURES)), "phase": rng.uniform(0, 2 * np.pi, quality.FEATURES)}
    x = rng.normal(size=(30, quality.STATS))
    z = quality.fourier(x, m)[:, : quality.FEATURES]
    exact = np.exp(-0.02 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - exact).max() < 0.35 and np.abs(z @ z.T - exact).mean() < 0.08


def naive_statistics(text):
    """The statistics of one text, by loops over its bytes, words and lines."""
    import math
    import re

    b = (text or "").encode()
    names = list(quality.CLASSES)
    count = dict.fromkeys(names, 0)
    for x in b:
        for name in names:
            if quality.CLASSES[name][x]:
                count[name] += 1
                break
    words, lines, tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+", b), re.findall(rb"[^\n]+", b), re.findall(rb"[^ \t-\r]+", b)
    low = lambda x: bytes(c + 32 if 65 <= c <= 90 else c for c in x)
    n, w, ln = [len(x) for x in words], max(len(words), 1), max(len(lines), 1)
    mean = sum(n) / w
    spread = math.sqrt(max(sum(k * k for k in n) / w - mean**2, 0))
    capital = sum(len(x) > 1 and all(65 <= c <= 90 for c in x) for x in words)
    rest = [math.log1p(len(b)), math.log1p(len(words)), mean, spread, sum(k <= 3 for k in n) / w, capital / w, len({low(x) for x in words}) / w, math.log1p(len(lines)), len({low(x) for x in lines}) / ln, math.log1p(len(b) / ln), len(words) / max(len(tokens), 1), math.log1p(len(tokens) / ln), len(b) / (len(tokens) + 1)]
    return [math.sqrt(count[name] / max(len(b), 1)) for name in names] + rest


def test_quality_statistics_are_naive():
    texts = ["", None, "Hello, World! HELLO world\nhello world\n\n", "A b CC 12 | x_y #tag (q) 'z'\ttab", "été ÉTÉ é\nété", long_text(7, 20_000), "\n\n", "same line\n" * 40]
    assert np.allclose(quality.statistics(pa.array(texts)), [naive_statistics(t) for t in texts])


def test_quality_fit_is_a_closed_form_ridge(spark):
    """Weights from partition sums against one solve over all rows."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, quality.STATS)) * rng.uniform(0.5, 3, quality.STATS)
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(int)
    rows = [(i, x[i].tolist()) for i in range(400)]
    m = quality.fit(spark.createDataFrame(rows, "doc_id long, stats array<double>").repartition(7), spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int"))
    own = {"mean": x.mean(0), "scale": np.maximum(x.std(0), 1e-3), "freq": m["freq"], "phase": m["phase"]}
    z = quality.fourier(x, own)
    want = np.linalg.solve(z.T @ z + quality.RIDGE * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(z @ m["weight"], z @ want, atol=1e-6) and np.allclose(m["mean"], x.mean(0))
    share = [np.mean(y[np.clip(np.round(z @ m["weight"] * quality.BINS), 0, quality.BINS - 1) >= k]) for k in (100, 256, 400)]
    assert (np.diff(m["bins"]) >= 0).all() and share[0] <= share[2]


def test_quality_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # a few hundred labels at least
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = registry.QUERIES["op4_quality"](spark, sf).join(labels, "doc_id").where("held_out")
    assert got.where("predicted = quality").count() >= 0.9 * got.count()


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    return byte_bpe.Ranks.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


TEXTS = ["", "hello world", "don't  \n\n stop", "🙂🙂 naïve <|endoftext|>", "a" * 700, " " * 90 + "é", "12345678901234567890" * 9, "\x00\x01�", "Ünïcödé Wörter " * 40]


def test_bpe_is_tiktoken(ranks):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=ranks.pattern, mergeable_ranks=ranks.ranks, special_tokens={})
    got = byte_bpe.Encoder(ranks)([*TEXTS, None])
    assert got == [np.array(own.encode_ordinary(t), "<u4").tobytes() for t in [*TEXTS, ""]]
    assert [ranks.decode(g).decode() for g in got[:-1]] == TEXTS


def slow_merges(ranks, piece):
    """The leftmost pair of smallest rank, again and again."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks.ranks), default=None)
        if best is None:
            return np.array([ranks.ranks[p] for p in parts], "<u4").tobytes()
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_bpe_matrices_are_slow_merges(ranks):
    rng = np.random.default_rng(0)
    pieces = [bytes(rng.choice(list(b"aeinrst thoud"), n).astype(np.uint8)) for n in [*rng.integers(2, 60, 200), *rng.integers(60, 400, 60), 64, 65, 128, 129, 700]]
    pieces += [b"ab" * 100, b"a" * 333, "字符串编码测试".encode() * 20, "ß".encode() * 70, bytes(range(256))]
    assert ranks.encode_pieces(pieces) == [slow_merges(ranks, p) for p in pieces]


def test_bpe_long_pieces_are_tiktoken(ranks):
    """Paragraphs without a space, and one piece of a quarter of a megabyte."""
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=ranks.pattern, mergeable_ranks=ranks.ranks, special_tokens={})
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x5200, n))) for n in (30, 400, 3000)] + ["".join(rng.choice(list("abcdefg"), 250_000))]
    assert byte_bpe.Encoder(ranks)(texts) == [np.array(own.encode_ordinary(t), "<u4").tobytes() for t in texts]


def test_bpe_query(spark, sf, ranks):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=ranks.pattern, mergeable_ranks=ranks.ranks, special_tokens={})
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = registry.QUERIES["op7_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(own.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_bpe_edge_cases(spark, odd, empty, ranks):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = byte_bpe.decode(byte_bpe.encode(odd, path, ranks.pattern), path, ranks.pattern)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in both.collect()) and both.columns[: len(odd.columns)] == odd.columns
    assert byte_bpe.encode(empty, path, ranks.pattern).count() == 0
    with pytest.raises(ValueError):
        ranks.decode(np.array([60000], "<u4").tobytes())


def test_long_runs_merge_as_one_pair_at_a_time():
    """Whole rounds on vocabularies whose ranks are in any order, so that merges make pairs of smaller rank."""
    import random

    r = random.Random(9)
    for trial in range(60):
        words = {bytes(r.choice(b"abc") for _ in range(r.randrange(2, 6))) for _ in range(r.randrange(1, 40))}
        # tokens that can be reached by merges of tokens
        tokens = {bytes([b]) for b in range(256)}
        for w in sorted(words, key=len):
            if any(w[:k] in tokens and w[k:] in tokens for k in range(1, len(w))):
                tokens.add(w)
        rest = [t for t in tokens if len(t) > 1]
        r.shuffle(rest)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(rest)}
        table = byte_bpe.Ranks(ranks, ".*")
        for piece in (bytes(r.choice(b"abc") for _ in range(300)), b"a" * 77, b"ab" * 50 + b"c"):
            assert table.encode_run(piece) == slow_merges(table, piece)
