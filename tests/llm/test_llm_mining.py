"""Decontamination, spelling variants and hard negatives: brute force and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import decontamination, hard_negatives, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# ---- decontamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(text, items, width):
    """Words, hit places, and ids of the items with an occurring window."""
    w, hit, names = words_of(text), set(), set()
    for name, item in items:
        x = words_of(item)
        m = min(len(x), width)
        windows = {tuple(x[i : i + m]) for i in range(len(x) - m + 1)} if m else set()
        places = [i for i in range(len(w) - m + 1) if tuple(w[i : i + m]) in windows] if m else []
        hit |= {p for i in places for p in range(i, i + m)}
        names |= {str(name)} if places and name is not None else set()
    return len(w), hit, sorted(names)


def runs(places):
    out = []
    for p in sorted(places):
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [tuple(r) for r in out]


def check_hits(spark, docs, items, width=10, **more):
    d = spark.createDataFrame([(*r, "mine", 7) for r in docs], "doc_id long, text string, spans string, _all int")
    i = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.scanned(d, i, width=width, **more)
    assert out.columns == ["doc_id", "text", "_all", "n_words", "spans", "items"]
    got = Counter((r["doc_id"], r["text"], r["n_words"], tuple((s["first"], s["last"]) for s in r["spans"]), tuple(r["items"])) for r in out.collect())
    want = Counter()
    for doc_id, text in docs:
        n, hit, names = brute_hits(text, items, width)
        want[(doc_id, text, n, tuple(runs(hit)), tuple(names))] += 1
    assert got == want
    return out


def random_texts(seed, n, letters, most):
    r = random.Random(seed)
    return [" ".join(r.choice(letters) for _ in range(r.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("width,shard_words", [(3, 1 << 18), (4, 40), (10, 25)])
def test_hits_are_those_of_every_window(spark, width, shard_words):
    items = [(k % 25 if k % 9 else None, t) for k, t in enumerate(random_texts(1, 40, "abc", 2 * width + 3) + ["", "a", "A b", "a"])]
    docs = list(enumerate(random_texts(2, 60, "abcd", 40))) + [(5, "a b c"), (5, "a b c"), (None, "A, b.c\na"), (7, None), (8, ""), (9, "é a  B-c x1")]
    check_hits(spark, docs, items, width, shard_words=shard_words)


def test_long_texts_and_pieces(spark, monkeypatch):
    """A text of several chunks, and matches over the limits of pieces and parts."""
    monkeypatch.setattr(decontamination, "PIECE", 7)
    monkeypatch.setattr(decontamination, "PART", 23)
    r = random.Random(3)
    item = [f"w{r.randrange(60)}" for _ in range(300)]
    filler = [f"x{k % 1000}" for k in range(500_000)]
    text = " ".join([*filler, *item[20:90], *filler[:50], *item[5:14], "y", *item[200:210], *filler[:10]])
    assert len(text) > 2 << 20
    out = check_hits(spark, [(1, text), (2, " ".join(item)), (3, "q" * (2 << 20))], [(4, " ".join(item)), (5, "nothing of it here")]).where("doc_id = 1").first()
    s = [x for x in out["spans"] if x["last"] - x["first"] >= 69][0]
    assert text.encode()[s["start"] : s["stop"]].decode() == " ".join(item[20:90])


def test_decontaminated_texts(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before, {item.title()}! After it come many more words than that, so most of it stays as it was."), (2, item), (3, "clean text"), (4, None), (5, f"é {item[:30]}")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["dropped"]) for r in decontamination.decontaminated(d, i).collect()}
    assert got == {1: ("Before, ! After it come many more words than that, so most of it stays as it was.", 11, False), 2: ("", 11, True), 3: ("clean text", 0, False), 4: (None, 0, False), 5: (docs[4][1], 0, False)}
    assert decontamination.scanned(d.where("false"), i).count() == 0
    assert {r["n_words"] for r in decontamination.scanned(d, i.where("false")).collect()} == {28, 11, 2, 0, 8}


def test_op11_columns(spark, sf):
    r = decontamination.op11_benchmark_decontamination(spark, sf).where("n_items = 0").first()
    assert r["items_sha256"] == hashlib.sha256(b"").hexdigest() and not r["contaminated"]


# ---- spelling variants


def brute_variants(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}
    near = defaultdict(set)
    for a in n:
        for b in n:
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a))):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out, key=repr)


def variants(spark, rows):
    docs = spark.createDataFrame([(*r, "mine", 3) for r in rows], "doc_id long, text string, word string, n int")
    out = spelling.groups(docs)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, out.collect()), key=repr)


def test_variants_of_random_words(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abÀ") for _ in range(r.randrange(4, 8))) for _ in range(250)]
    rows = [(k if k % 7 else None, " ".join(r.choices(words, [1 / (i + 1) for i in range(250)], k=200))) for k in range(120)] + [(1, None), (2, ""), (3, "123 ... -"), (4, "× ÷")]
    got = variants(spark, rows)
    assert got == brute_variants(rows) and len(got) > 150 and any(x[2] not in (x[0], x[1]) for x in got)


def test_long_words_repeats_and_ties(spark):
    """Edits in every part of words that take all levels and hashed names; doubled letters; equal counts."""
    base = "abcdefghij" * 6
    odd = [base, base[:3] + base[4:], base[:50] + "x" + base[51:], base + "q", base[:-1], "aaaaaa", "aaaaa", "aaaaaaa", "bbbbba", "bbbbbc", "bbbbbb", "Ébbbbbb", "a" * 3000, "a" * 2999, "a" * 1500 + "b" + "a" * 1499]
    rows = [(k, " ".join(odd[i] for i in range(len(odd)) for _ in range(1 + i % 3))) for k in range(1, 9)]
    rows += rows[:2]
    assert variants(spark, rows) == brute_variants(rows)


def test_no_words(spark):
    assert variants(spark, [(1, None), (2, "one two three")]) == []
    assert spelling.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- hard negatives


def brute_negatives(rows, positives=5, negatives=10):
    sound = {}
    for i, label, v in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[1], r[2])):
        if all(x is not None and np.isfinite(x) for x in v):
            sound.setdefault(i, (label, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]))
    out = []
    for a, (label, v) in sound.items():
        if a % 3:
            continue
        score = {b: sum(x * y for x, y in zip(v, w)) for b, (_, w) in sound.items() if b != a and len(w) == len(v)}
        first = lambda ids, k: sorted(ids, key=lambda b: (-score[b], b))[:k]  # noqa: B023, E731
        for p in first([b for b in score if sound[b][0] == label], positives):
            fit = [b for b in score if sound[b][0] != label and 30 * score[p] <= 100 * score[b] <= 90 * score[p]]
            out += [(a, p, k, b, score[p], score[b]) for k, b in enumerate(first(fit, negatives), 1)]
    return sorted(out)


def mined(spark, rows, **more):
    table = spark.createDataFrame([(*r, 1.5, 2) for r in rows], "vec_id long, label int, embedding array<float>, score double, n int")
    out = hard_negatives.hard_negatives(table, F.col("vec_id") % 3 == 0, **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def vectors(seed, n, dims, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    return [(int(i), int(rng.integers(labels)), [float(x) for x in (centres[rng.integers(6)] + rng.normal(size=dims) * 0.6).astype(np.float32)]) for i in range(n)]


def test_negatives_of_clusters_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    rows = vectors(1, 400, 6)
    got = mined(spark, rows, size=24)
    assert got == brute_negatives(rows) and len(got) > 1000


def test_negatives_of_odd_rows(spark):
    rows = vectors(2, 40, 3) + [(100 + i, 1, [0.5, 0.5, 0.5]) for i in range(30)] + [(200 + i, 2, [0.4, 0.4, 0.4]) for i in range(30)]
    rows += [(None, 1, [1.0, 1.0, 1.0]), (301, None, [1.0, 1.0, 1.0]), (302, 1, None), (303, 1, [1.0, None, 1.0]), (306, 1, [float("nan"), 1.0, 1.0]), (309, 2, [float("inf"), 1.0, 1.0])]
    rows += [(312, 1, [0.0, 0.0, 0.0]), (315, 1, []), (316, 1, []), (318, 2, []), (321, 1, [1.0, 2.0]), (322, 1, [1.0, 2.0]), (324, 2, [0.5, 1.0]), rows[0], rows[3], (3, 0, [9.0, 9.0, 9.0]), (327, 7, [1.0, 1.0, 1.0])]
    assert mined(spark, rows) == brute_negatives(rows)
    assert mined(spark, []) == []


def test_large_components_are_exact(spark):
    rows = [(i, i % 2, [3e6 + i, 2e6 - 7 * i, 1.25]) for i in range(30)]
    want = brute_negatives([(i, lab, [float(np.float32(x)) for x in v]) for i, lab, v in rows])
    assert mined(spark, rows) == want
    rng = np.random.default_rng(4)
    x = rng.integers(-(1 << 40), 1 << 40, (5, 4)).astype(np.float64)
    low, high = hard_negatives.intervals(np.minimum(x[:2], x[2:4]), np.maximum(x[:2], x[2:4]), x[4:])
    assert (low <= hard_negatives.products(x[4:], x[:2])).all() and (hard_negatives.products(x[4:], x[2:4]) <= high).all()
    assert hard_negatives.products(np.array([[1e30]]), np.array([[1e30], [-1e30]])).tolist() == [[2**63 - 1, -(2**63 - 1)]]
