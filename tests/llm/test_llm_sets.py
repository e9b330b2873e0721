"""License scans, packing, near-duplicates, repeated passages, media and vector search: brute force and edge cases."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from cuelake.llm import ann, license_scan, minhash, packing, progressive_jpeg, registry, suffix_dedup
from cuelake.llm.common import chunks, durable

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


# ---- license scans

TEXTS = [(1, None), (2, ""), (3, "The MIT License the mit-license"), (4, "cc"), (5, "Licensed under the Apache License, Version 2.0. CC BY-NC"), (5, "Licensed under the Apache License, Version 2.0. CC BY-NC"),
         (6, "gnu general public licence version 3"), (7, "GNU General Public License, version 3"), (8, "mıt the mİt license"), (9, "permission is hereby granted free of charge to any given person obtaining a copy of this software and associated documentation files " * 2), (None, "the mit license"),
         (10, "Released under the MIT License; under THE mit license. cc by nc"), (11, "under mit the license, Apache License version 2 by cc by nc cc by nc"), (12, "under the mit lıcense apache-license_version 2")]
#: The contract's base phrases, written out.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def base_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), sorted((i, label) for phrase, label in BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())


def test_license_scan_is_its_sql(spark):
    got = license_scan.scan(frame(spark, TEXTS)).drop("spans").collect()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", TEXTS)
    want = con.execute(license_scan.ORACLE).fetchall()
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and len(got) == len(TEXTS)
    by = {r["doc_id"]: r for r in got}
    for doc_id, text in TEXTS:
        n, places = base_places(text)
        first, last = (places[0][0], places[-1][0]) if places else (None, None)
        r = by[doc_id]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, len(places), first, last, ",".join(sorted({x for _, x in places})))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
    assert (by[3]["n_base"], by[3]["base_labels"], by[3]["labels"]) == (0, "", "mit")
    assert by[5]["base_labels"] == "apache-2,cc-by-nc" and by[7]["labels"] == "gpl-3" and by[6]["labels"] == "" and by[9]["labels"] == "mit" and by[9]["base_labels"] == ""
    assert by[1]["n_words"] == 0 and by[1]["first_word"] is None and by[1]["score"] == 0


def test_license_scan_empty(spark):
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_license_scan_is_native(spark):
    plan = license_scan.scan(frame(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- packing


def naive(sizes, sources, clusters, capacity, per_source):
    bins, out = [], []
    for s, a, c in zip(sizes, sources, clusters):
        fits = [(capacity - sum(x[0] for x in b), i) for i, b in enumerate(bins) if capacity - sum(x[0] for x in b) >= s and sum(x[1] == a for x in b) < per_source and (c is None or all(x[2] != c for x in b))]
        if not fits:
            bins.append([])
        i = min(fits)[1] if fits else len(bins) - 1
        out.append((i, sum(x[0] for x in bins[i])))
        bins[i].append((s, a, c))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_packing_is_best_fit(seed):
    r = random.Random(seed)
    n, capacity = r.randint(0, 150), r.choice([8, 30, 64])
    sizes = sorted((r.randint(1, capacity) for _ in range(n)), reverse=True)
    sources, clusters = [r.choice(["a", "a", "a", "b", None]) for _ in sizes], [r.choice([None, 1, 1, 1, *range(2, 40)]) for _ in sizes]
    assert packing.pack(sizes, sources, clusters, capacity, 3) == naive(sizes, sources, clusters, capacity, 3)


def test_packing_places_every_word_once(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(0, "a"), (5, "a"), (5, "a"), (25, None), (10, "b"), (3, "b")])] + [(None, "x y", "a"), (7, None, "a"), (1, "w " * 5, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.packed(packing.measured(docs), capacity=10, per_source=2).collect()
    assert sum(r["length"] for r in got) == 0 + 5 + 5 + 25 + 10 + 3 + 2 + 5
    bins = {}
    for r in got:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append((r["bin_offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert sum(n for _, n in b) <= 10 and all(x + n == y for (x, n), (y, _) in zip(b, b[1:]))
    assert packing.packed(packing.measured(docs.where("false"))).count() == 0


def test_packing_with_text_ids_and_clashing_columns(spark):
    rows = [("", "a b", "s", 1, "x"), (None, "c d", "s", 2, "x"), ("9", "e f", None, 3, "x"), ("10", None, "s", 4, "x"), (None, "c d", "s", 2, "x")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, length int, cluster string")
    got = packing.packed(packing.measured(docs), capacity=4).collect()
    assert sorted(("-" if r["doc_id"] is None else r["doc_id"], r["length"]) for r in got) == [("", 2), ("-", 2), ("-", 2), ("10", 0), ("9", 2)]
    assert [r["bin_id"] for r in got if r["length"] == 0] == [None]


def test_packing_query_is_best_fit_in_each_shard(spark, sf):
    """The query itself on more documents than a shard holds, against brute force shard by shard."""
    sf = sf.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    shards = -(-docs.count() // packing.SHARD)
    assert shards > 1
    dealt = {}
    for r in docs.selectExpr("*", f"pmod(xxhash64(doc_id), {shards}) as shard").collect():
        w = [x for x in re.split(r"[ \t\n\x0B\f\r]+", (r["text"] or "").lower()) if x]
        for k in range(-(-len(w) // packing.CAPACITY)):
            dealt.setdefault(r["shard"], []).append((-min(packing.CAPACITY, len(w) - k * packing.CAPACITY), r["doc_id"], k, r["source"], " ".join(w)))
    want = set()
    for n, pieces in dealt.items():
        pieces.sort(key=lambda p: p[:3])
        placed = naive([-p[0] for p in pieces], [p[3] for p in pieces], [p[4] for p in pieces], packing.CAPACITY, packing.PER_SOURCE)
        want |= {(p[1], p[2], -p[0], f"{n:06d}-{b:06d}", o) for p, (b, o) in zip(pieces, placed)}
    got = registry.QUERIES["op3_best_fit_packing"](spark, sf).where("bin_id is not null").collect()
    assert {(r["doc_id"], r["piece"], r["length"], r["bin_id"], r["bin_offset"]) for r in got} == want and len(got) == len(want)


def test_packing_deals_rows_that_share_an_id(spark):
    rows = [(None if i % 2 else 7, f"w{i} x y", "s") for i in range(1200)]
    got = packing.packed(packing.measured(spark.createDataFrame(rows, "doc_id long, text string, source string")), capacity=30, shard=64).collect()
    assert len(got) == len(rows) and all(r["length"] == 3 for r in got)
    shards = [r["bin_id"].split("-")[0] for r in got]
    assert len(set(shards)) > 10 and max(map(shards.count, set(shards))) < 200


# ---- near-duplicates


def brute_classes(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_rows(seed, n=160, base=3, edits=14, words=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    bases = [[r.choice(vocabulary) for _ in range(words)] for _ in range(base)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i * 3 + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_are_brute_force(spark, seed):
    rows = near_rows(seed) + [(1000, None), (1001, ""), (1002, " \t"), (1003, "Two words"), (1004, "two  WORDS"), (1005, "x" * 50000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.classes(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_edge_cases(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (6, None)]
    got = minhash.classes(frame(spark, rows)).collect()
    assert len(got) == 5 and {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(1, 1, True), (None, None, True), (5, 1, False), (6, 6, True)}
    assert minhash.classes(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_with_two_texts_under_one_id(spark, seed):
    """The smallest doc_id has a text of each of two groups: in mixed buckets both its texts keep their own links."""
    rows = [(i, t) for i, (_, t) in enumerate(near_rows(seed, n=120, base=2, edits=12), 1)]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    far = next(i for i, _ in rows[1:] if not sets[1] & sets[i])
    want = brute_classes(rows)
    root = {c: (1 if c == want[far][1] else c) for c in {c for _, c in want.values()}}
    moved = [(1 if i == far else i, t) for i, t in rows]
    got = {(r["doc_id"], r["component_id"]) for r in minhash.classes(frame(spark, moved)).collect()}
    assert got == {(1 if i == far else i, root[c]) for i, (_, c) in want.items()}


@pytest.mark.parametrize("size", [4, 7, 300])
def test_links_across_parts_of_a_bucket(spark, size):
    """One bucket of all texts, half a class already joined: every part meets every other and itself, and no link is lost."""
    rows = near_rows(5, n=60, base=2, edits=10)
    want = brute_classes(rows)
    main = [d for d, (_, c) in want.items() if c == max(want.values(), key=lambda v: [c for _, c in want.values()].count(v[1]))[1]][::2]
    nodes = spark.createDataFrame([(d, [7, d]) for d, _ in rows], "node long, bands array<long>")
    mixed = spark.createDataFrame([(7, d, len(rows), len(rows) - len(main), main[0] if d in main else d, d not in main) for d, _ in rows], "band long, node long, k long, u long, component long, other boolean")
    found = [tuple(r) for r in minhash.links_across(mixed, nodes, spark.createDataFrame(rows, "node long, text string"), size).collect()]
    assert len(main) > 3 and all(not {a, b} <= set(main) for a, b in found)
    got = linked(found + [(main[0], d) for d in main])
    assert {d: got.get(d, d) for d, _ in rows} == {d: c for d, (_, c) in want.items()}


def linked(edges):
    """Union-find: the smallest node that each node reaches."""
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def _chain(n, r):
    ids = list(range(n))
    r.shuffle(ids)
    return list(zip(ids, ids[1:]))


def _grid(n, r):
    ids = list(range(n * n))
    r.shuffle(ids)
    return [(ids[i * n + j], ids[i * n + j + 1]) for i in range(n) for j in range(n - 1)] + [(ids[i * n + j], ids[i * n + n + j]) for i in range(n - 1) for j in range(n)]


@pytest.mark.parametrize("shape", ["chain of 150", "chain of 10000", "grid", "star and pairs"])
def test_components(spark, monkeypatch, shape):
    r = random.Random(shape)
    edges = {"chain of 150": lambda: _chain(150, r), "chain of 10000": lambda: _chain(10000, r), "grid": lambda: _grid(40, r), "star and pairs": lambda: [(500, i) for i in range(400)] + [(1000, 1001), (1001, 1000), (1003, 1002)]}[shape]()
    written = []
    monkeypatch.setattr(minhash, "durable", lambda df: written.append(1) or durable(df))
    got = {r["node"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == linked(edges)
    assert len(written) / 2 <= 2 * np.log2(len(got)) + 2  # two tables a round
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_a_very_long_text(spark):
    r = random.Random(9)
    words = [f"w{r.randrange(5000)}" for _ in range(250_000)]
    near = list(words)
    for _ in range(2000):
        near[r.randrange(len(near))] = "x"
    rows = [(5, " ".join(words)), (3, " ".join(near)), (4, " ".join(words[: len(words) // 2])), (1, "short text of five words or six")]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.classes(frame(spark, rows)).collect()}
    assert got == brute_classes(rows) and got[5][1] == 3


# ---- repeated passages


def brute_passages(rows, length=suffix_dedup.LENGTH):
    first, out = {}, []
    for d, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            first[b[s : s + length]] = min(first.get(b[s : s + length], d), d)
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < d:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_passages_are_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 4000)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 3000)
    r = random.Random(seed)
    passages = ["".join(r.choice("abcdé ") for _ in range(r.randint(30, 160))) for _ in range(8)] + ["aaaa" * 40, "ab" * 60]
    rows = [(i, "".join(r.choice([r.choice(passages), "".join(r.choice("xyz ") for _ in range(r.randint(0, 70)))]) for _ in range(r.randint(0, 9)))) for i in r.sample(range(1000), 60)]
    rows += [(2000, rows[0][1]), (2001, rows[1][1]), (2002, None), (2003, ""), (2004, "a" * 49), (2004, "a" * 49)]
    got = sorted(tuple(x) for x in suffix_dedup.deduplicated(frame(spark, rows)).collect())
    assert got == brute_passages(rows)


@pytest.mark.parametrize("kind", ["phrase", "line"])
def test_passages_with_one_prefix_everywhere(spark, monkeypatch, kind):
    """A phrase (24 to 49 bytes) or a line (50 to 75 bytes) in changing surroundings in all documents: one run of many buckets."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 2000)
    monkeypatch.setattr(suffix_dedup, "SPLIT_TOKENS", 200)
    r = random.Random(kind)
    common = "the same words in every text" + (", and then a good many more of them" if kind == "line" else "")
    sides = ["".join(r.choice("abcd") for _ in range(40)) for _ in range(7)]
    rows = [(i, "".join(r.choice(sides)[-r.randint(1, 40) :] + common + r.choice(sides)[: r.randint(1, 40)] for _ in range(3))) for i in r.sample(range(1000), 80)]
    opened = []
    real = suffix_dedup.durable
    monkeypatch.setattr(suffix_dedup, "durable", lambda df: opened.append(real(df)) or opened[-1])
    got = sorted(tuple(x) for x in suffix_dedup.deduplicated(frame(spark, rows)).collect())
    assert got == brute_passages(rows)
    found = opened[-1].where("window is not null")
    assert found.groupBy("window").agg({"doc": "min"}).count() < found.count()  # some windows did go on in other buckets


def test_passages_by_sorted_order():
    """Windows of contexts under random reaches, cut into two buckets, against a dictionary of their bytes."""
    S, rng = suffix_dedup, np.random.default_rng(3)
    context = rng.integers(97, 99, (400, S.CONTEXT)).astype(np.uint8)
    context[:, S.LEFT : S.LEFT + S.TOKEN] = 97
    context[::3, 10:70] = context[0, 10:70]
    docs, reach = rng.integers(0, 90, 400), np.sort(rng.integers(0, S.WIDTH, (400, 2)), axis=1)
    step = np.arange(S.CONTEXT) - S.LEFT
    context[(step < -reach[:, 1:]) | (step >= S.LENGTH - reach[:, :1])] = 0
    first, windows = {}, [(i, o, context[i, S.LEFT - o : S.LEFT - o + S.LENGTH].tobytes()) for i in range(400) for o in range(reach[i, 0], reach[i, 1] + 1)]
    for i, o, w in windows:
        first[w, o] = min(first.get((w, o), 1000), docs[i])
    want = {(i, o) for i, o, w in windows if first[w, o] < docs[i]}
    gone, still = S.compared(context, docs, reach, None, None)
    assert set(zip(*map(np.ndarray.tolist, np.nonzero(gone)))) == want and not still.any()
    key = S.in_order(context)
    limit = np.array(sorted(k.tobytes() for k in key[::3])[60:61], f"S{S.CONTEXT}")
    at = np.searchsorted(limit, S._as_strings(key), "right")
    found, open_ = set(), {}
    for k in (0, 1):
        i = np.flatnonzero(at == k)
        gone, still = S.compared(context[i], docs[i], reach[i], limit.view(np.uint8) if k else None, None if k else limit.view(np.uint8))
        found |= {(int(i[a]), int(b)) for a, b in zip(*np.nonzero(gone))}
        for a, o in zip(*np.nonzero(still)):
            open_.setdefault((context[i[a], S.LEFT - o : S.LEFT - o + S.LENGTH].tobytes(), o), []).append((docs[i[a]], int(i[a]), int(o)))
    later = {(i, o) for group in open_.values() for d, i, o in group if d > min(group)[0]}
    assert found | later == want and later


def test_passages_edge_cases(spark):
    text = "0123456789" * 8
    rows = [(3, text), (3, text), (None, text), (9, "é" + text + "ü")]
    got = {(r["doc_id"], r["n_removed"]) for r in suffix_dedup.deduplicated(frame(spark, rows), with_text=True).collect()}
    assert got == {(3, 0), (None, 0), (9, 80)}
    assert suffix_dedup.deduplicated(frame(spark, [])).count() == 0


def test_passages_of_a_very_long_text(spark):
    """A text of 400 kB that holds another document's passage twice, and its copy."""
    r = random.Random(5)
    filler = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage = filler(900)
    long = filler(200_000) + passage + filler(150_000) + passage + filler(50_000)
    rows = [(1, "head " + passage + " tail"), (2, long), (3, long)]
    got = sorted(tuple(x) for x in suffix_dedup.deduplicated(frame(spark, rows)).collect())
    assert got == brute_passages(rows)


def test_passages_with_two_texts_under_one_id(spark):
    text = "0123456789" * 9
    rows = [(1, text), (2, "x" + text), (2, "other words " * 9)]
    got = {(r["doc_id"], r["text_sha256"]): bytes(r["kept"]) for r in suffix_dedup.deduplicated(frame(spark, rows), with_text=True).collect()}
    assert got == {(d, hashlib.sha256(t.encode()).hexdigest()): k for (d, t), k in zip(rows, (text.encode(), b"x", b"other words " * 9))}


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 4, (5000, 5)).astype(np.uint64)
    got = words[suffix_dedup.multikey_quicksort(words, small=16)].tolist()
    assert got == sorted(words.tolist())


def test_anchors_cover_every_window():
    data = np.frombuffer(("the quick brown fox " * 30).encode() + bytes(range(200)), np.uint8)
    ends = np.array([450, len(data)])
    p, _, lo, hi = suffix_dedup.anchors(data, ends)
    windows = sorted(x for a, b, c in zip(p, lo, hi) for x in range(a - c, a - b + 1))
    assert windows == [*range(450 - 49), *range(450, len(data) - 49)]


# ---- media


def test_jpeg_round_trip():
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 192 * n, dtype=np.uint8).tobytes() for n in (1, 2, 5, 9, 31)] + [b" " * 192, bytes([128]) * 384, bytes([129, 127, 128, 0, 255, 1]) * 64, progressive_jpeg.padded("héllo Á À ".encode() * 60)]
    streams = progressive_jpeg.write(payloads)
    assert progressive_jpeg.payloads(streams) == payloads
    assert [progressive_jpeg.payloads([s])[0] for s in streams] == payloads
    with pytest.raises(ValueError):
        progressive_jpeg.write([b""])
    with pytest.raises(ValueError):
        progressive_jpeg.read([b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00\xff\xd9"])


def scalar_jpeg(blocks, sampling, size, quant):
    """A slow writer with 4:2:0, spectral selection, one held-back bit, and runs of ended blocks. blocks: component -> rows x columns
    x 64 coefficients in zigzag order, padded to whole MCUs."""
    J = progressive_jpeg
    hmax, vmax = max(s[0] for s in sampling), max(s[1] for s in sampling)
    mcus = -(-size[0] // (8 * vmax)), -(-size[1] // (8 * hmax))
    out = bytearray(b"\xff\xd8" + J._segment(0xDB, bytes([0]) + bytes(quant)))
    out += J._segment(0xC4, b"".join(bytes([k]) + t[0] for k, t in ((0, J.DC_TABLE), (0x10, J.AC_TABLE), (0x11, J.REFINE_TABLE))))
    out += J._segment(0xC2, bytes([8]) + size[0].to_bytes(2, "big") + size[1].to_bytes(2, "big") + bytes([3]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))

    def scan(header, bits):
        text = "".join(bits)
        text += "1" * (-len(text) % 8)
        data = bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\0")
        return header + data

    def code(table, symbol):
        return format(int(table[1][symbol]), f"0{int(table[2][symbol])}b")

    def value(x):
        n = abs(x).bit_length()
        return format(x if x > 0 else x + (1 << n) - 1, f"0{n}b") if n else ""

    bits, last = [], [0, 0, 0]
    for y in range(mcus[0]):
        for x in range(mcus[1]):
            for c, (h, v) in enumerate(sampling):
                for i in range(v):
                    for j in range(h):
                        dc = int(blocks[c][y * v + i, x * h + j, 0]) >> 1
                        d, last[c] = dc - last[c], dc
                        bits.append(code(J.DC_TABLE, abs(d).bit_length()) + value(d))
    out += scan(J._scan_header([1, 2, 3], 0, 0, 0, 0, 0, 1), bits)
    order = []
    for c, (h, v) in enumerate(sampling):
        rows, columns = -(-(-(-size[0] * v // vmax)) // 8), -(-(-(-size[1] * h // hmax)) // 8)
        order.append([blocks[c][y, x] for y in range(rows) for x in range(columns)])
    for c in range(3):
        bits, ended = [], 0

        def flush():
            nonlocal ended
            if ended:
                r = ended.bit_length() - 1
                bits.append(code(J.AC_TABLE, r << 4) + (format(ended - (1 << r), f"0{r}b") if r else ""))
                ended = 0

        for b in order[c]:
            run, half = 0, [int(np.sign(x)) * (abs(int(x)) >> 1) for x in b]
            top = max((k for k in range(1, 64) if half[k]), default=0)
            for k in range(1, top + 1):
                if not half[k]:
                    run += 1
                    continue
                flush()
                while run > 15:
                    bits.append(code(J.AC_TABLE, 0xF0))
                    run -= 16
                bits.append(code(J.AC_TABLE, run << 4 | abs(half[k]).bit_length()) + value(half[k]))
                run = 0
            if top < 63:
                ended += 1
        flush()
        out += scan(J._scan_header([c + 1], 0, 0, 1, 63, 0, 1), bits)
    bits = []
    for y in range(mcus[0]):
        for x in range(mcus[1]):
            for c, (h, v) in enumerate(sampling):
                bits += [str(int(blocks[c][y * v + i, x * h + j, 0]) & 1) for i in range(v) for j in range(h)]
    out += scan(J._scan_header([1, 2, 3], 0, 0, 0, 0, 1, 0), bits)
    for c in range(3):
        v = np.array(order[c])
        value_, length, _ = J._ac_refine(v)
        out += scan(J._scan_header([c + 1], 0, 1, 1, 63, 1, 0), [format(int(a), f"0{int(n)}b") for a, n in zip(value_, length)])
    return bytes(out + b"\xff\xd9")


def test_jpeg_subsampled_chroma_and_pixels():
    rng = np.random.default_rng(2)
    sampling, size, quant = [(2, 2), (1, 1), (1, 1)], (37, 52), [3] * 64
    mcus = -(-size[0] // 16), -(-size[1] // 16)
    blocks = [rng.integers(-9, 10, (mcus[0] * v, mcus[1] * h, 64)) * (rng.random((mcus[0] * v, mcus[1] * h, 64)) < 0.2) for h, v in sampling]
    for c, (h, v) in enumerate(sampling):  # blocks that no scan of one component reaches
        rows, columns = -(-(-(-size[0] * v // 2)) // 8), -(-(-(-size[1] * h // 2)) // 8)
        blocks[c][rows:, :, 1:], blocks[c][:, columns:, 1:] = 0, 0
    stream = scalar_jpeg(blocks, sampling, size, quant)
    pictures, got = progressive_jpeg.read([stream, stream])
    want = np.concatenate([b.reshape(-1, 64) for b in blocks])
    assert (got == np.concatenate([want, want])).all()
    planes = []
    for c, (h, v) in enumerate(sampling):
        y, x = np.mgrid[0:8, 0:8]
        plane = np.zeros((blocks[c].shape[0] * 8, blocks[c].shape[1] * 8))
        for i in range(blocks[c].shape[0]):
            for j in range(blocks[c].shape[1]):
                f = np.zeros(64)
                f[progressive_jpeg.ZIGZAG] = blocks[c][i, j] * 3
                f = f.reshape(8, 8)
                s = sum((0.5**0.5 if u == 0 else 1) * (0.5**0.5 if w == 0 else 1) / 4 * f[u, w] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * w * np.pi / 16) for u in range(8) for w in range(8))
                plane[i * 8 : i * 8 + 8, j * 8 : j * 8 + 8] = np.clip(s + 128, 0, 255)
        planes.append(np.repeat(np.repeat(plane, 2 // v, 0), 2 // h, 1)[: size[0], : size[1]])
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1), 0, 255)
    got = progressive_jpeg.tensors([stream])[0]
    assert got.shape == (37, 52, 3) and np.abs(got - rgb).max() <= 2


def slow_refinement(v):
    """The refinement scan's bit strings, coefficient by coefficient."""
    _, code, bits = progressive_jpeg.REFINE_TABLE
    out = []
    for block in v[:, 1:].tolist():
        tokens, run, waiting = [], 0, []
        end = max((k for k, x in enumerate(block) if abs(x) == 1), default=-1)
        for k, x in enumerate(block):
            if x == 0:
                run += 1
                continue
            while run > 15 and k <= end:
                tokens += [(int(code[0xF0]), int(bits[0xF0])), *waiting]
                run, waiting = run - 16, []
            if abs(x) > 1:
                waiting.append((abs(x) & 1, 1))
                continue
            tokens += [(int(code[run << 4 | 1]), int(bits[run << 4 | 1])), (int(x > 0), 1), *waiting]
            run, waiting = 0, []
        if run or waiting:
            tokens += [(int(code[0]), int(bits[0])), *waiting]
        out.append("".join(format(a, f"0{n}b") for a, n in tokens))
    return out


def test_jpeg_refinement_is_slow_refinement():
    rng = np.random.default_rng(4)
    v = rng.integers(-3, 4, (300, 64)) * (rng.random((300, 64)) < rng.random((300, 1)))
    v[::7] = rng.integers(2, 50, (43, 64))
    v[1], v[2, 1:], v[3, :63], v[3, 63] = 0, 0, 0, 1
    value, length, row = progressive_jpeg._ac_refine(v)
    got = [""] * len(v)
    for a, n, r in zip(value.tolist(), length.tolist(), row.tolist()):
        got[r] += format(a, f"0{n}b")
    assert got == slow_refinement(v)


def test_jpeg_columns(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "x" * 1000), (4, "é" * 400), (4, "é" * 400), (5, "привет, мир " * 300), (6, "字" * 700_000)])
    media = progressive_jpeg.stored(docs)
    rows = progressive_jpeg.decoded(media, with_payload=True).collect()
    for r in rows:
        p = progressive_jpeg.padded((r["text"] or "").encode())
        image = progressive_jpeg.tensors([bytes(r["media"])])[0]
        assert bytes(r["image"]["payload"]) == p and bytes(r["image"]["rgb"]) == image.tobytes() and image.shape == (r["image"]["height"], r["image"]["width"], 3)
        assert image.shape[1] == (32 if r["doc_id"] == 6 else 16)
    assert len({bytes(r["image"]["rgb"]) for r in rows if r["doc_id"] == 4}) == 1 and len(rows) == 7
    nothing = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert progressive_jpeg.decoded(nothing).first()["image"] is None
    assert progressive_jpeg.decoded(progressive_jpeg.stored(frame(spark, []))).count() == 0


def test_jpeg_chroma_of_the_stored_form():
    """The stored form's images by the general way: planes of each component, upsampled."""
    J = progressive_jpeg
    streams = J.write([np.random.default_rng(5).integers(60, 200, 192 * n, dtype=np.uint8).tobytes() for n in (1, 5, 9000)])
    pictures, coefficients = J.read(streams)
    s = J.samples(J._natural(pictures, coefficients))
    for p, got in zip(pictures, J.images(pictures, coefficients)):
        planes = []
        for c in p.components:
            own = s[p.base + c["base"] : p.base + c["base"] + c["rows"] * c["columns"]].reshape(c["rows"], c["columns"], 8, 8).transpose(0, 2, 1, 3).reshape(c["rows"] * 8, -1)
            planes.append(np.repeat(np.repeat(own, 2 // c["v"], 0), 2 // c["h"], 1))
        assert (J._coloured(planes[0], J._tints(*planes[1:])) == got).all() and got.shape == (p.height, p.width, 3)


@pytest.mark.parametrize("units", [5, 4096, 5700, 8193, 12_001])
def test_jpeg_strips_are_the_whole_picture(units):
    """Long payloads, a strip at a time: the bytes, pixels and contents of one picture, of one column of MCUs or two."""
    J = progressive_jpeg
    p = np.random.default_rng(units).integers(0, 256, 192 * units, dtype=np.uint8).tobytes()
    stream = J.write([p])[0]
    assert J.write_long(p) == stream
    pictures, coefficients = J.read([stream])
    strips = list(J.read_strips(stream))
    assert len(strips) == -(-pictures[0].mcus[0] // J._strip_rows(pictures[0].mcus[1])) and (units < 4097) == (len(strips) == 1)
    assert np.concatenate([J.images([q], c)[0] for q, c in strips]).tobytes() == J.images(pictures, coefficients)[0].tobytes()
    assert b"".join(J.contents([q], c)[0] for q, c in strips) == p
    if len(strips) > 1:
        begin = stream.index(b"\xff\xd0")
        with pytest.raises(ValueError):
            list(J.read_strips(stream[:begin] + stream[begin + 2 :]))
    with pytest.raises(ValueError):
        J.write_long(b"")


def test_jpeg_other_streams_come_whole():
    J = progressive_jpeg
    stream = J.write([b"a" * 192])[0].replace(b"\xff\xdd\x00\x04\x00\x04", b"\xff\xdd\x00\x04\x00\x08")
    (picture, coefficients), *rest = J.read_strips(stream)
    assert not rest and (coefficients == J.read([stream])[1]).all() and picture.height == 16


def test_media_query(spark, sf):
    rows = {r["doc_id"]: r for r in registry.QUERIES["op9_progressive_jpeg"](spark, sf).collect()}
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        raw = (text or "").encode()
        p = progressive_jpeg.padded(raw)
        image = progressive_jpeg.tensors(progressive_jpeg.write([p]))[0]
        assert rows[doc_id]["feature"] == f"{image.shape[0]}x{image.shape[1]} rgb={zlib.crc32(image.tobytes()):08x}"
        assert (rows[doc_id]["n_bytes"], rows[doc_id]["payload_bytes"], rows[doc_id]["payload_sha256"], rows[doc_id]["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))


# ---- vector search


def test_hilbert_curve_is_continuous():
    side = 8
    points = np.stack(np.meshgrid(*[np.arange(side)] * 3), -1).reshape(-1, 3)
    walk = points[np.argsort(ann.hilbert(points, 3))]
    assert sorted(ann.hilbert(points, 3)) == list(range(side**3)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def brute_neighbours(rows, k=20):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)})
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good], float)
    out = {}
    for i, v in good:
        if i % 20 == 0:
            s = x @ np.array(v)
            out[i] = [int(ids[j]) for j in np.lexsort((ids, -np.round(s, 9))) if ids[j] != i][:k]
    return out


def test_neighbours_edge_cases(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(a)) for a in rng.normal(size=4)]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(40)] + [(200, None), (220, []), (240, [0.0] * 4), (260, [1.0, None, 0.0, 0.0]), (280, [float("nan"), 1.0, 0.0, 0.0]), (300, [1.0, 2.0]), (None, rows[0][1]), rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.neighbours(df, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute_neighbours([r for r in rows if r[0] != 300])
    assert got == want
    assert ann.neighbours(df.where("false"), "vec_id % 20 = 0").count() == 0


def test_neighbours_of_cells_that_many_visit(spark, monkeypatch):
    """Queries of a cell in several parts."""
    monkeypatch.setattr(ann, "VISITS", 5)
    rng = np.random.default_rng(6)
    rows = [(i * 4, [float(np.float32(a)) for a in rng.normal(size=3)]) for i in range(300)]
    got = {}
    for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == brute_neighbours(rows)


def test_neighbours_leave_clashing_columns_alone(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(a)) for a in rng.normal(size=6)]) for i in range(100)]
    names = ["n", "rep", "curve", "key", "turn", "place", "low", "ids", "query", "rows"]
    df = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], "vec_id long, embedding array<float>, " + ", ".join(f"{n} string" for n in names))
    got = {}
    for r in ann.neighbours(df, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == brute_neighbours(rows)


def test_places_are_ranks(spark):
    """Places of entries and queries on every curve, over several partitions, against a sort."""
    rng = np.random.default_rng(8)
    rows = [(n, f"r{i:03d}", c, int(rng.integers(0, 6)), 0, bool(i % 5 == 0)) for i in range(300) for n in (3, 4) for c in range(2)]
    df = spark.createDataFrame(rows, "n int, rep string, curve int, key long, turn int, asked boolean").repartition(5)
    got = {(r["n"], r["curve"], r["rep"], r["asked"]): r["place"] for r in ann.placed(df).collect()}
    want = {}
    for n in (3, 4):
        for c in range(2):
            before = 0
            for r in sorted((r for r in rows if (r[0], r[2]) == (n, c)), key=lambda r: (r[3], r[5], r[1])):
                want[n, c, r[1], r[5]] = before
                before += not r[5]
    assert got == want


def test_windows_narrow_where_vectors_cluster(spark):
    """On clusters, fitted windows cost less than a scan and still find the neighbours."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(300, 24))
    rows = [(i, [float(np.float32(a)) for a in centres[i % 300] + 0.2 * rng.normal(size=24)]) for i in range(12_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    kept = []
    real = ann.fitted
    ann.fitted = lambda *a: kept.append(real(*a)) or kept[-1]
    try:
        got = {}
        for r in ann.neighbours(df, "vec_id % 400 = 0").collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
    finally:
        ann.fitted = real
    fit = kept[0].first()
    assert fit["turns"] * (2 * fit["width"] + fit["rows"]) < 0.8 * fit["held"]
    x = np.array([v for _, v in rows])
    hit = 0
    for q in got:
        s = x @ x[q]
        s[q] = -9
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit >= 0.9 * 20 * len(got) and len(got) == 30


def test_neighbours_of_each_length(spark):
    """A row with one component too many finds others of its length and leaves the rest alone."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(a)) for a in rng.normal(size=4)]) for i in range(50)]
    other = [(1000 + i, [float(np.float32(a)) for a in rng.normal(size=5)]) for i in range(8)]
    for more in (other, other[:1]):
        df = spark.createDataFrame(rows + more, "vec_id long, embedding array<float>")
        got = {}
        for r in ann.neighbours(df, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        want = {**brute_neighbours(rows), **brute_neighbours(more)}
        assert got == {q: w for q, w in want.items() if w}


def test_neighbours_recall(spark, sf):
    rows = [(r[0], list(r[1])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = brute_neighbours(rows), {}
    for r in registry.QUERIES["op10_hilbert_ann"](spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(got[q] & set(w)) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_chunks_of_nothing():
    import pyarrow as pa

    assert list(chunks(pa.array([], pa.string()))) == []
