"""Near-duplicate detection with circulant MinHash: two permutations, one circularly shifted, generate all signature
coordinates; banding proposes pairs, exact Jaccard similarity on the full shingle sets confirms them.

A document's set holds its distinct 5-word shingles (with fewer words, the whole sequence as one). Signature coordinate k of a
set is min over x of pi(sigma(x) + k), the sum modulo 2^32: sigma scrambles a shingle once, pi is applied after the
circular shift. ``BANDS`` bands of ``ROWS`` coordinates miss a pair of similarity 0.75 with probability 5e-6.

Documents with equal sets are one node from the start (they are linked with all their links), so copies are never compared.
Within a band's bucket no list of pairs is made: every member is first compared with one centre, the member that shares most
buckets. Components of the confirmed links follow by propagating smallest ids. Only in buckets that still hold several
components do members meet again, in small groups of two parts of a bucket each, where members of different components are
compared by matrix products; only links come out. So no link that banding proposes is lost. Comparisons run on the full sets,
made anew from the texts.

Edge cases: null, empty and blank texts have an empty set, n_shingles 0, and are linked with nothing; repeated
rows (one doc_id, one text) are one node and come out as often as they went in, and a doc_id that stands for several texts takes
the smallest of their classes; a null doc_id is its own class (null, kept); an empty table gives an empty result; only doc_id
and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_VALUES, batch_udf, chunks, discard, durable, mix, prefix_sums, span_hashes, spans, tune

WORDS = 5
BANDS, ROWS = 32, 4
NUMERATOR = 75
_WORD = ~np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_PLACES = mix(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, sorted distinct 64-bit shingle hashes of consecutive rows, row bounds) for about a megabyte of
    texts at a time."""
    for c in chunks(texts):
        starts, ends, piece = spans(c, _WORD)
        h = span_hashes(prefix_sums(c.data, LOWER_VALUES), starts, ends)
        m = len(c.starts)
        n = np.bincount(piece, minlength=m)
        x = np.zeros(max(len(h) - WORDS + 1, 0), np.uint64)
        for k in range(WORDS if len(x) else 0):
            x += h[k : k + len(x)] * _PLACES[k]
        whole = piece[: len(x)] == piece[WORDS - 1 :] if len(x) else np.zeros(0, bool)
        few = np.flatnonzero((n > 0) & (n < WORDS))
        base = np.cumsum(n) - n
        rest = [np.sum(h[base[i] : base[i] + n[i]] * _PLACES[: n[i]], dtype=np.uint64) + np.uint64(n[i]) for i in few]
        value = mix(np.concatenate([x[whole], np.array(rest, np.uint64)]))
        owner = np.concatenate([piece[: len(x)][whole], few])
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        keep = np.ones(len(value), bool)
        keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[keep], owner[keep]
        yield int(c.docs[0]) if m else 0, value, np.searchsorted(owner, np.arange(m + 1))


def _pi(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit integers."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Circulant MinHash of each non-empty set, rows x (BANDS * ROWS)."""
    sigma = (mix(value ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((BANDS * ROWS, len(bounds) - 1), np.uint32)
    for k in range(len(out)):
        out[k] = np.minimum.reduceat(_pi(sigma + np.uint32(k * 0x01F35D5B & 0xFFFFFFFF)), bounds[:-1])
    return out.T


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band."""
    s = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    h = np.zeros(s.shape[:2], np.uint64)
    for r in range(ROWS):
        h = mix(h + s[:, :, r] + np.uint64(r + 1))
    return (h + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _described(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        n, digest, bands = np.zeros(len(texts), np.int64), [b""] * len(texts), [None] * len(texts)
        for first, value, bounds in shingle_sets(texts):
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            n[first : first + len(size)] = size
            if len(full):
                keys = band_hashes(signatures(value, np.append(bounds[full], bounds[-1])))
                for i, row in zip(full, keys):
                    digest[first + i] = hashlib.blake2b(value[bounds[i] : bounds[i + 1]].tobytes(), digest_size=16).digest()
                    bands[first + i] = row
        yield pa.StructArray.from_arrays([pa.array(n), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["n", "digest", "bands"])


def described(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, key (a hash of the text), n (set size), digest (of the set) and bands (keys; null without shingles) of every row."""
    tune(docs.sparkSession)
    made = docs.select("doc_id", F.xxhash64(text_col).alias("key"), batch_udf(_described, "n long, digest binary, bands array<long>")(F.col(text_col)).alias("_d"))
    return made.select("doc_id", "key", "_d.*")


def _similar(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in pairs:
        inner, outer = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        lo = 0
        size = pa.compute.binary_length(a.fill_null("")).to_numpy(zero_copy_only=False) + pa.compute.binary_length(b.fill_null("")).to_numpy(zero_copy_only=False)
        cut = np.cumsum(size)
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(cut, (cut[lo - 1] if lo else 0) + (1 << 20))))
            joined = pa.concat_arrays([a[lo:hi], b[lo:hi]])
            parts = [(first, v, bounds) for first, v, bounds in shingle_sets(joined)]
            row = np.concatenate([np.repeat(np.arange(first, first + len(bounds) - 1), np.diff(bounds)) for first, _, bounds in parts])
            value, m = np.concatenate([v for _, v, _ in parts]), hi - lo
            n = np.bincount(row, minlength=2 * m)
            row %= m
            order = np.lexsort((value, row))
            v, r = value[order], row[order]
            both = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
            inner[lo:hi] = np.bincount(r[1:][both], minlength=m)
            outer[lo:hi] = n[:m] + n[m:] - inner[lo:hi]
            lo = hi
        yield pa.array((100 * inner >= NUMERATOR * outer) & (outer > 0))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. texts: node, text, one row a node."""
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("_ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("_tb"))
    _similar.__annotations__ = {"pairs": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    test = F.arrow_udf(_similar, "boolean")
    return pairs.join(right, "b").join(left, "a").where(test("_ta", "_tb")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): component is the smallest node that can be reached.

    Random contraction: every round ranks the nodes anew by a hash, each node moves to the lowest-ranked of itself and its neighbours,
    and edges within a node vanish. That leaves about half of the nodes of a path in whatever order its ids stand, and fewer
    elsewhere, so the rounds are logarithmic for any graph; each works only on what the last one left."""
    steps, left = [], durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        ways = left.select("a", rank("b").alias("to")).union(left.select("b", rank("a")))
        best = ways.groupBy("a").agg(F.min("to").alias("to")).select(F.col("a").alias("node"), F.when(F.col("to") < rank("a"), F.col("to.n")).otherwise(F.col("a")).alias("into"))
        step = durable(best)
        moved = left.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").where("x <> y")
        left, done = durable(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()), left
        if steps:
            discard(done)
        steps.append(step)
    if not steps:
        return nodes.withColumn("component", F.col("node"))
    # from the last step back to the first: where each node has ended
    ended = steps[-1]
    for k, step in enumerate(reversed(steps[:-1]), 1):
        ended = step.join(ended.select(F.col("node").alias("into"), F.col("into").alias("end")), "into", "left").select("node", F.coalesce("end", "into").alias("into"))
        if k % 6 == 0:
            ended = durable(ended)
    ended = durable(ended)
    least = ended.groupBy("into").agg(F.min("node").alias("component"))
    labels = durable(ended.join(least, "into").select("node", "component"))
    discard(*steps, ended)
    return labels


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, with that component, the bucket's size k, and the number u of
    members outside its largest component (``other``)."""
    named = members.join(labels.withColumnRenamed("component", "_c"), "node", "left").withColumn("component", F.coalesce("_c", "node")).drop("_c")
    sizes = named.groupBy("band", "component").count()
    many = sizes.groupBy("band").agg(F.sum("count").alias("k"), F.max(F.struct("count", "component")).alias("_m")).where("k > _m.count")
    many = many.select("band", "k", (F.col("k") - F.col("_m.count")).alias("u"), F.col("_m.component").alias("_main"))
    return named.join(many, "band").withColumn("other", F.col("component") != F.col("_main")).drop("_main")


def links_between(sets: list[np.ndarray], ask: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of sets that reach the similarity among those asked for (a symmetric matrix of booleans). Of the pairs that a path of
    others already joins, only the first few needed to join them are returned."""
    m, size = len(sets), np.array([len(x) for x in sets])
    value, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    number, count = np.unique(value, return_inverse=True, return_counts=True)[1:]
    common = count >= 2
    column = np.cumsum(common) - 1
    use = common[number]
    column, owner = column[number[use]], owner[use]
    inner = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        x, z = np.searchsorted(column, [lo, lo + 4096])
        present = np.zeros((m, 4096), np.float32)
        present[owner[x:z], column[x:z] - lo] = 1
        inner += present @ present.T
    outer = size[:, None] + size[None, :] - inner
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu((100 * inner >= NUMERATOR * outer) & ask, 1))):
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[b] = a
            out.append((int(i), int(j)))
    return out


def _block_links(key, table):
    """Links between the two parts of a bucket that meet in a group (of one part with itself: among its texts), among texts of
    different components. A pair of texts is looked at only in the first band that they share."""
    band, i, j = (k.as_py() for k in key)
    nodes, side, component = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "side", "component"))
    keys = np.array(table.column("bands").to_pylist())
    sets: list[np.ndarray] = []
    for _, value, bounds in shingle_sets(table.column("text").combine_chunks()):
        sets += [value[x:z] for x, z in zip(bounds[:-1], bounds[1:])]
    size = np.array([len(x) for x in sets])
    ask = ((side[:, None] != side[None, :]) | (i == j)) & (component[:, None] != component[None, :])
    ask &= 100 * np.minimum.outer(size, size) >= NUMERATOR * np.maximum.outer(size, size)
    for earlier in range(int(np.flatnonzero((keys == band).all(0))[0])):
        ask &= keys[:, earlier, None] != keys[None, :, earlier]
    found = [(nodes[x], nodes[z]) for x, z in links_between(sets, ask)] if ask.any() else []
    kind = table.schema.field("node").type
    return pa.table([pa.array([f[k] for f in found], kind) for k in (0, 1)], names=["a", "b"])


def links_across(mixed: DataFrame, nodes: DataFrame, texts: DataFrame, size: int = 300) -> DataFrame:
    """Links (a, b) between different components within the buckets of ``mixed``. A bucket's members are cut into parts of about ``size``
    texts, those of its largest component apart from the others (parts -1, -2, ...). Every part of the others meets every other part,
    and itself, once, in a group of their own, in which sets are compared by matrix products: neither one task nor one row for each pair."""
    parts = lambda n: F.ceil(n / size).cast("int")
    outside, inside = parts(F.col("u")), parts(F.col("k") - F.col("u"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("other"), outside).otherwise(inside)).cast("int")
    named = mixed.withColumn("side", F.when(F.col("other"), own).otherwise(-1 - own)).withColumn("_in", inside)
    whole = named.where("not other").select("band", F.col("side").alias("i"), F.explode(F.sequence(F.lit(0), outside - 1)).alias("j"), "node", "component", "side")
    others = named.where("other").withColumn("_j", F.explode(F.sequence(-F.col("_in"), outside - 1)))
    others = others.select("band", F.least("side", "_j").alias("i"), F.greatest("side", "_j").alias("j"), "node", "component", "side")
    full = whole.unionByName(others).join(nodes.select("node", "bands"), "node").join(texts, "node")
    kind = dict(mixed.dtypes)["node"]
    return full.groupBy("band", "i", "j").applyInArrow(_block_links, f"a {kind}, b {kind}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def classes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to) and kept of every row of docs."""
    docs = docs.select("doc_id", F.col(text_col).alias("text"))
    rows = durable(described(docs))
    sets = rows.where("n > 0 and doc_id is not null")
    # A node is a set, not a doc_id, which may stand for several sets; its numbers are fixed by the durable table.
    nodes = sets.groupBy("digest").agg(F.min(F.struct("doc_id", "key", "bands")).alias("_m")).select(F.monotonically_increasing_id().alias("node"), "digest", "_m.*")
    nodes = durable(nodes)
    keys = nodes.select("node", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.count("*").alias("k")).where("k > 1")
    members = durable(keys.join(shared, "band"))
    # The centre of a bucket is the member that shares most buckets: the text that the others of its group were made from.
    fame = members.groupBy("node").agg(F.sum("k").alias("fame"))
    centres = members.join(fame, "node").groupBy("band").agg(F.max(F.struct("fame", -F.col("node"))).alias("_m")).select("band", (-F.col("_m.col2")).alias("c"))
    named = nodes.join(fame, "node").select("doc_id", "key", "node")
    texts = durable(docs.withColumn("key", F.xxhash64("text")).join(named, ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.first("node").alias("node"), F.min("text").alias("text")).select("node", "text"))
    pairs = members.join(centres, "band").where("c <> node").select(F.least("c", "node").alias("a"), F.greatest("c", "node").alias("b")).distinct()
    edges = durable(confirmed(pairs, texts))
    labels = components(edges)
    mixed = durable(_mixed(members.select("band", "node"), labels))
    if mixed.limit(1).count():
        found = durable(links_across(mixed, nodes, texts))
        if found.limit(1).count():
            labels = components(edges.union(found))
    # Equal sets share a node; rows of one doc_id share their class.
    owned = nodes.select("node", "digest", "doc_id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    by_digest = owned.join(owned.groupBy("component").agg(F.min("doc_id").alias("_c")), "component").select("digest", "_c")
    links = sets.join(by_digest, "digest").select("doc_id", "_c")
    by_doc = links.groupBy("doc_id").agg(F.min("_c").alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(by_doc, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from docs, unnest(range(1, greatest(len(w) - 4, 1) + 1)) u(i) where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
ways as (select a, b from links union all select b, a from links),
reach(node, root) as (select doc_id, doc_id from docs union select ways.b, reach.root from reach join ways on ways.a = reach.node),
classes as (select node as doc_id, min(root) as component_id from reach group by 1)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from docs left join sizes using (doc_id) join classes using (doc_id)
"""
