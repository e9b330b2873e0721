"""Suffix-array deduplication of exact passages: sampled splitters range-partition suffixes by their leading tokens; buckets sort
locally by multikey quicksort and compare, across their boundaries too.

A byte is removed if a ``LENGTH``-byte string that covers it also starts in a document with a smaller doc_id. Tokens are bytes.
The array is sparse: of each 50-byte window only the suffix at its anchor counts, the leftmost of its ``TOKEN``-byte strings with
the smallest hash. Equal windows have their anchor at the same offset, so equal windows meet in the sorted order of anchors,
and nothing is lost; about one suffix in 14 is kept.

1. Documents are dealt into blocks of ``BLOCK`` to ``BLOCK_MOST`` bytes by a hash of doc_id.
2. Each block lists the hashes of its anchors, 4 bytes each; hash shards find those that two documents share. A block has one message
   for each shard in which it has anchors, so there are never more messages than anchors.
3. Each block cuts the shared anchors' suffixes with the bytes before them that a window can reach. Equal suffixes of a block are
   sent once, for the smallest doc_id; the block removes the others itself, so a passage in a third of all documents
   costs one suffix a block. The order is that of the ``LENGTH`` bytes from the anchor on, then of the bytes before it, backwards;
   splitters sampled in that order, in proportion to the number of buckets, deal the suffixes. All bytes decide, so a
   frequent phrase in changing surroundings is spread over buckets. Splitters take ``CONTEXT`` bytes for each ``BUCKET`` to
   ``BUCKET_MOST`` bytes of suffixes, about 2 MB a terabyte of text.
4. Buckets sort by multikey quicksort. A window with ``o`` bytes before its anchor is the same for suffixes that stand in one run of
   common prefixes of LENGTH - o bytes, and in one run of the order of the preceding bytes with o bytes in common: both runs
   come from comparing neighbours in sorted order, byte by byte. Of such windows all but those of the smallest doc_id go.
5. A run that a splitter cuts goes on in the next bucket. Windows in it that the bucket keeps are compared once more among buckets,
   by their bytes.
6. Removed runs return to their block, which merges them and hashes what is left.

Edge cases: null and empty texts have no bytes; texts under 50 bytes lose nothing; matches never cross documents; repeated rows
(one doc_id, one text) are one document and are both returned; rows with a null doc_id are compared with nothing and kept
whole; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, mix, prefix_sums, raw, span_hashes, tune

LENGTH, TOKEN = 50, 24
WIDTH = LENGTH - TOKEN + 1
LEFT = WIDTH - 1
CONTEXT = LEFT + LENGTH
#: Blocks, hash shards and suffix buckets grow with the input between these bounds, so that the messages between them stay few.
BLOCK, BLOCK_MOST = 3 << 20, 16 << 20
SHARD, SHARD_MOST, SHARDS = 1 << 20, 64 << 20, 256
BUCKET, BUCKET_MOST = 10 << 20, 64 << 20
SPLIT_TEXTS, SPLIT_TOKENS, OVERSAMPLED = 2000, 24, 16
SLICE = 1 << 19
_POS = np.uint64((1 << 20) - 1)

OUT = "doc_id {id}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>, kept binary, text_sha256 string"


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, hash, and smallest and largest offset of the windows that have it as anchor, of each anchor of documents
    that stand one after the other in data (ends: their ends)."""
    found = []
    n = len(data)
    for a in range(0, max(n - LENGTH + 1, 0), SLICE):
        part = data[a : a + SLICE + LENGTH - 1]
        m = len(part) - LENGTH + 1
        k = np.arange(len(part) - TOKEN + 1)
        h = span_hashes(prefix_sums(part), k, k + TOKEN)
        low = (h & ~_POS) | k.astype(np.uint64)
        for step in (1, 2, 4, 8):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[: m], low[WIDTH - 16 : WIDTH - 16 + m])
        at = (low & _POS).astype(np.int64)
        s = np.arange(m)
        doc = np.searchsorted(ends, a + s, "right")
        s, at = (x[ends[np.minimum(doc, len(ends) - 1)] >= a + s + LENGTH] for x in (s, at))
        if not len(s):
            continue
        new = np.ones(len(s), bool)
        new[1:] = (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(s)) - 1
        p = at[first]
        found.append((p + a, h[p], p - s[last], p - s[first]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def multikey_quicksort(words: np.ndarray, small: int = 1024) -> np.ndarray:
    """Order of rows of unsigned words, by three-way partitions around a pivot of the current word; the middle part goes on
    with the next word. Short parts are sorted by all their remaining words at once."""
    n, width = words.shape
    order = np.arange(n)
    stack = [(0, n, 0)]
    while stack:
        lo, hi, c = stack.pop()
        if hi - lo < 2 or c == width:
            continue
        part = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = part[np.lexsort(words[part, c:].T[::-1])]
            continue
        key = words[part, c]
        pivot = np.sort(key[:: max(1, len(key) // 9)])[4]
        less, more = key < pivot, key > pivot
        a, b = int(less.sum()), int(more.sum())
        order[lo:hi] = np.concatenate([part[less], part[~(less | more)], part[more]])
        stack += [(lo, lo + a, c), (lo + a, hi - b, c + 1), (hi - b, hi, c)]
    return order


_ZSTD = pa.Codec("zstd", compression_level=1)


def _pack(values: np.ndarray) -> bytes:
    """Numbers for a message: their number of bytes, then all first bytes, all second bytes and so on, compressed."""
    raw_bytes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()
    return len(raw_bytes).to_bytes(8, "little") + _ZSTD.compress(raw_bytes, asbytes=True)


def _unpack(message: bytes, kind: str) -> np.ndarray:
    size, width = int.from_bytes(message[:8], "little"), np.dtype(kind).itemsize
    data = np.frombuffer(_ZSTD.decompress(message[8:], size, asbytes=True) if size else b"", np.uint8)
    return np.ascontiguousarray(data.reshape(width, -1).T).view(kind).ravel()


class Block:
    """The documents of a block that take part, one after the other in order of id and text. The order is the same in every step, so
    positions in ``data`` name bytes across steps, also where one id stands for several texts."""

    def __init__(self, table: pa.Table) -> None:
        ids = table.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
        for i in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids[order])) + 1):
            if len(i) > 1:
                order[i] = sorted(order[i], key=lambda k: texts[k].as_py() or "")
        self.ids = ids[order]
        data, at = raw(texts.take(pa.array(order)))
        self.bytes, self.at = data, at
        keep = np.flatnonzero(np.diff(at) >= LENGTH)
        self.data = np.concatenate([data[at[i] : at[i + 1]] for i in keep]) if len(keep) else np.zeros(0, np.uint8)
        self.kept, size = keep, np.diff(at)[keep]
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.doc_ids = self.ids[keep]

    def anchors(self):
        return anchors(self.data, self.ends) if len(self.ends) else anchors(self.data, np.zeros(1, np.int64))

    def doc_of(self, p: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, p, "right")


def contexts(data: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The CONTEXT bytes around each anchor (zeros beyond the data)."""
    padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[p]


def in_order(context: np.ndarray) -> np.ndarray:
    """Contexts with their bytes in the order in which they count: from the anchor on, then before it, backwards."""
    return np.concatenate([context[:, LEFT:], context[:, :LEFT][:, ::-1]], axis=1)


def _as_strings(key: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel()


def _as_words(key: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Rows of bytes, then of further numbers below 256, as big-endian words."""
    out = np.zeros((len(key), -(-(key.shape[1] + len(more)) // 8) * 8), np.uint8)
    out[:, : key.shape[1]] = key
    for k, m in enumerate(more):
        out[:, key.shape[1] + k] = m
    return out.view(">u8").astype(np.uint64)


#: 255 for the bytes of a context that windows at offsets lo to hi reach, at row lo * WIDTH + hi.
_REACHED = np.array([[255 * (-hi <= k < LENGTH - lo) for k in range(-LEFT, LENGTH)] for lo in range(WIDTH) for hi in range(WIDTH)], np.uint8)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of a and b."""
    other = a != b
    return np.where(other.any(1), other.argmax(1), a.shape[1])


def _shared_hashes(bits: int):
    def listed(key, table):
        """The block's anchor hashes by shard: 32 bits each, and a bit that says whether two of its documents have it."""
        b = Block(table)
        p, h, _, _ = b.anchors()
        h >>= np.uint64(64 - 32 - bits)
        doc = b.doc_of(p)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(h)) - 1
        many = doc[first] != doc[last] if len(h) else np.zeros(0, bool)
        h = h[first]
        shard = (h >> np.uint64(32)).astype(np.int64)
        head = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(h) else np.zeros(0, np.int64)
        rows = [(int(shard[a]), int(key[0].as_py()), _pack(np.diff(h[a:z].astype("<u4"), prepend=np.uint32(0))), np.packbits(many[a:z]).tobytes()) for a, z in zip(head, np.append(head[1:], len(h)))]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["shard", "block", "hashes", "many"])

    return listed


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For one shard: to each block, those of its hashes that two documents have."""
    hashes, many, blocks, shard = [], [], [], 0
    for batch in batches:
        for s, block, h, m in zip(*(c.to_pylist() for c in batch.columns)):
            hashes.append(np.cumsum(_unpack(h, "<u4"), dtype=np.uint32)), blocks.append(block)
            many.append(np.unpackbits(np.frombuffer(m, np.uint8), count=len(hashes[-1])).astype(bool))
            shard = s
    h, of = np.concatenate(hashes), np.repeat(np.arange(len(blocks)), [len(x) for x in hashes])
    order = np.argsort(h, kind="stable")
    v = h[order]
    same = np.zeros(len(v), bool)
    same[1:] = v[1:] == v[:-1]
    same[:-1] |= same[1:].copy()
    shared = np.concatenate(many)
    shared[order] |= same
    h, of = h[shared], of[shared]
    cut = np.searchsorted(of, np.arange(len(blocks) + 1))
    rows = [(blocks[i], shard, _pack(np.diff(h[cut[i] : cut[i + 1]], prepend=np.uint32(0)))) for i in range(len(blocks)) if cut[i] < cut[i + 1]]
    for lo in range(0, len(rows), 2000):
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[lo : lo + 2000]], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["block", "shard", "hashes"])


_matched.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
_SUFFIXES = [("bucket", pa.int32()), ("block", pa.int32()), ("docs", pa.binary()), ("reach", pa.binary()), ("context", pa.binary()), ("places", pa.binary())]
_SUFFIX_SCHEMA = "bucket int, block int, docs binary, reach binary, context binary, places binary"


def _distinct(words: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ordered by equal words, then by id, and a mark on the first of each. Hashes order them; the words have the last say."""
    hashes = np.zeros(len(words), np.uint64)
    for column in words.T:
        hashes = mix(hashes ^ column)
    order = np.lexsort((ids, hashes))
    first = np.r_[True, hashes[order[1:]] != hashes[order[:-1]]]
    if (words[order[1:]] != words[order[:-1]]).any(1)[~first[1:]].any():  # two contexts of one hash
        number = np.unique(words, axis=0, return_inverse=True)[1]
        order = np.lexsort((ids, number))
        first = np.r_[True, number[order[1:]] != number[order[:-1]]]
    return order, first


def _cut(bits: int, splitters: np.ndarray):
    def suffixes(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """The block's shared suffixes by bucket, and the runs that it can remove by itself (bucket -1)."""
        block = int(key[0].as_py())
        b = Block(left)
        p, h, lo, hi = b.anchors()
        wanted = [np.cumsum(_unpack(x, "<u4"), dtype=np.uint32).astype(np.uint64) | (np.uint64(s) << np.uint64(32)) for s, x in zip(right.column("shard").to_pylist(), right.column("hashes").to_pylist())]
        wanted = np.sort(np.concatenate(wanted)) if wanted else np.zeros(0, np.uint64)
        h >>= np.uint64(64 - 32 - bits)
        at = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
        use = wanted[at] == h if len(wanted) else np.zeros(len(h), bool)
        p, lo, hi = p[use], lo[use], hi[use]
        rows: list[tuple] = []
        if len(p):
            doc = b.doc_of(p)
            ids, context = b.doc_ids[doc], contexts(b.data, p)
            context &= _REACHED[lo * WIDTH + hi]  # what no window reaches, as bytes of neighbouring documents, does not count
            order, first = _distinct(_as_words(context, lo, hi), ids)
            d = ids[order]
            group = np.cumsum(first) - 1
            mine = d == d[np.flatnonzero(first)][group]
            gone = order[~mine]
            if len(gone):
                rows.append((-1, block, b"", b"", b"", _pack(np.stack([p[gone] - hi[gone], p[gone] - lo[gone] + LENGTH], 1).astype("<i4").ravel())))
            heads = order[first]
            context = context[heads]
            bucket = np.searchsorted(splitters, _as_strings(in_order(context)), "right")
            place = order[mine]
            of = group[mine]
            by = np.argsort(bucket, kind="stable")
            number = np.empty(len(by), np.int64)
            number[by] = np.arange(len(by))
            number_of = number[of]
            sort = np.argsort(number_of, kind="stable")
            place, number_of = place[sort], number_of[sort]
            head = np.flatnonzero(np.r_[True, np.diff(bucket[by]) != 0])
            for k, z in zip(head, np.append(head[1:], len(by))):
                i = heads[by[k:z]]
                x, y = np.searchsorted(number_of, (k, z))
                places = np.stack([number_of[x:y] - k, p[place[x:y]]], 1).astype("<i4")
                rows.append((int(bucket[by[k]]), block, _pack(ids[i].astype("<i8")), np.stack([lo[i], hi[i]], 1).astype(np.uint8).tobytes(), _pack(context[by[k:z]].ravel()), _pack(places.ravel())))
        return pa.table([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_SUFFIXES)], names=[n for n, _ in _SUFFIXES])

    return suffixes


def compared(context: np.ndarray, docs: np.ndarray, reach: np.ndarray, below: np.ndarray | None, above: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Windows (rows x WIDTH booleans) of a bucket's suffixes that go, and those that it keeps but that a run over the bucket's limits
    (keys below and above; None: no bucket there) may still remove."""
    n = len(docs)
    gone, open_ = np.zeros((n, WIDTH), bool), np.zeros((n, WIDTH), bool)
    key = in_order(context)
    words = _as_words(key, reach[:, 0], reach[:, 1])
    order = multikey_quicksort(words)
    # of suffixes alike in all bytes and in reach only that of the smallest document goes on
    words, d = words[order], docs[order]
    head = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]).any(1)]) if n else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(head)), np.diff(np.append(head, n)))
    mine = d == (np.minimum.reduceat(d, head)[group] if n else d)
    offset = np.arange(WIDTH)
    rest = order[~mine]
    gone[rest] = (reach[rest, :1] <= offset) & (offset <= reach[rest, 1:])
    order = order[mine]
    key = key[order]
    right = np.zeros(len(order) + 1, np.int64)
    right[1:-1] = common(key[1:, :LENGTH], key[:-1, :LENGTH])
    over = np.zeros(len(order), np.int64)
    for limit in (below, above):
        if limit is not None:
            over = np.maximum(over, common(key[:, :LENGTH], np.broadcast_to(limit[:LENGTH], (len(order), LENGTH))))
    either = np.maximum(right[:-1], right[1:])
    near = np.flatnonzero(np.maximum(either, over) >= TOKEN)
    if not len(near):
        return gone, open_
    rows, right, over, either = order[near], right[near], over[near], either[near]
    before = key[near, LENGTH:]
    by_left = multikey_quicksort(_as_words(before))
    left = np.zeros(len(near) + 1, np.int64)
    left[1:-1] = common(before[by_left[1:]], before[by_left[:-1]])
    either_left = np.empty(len(near), np.int64)
    either_left[by_left] = np.maximum(left[:-1], left[1:])
    by_doc = np.argsort(docs[rows], kind="stable")
    d, low, high = docs[rows], reach[rows, 0], reach[rows, 1]
    run = np.empty(len(near), np.int64)
    for o in offset:
        valid = (low <= o) & (o <= high)
        open_[rows, o] = valid & (over >= LENGTH - o)
        own = by_doc[(valid & (either >= LENGTH - o) & (either_left >= o))[by_doc]]  # the others stand alone in a run
        if len(own) < 2:
            continue
        run[by_left] = np.cumsum(left[:-1] < o)
        window = np.cumsum(right < LENGTH - o) * (len(near) + 1) + run
        _, first, inverse = np.unique(window[own], return_index=True, return_inverse=True)
        gone[rows[own], o] = d[own[first]][inverse] < d[own]
    return gone, open_ & ~gone


def _compared(splitters: np.ndarray):
    limits = splitters.view(np.uint8).reshape(-1, CONTEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Removed runs of a bucket ((start, stop) pairs in their block), then its windows that other buckets may remove."""
        parts, number = [], 0
        for batch in batches:
            for bucket, block, docs, reach, context, places in zip(*(batch.column(name).to_pylist() for name, _ in _SUFFIXES)):
                if bucket < 0:
                    yield _runs(block, places)
                else:
                    number = bucket
                    parts.append((block, _unpack(docs, "<i8"), np.frombuffer(reach, np.uint8).reshape(-1, 2), _unpack(context, "u1").reshape(-1, CONTEXT), _unpack(places, "<i4").reshape(-1, 2).astype(np.int64)))
        if not parts:
            return
        docs, reach, context = (np.concatenate([x[k] for x in parts]) for k in (1, 2, 3))
        all_gone, all_open = compared(context, docs, reach, limits[number - 1] if number else None, limits[number] if number < len(limits) else None)
        base = 0
        for block, ids, _, _, places in parts:
            g, still = all_gone[base : base + len(ids)], all_open[base : base + len(ids)]
            edge = np.diff(np.pad(g, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            r, a = np.nonzero(edge == 1)
            z = np.nonzero(edge == -1)[1]
            if len(r):
                which, p, _ = _of_places(r, places, ids)
                pair = np.stack([p - (z[which] - 1), p - a[which] + LENGTH], 1)
                yield _runs(block, _pack(pair.astype("<i4").ravel()))
            r, o = np.nonzero(still)
            for lo in range(0, len(r), 20000):
                which, p, doc = _of_places(r[lo : lo + 20000], places, ids)
                offset = o[lo : lo + 20000]
                windows = np.lib.stride_tricks.sliding_window_view(context[base : base + len(ids)], LENGTH, axis=1)[r[lo : lo + 20000], LEFT - offset][which]
                yield _windows(block, windows, doc, p - offset[which])
            base += len(ids)

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _of_places(r: np.ndarray, places: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every place of a suffix takes all that was found for it (rows r, ascending): index into r, position, and document."""
    begin, end = np.searchsorted(r, places[:, 0]), np.searchsorted(r, places[:, 0], "right")
    k = end - begin
    which = np.repeat(begin - (np.cumsum(k) - k), k) + np.arange(k.sum())
    return which, np.repeat(places[:, 1], k), np.repeat(ids[places[:, 0]], k)


_FOUND = [("block", pa.int32()), ("runs", pa.binary()), ("window", pa.binary()), ("doc", pa.int64()), ("start", pa.int64())]
_FOUND_SCHEMA = "block int, runs binary, window binary, doc long, start long"


def _runs(block: int, pairs: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pairs], pa.binary()), *(pa.nulls(1, t) for _, t in _FOUND[2:])], names=[n for n, _ in _FOUND])


def _windows(block: int, windows: np.ndarray, doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    n = len(doc)
    text = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * LENGTH).tobytes()), pa.py_buffer(windows.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int32)), pa.nulls(n, pa.binary()), text, pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int64))], names=[n for n, _ in _FOUND])


def _finished(with_text: bool, id_type: pa.DataType):
    def merged(key, left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left)
        start = right.column("start").drop_null().to_numpy()
        runs = np.concatenate([np.stack([start, start + LENGTH], 1), *(_unpack(x, "<i4").reshape(-1, 2) for x in right.column("runs").to_pylist() if x is not None)])
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        lo, hi = np.zeros(len(b.ids), np.int64), np.zeros(len(b.ids), np.int64)
        lo[b.kept], hi[b.kept] = np.searchsorted(runs[:, 0], b.starts), np.searchsorted(runs[:, 0], b.ends)
        base = np.zeros(len(b.ids), np.int64)
        base[b.kept] = b.starts
        rows = []
        for i in range(len(b.ids)):
            text = b.bytes[b.at[i] : b.at[i + 1]]
            spans = []
            if hi[i] > lo[i]:
                r = runs[lo[i] : hi[i]] - base[i]
                stop = np.maximum.accumulate(r[:, 1])
                new = np.flatnonzero(np.r_[True, r[1:, 0] > stop[:-1]])
                spans = list(zip(r[new, 0].tolist(), stop[np.append(new[1:], len(r)) - 1].tolist()))
            at, kept = 0, []
            for s, e in spans:
                kept.append(text[at:s])
                at = e
            kept = b"".join(x.tobytes() for x in [*kept, text[at:]])
            rows.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": s, "stop": e} for s, e in spans] if with_text else None, kept.decode(errors="ignore").encode() if with_text else None, hashlib.sha256(text).hexdigest() if with_text else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary(), pa.string())
        return pa.table([pa.array(b.ids, id_type), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "text_sha256"])

    return merged


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few keys of each sampled text."""
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            data = np.frombuffer((text or "").encode(), np.uint8)
            if len(data) >= LENGTH:
                p = anchors(data, np.array([len(data)]))[0]
                out += [k.tobytes() for k in in_order(contexts(data, p[np.unique(np.linspace(0, len(p) - 1, SPLIT_TOKENS).astype(int))]))]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["token"])


def splitters(texts: DataFrame, rows: int, buckets: int) -> np.ndarray:
    """Bucket limits: quantiles of the keys of sampled texts, ``OVERSAMPLED`` keys a bucket and ``SPLIT_TEXTS`` texts at least. Only the
    limits come to the driver."""
    share = min(1.0, max(SPLIT_TEXTS, OVERSAMPLED * buckets / SPLIT_TOKENS) / max(rows, 1))
    tokens = durable(texts.select("text").sample(share, seed=1).mapInArrow(_sampled, "token binary"))
    step = max(1, tokens.count() // buckets)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            i = np.arange((-at - 1) % step, b.num_rows, step)
            at += b.num_rows
            yield b.take(pa.array(i))

    cuts = [bytes(r[0]) for r in tokens.orderBy("token").mapInArrow(every, "token binary").collect()] if buckets > 1 else []
    return np.unique(np.array(cuts, f"S{CONTEXT}"))


def deduplicated(docs: DataFrame, text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with ``with_text`` also the removed spans, the kept
    text as bytes (without characters that a cut has broken), and a checksum of the text before. doc_id must be an integer."""
    spark = docs.sparkSession
    tune(spark)
    kind = dict(docs.dtypes)["doc_id"]
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]
    source = docs.select("doc_id", F.col(text_col).alias("text"))
    size = source.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    total = size["b"] or 0
    blocks = max(1, -(-total // min(BLOCK_MOST, max(BLOCK, total >> 13))))
    listed_bytes = total * 3 // 10  # an anchor in 14 bytes, 4 bytes an anchor
    shards = listed_bytes / min(SHARD_MOST, max(SHARD, listed_bytes // SHARDS))
    bits = max(3, int(np.ceil(np.log2(max(1, shards)))))
    with_id = source.where("doc_id is not null")
    cut_bytes = total * 3 // 2
    limits = splitters(with_id, size["n"], max(1, -(-cut_bytes // min(BUCKET_MOST, max(BUCKET, cut_bytes >> 16)))))
    block = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(blocks)).cast("int")
    dealt = with_id.select(F.col("doc_id").cast("long").alias("doc_id"), "text", block.alias("block"))
    groups = dealt.groupBy("block")
    listed = groups.applyInArrow(_shared_hashes(bits), "shard int, block int, hashes binary, many binary")
    matched = listed.groupBy("shard").applyInArrow(_matched, "block int, shard int, hashes binary")
    suffixes = groups.cogroup(matched.groupBy("block")).applyInArrow(_cut(bits, limits), _SUFFIX_SCHEMA)
    # what a block removes by itself has no bucket to go to: it is spread by block
    keyed = suffixes.withColumn("to", F.when(F.col("bucket") < 0, -1 - F.col("block")).otherwise(F.col("bucket")))
    found = durable(keyed.groupBy("to").applyInArrow(_compared(limits), _FOUND_SCHEMA))
    windows = found.where("window is not null")
    first = windows.groupBy("window").agg(F.min("doc").alias("_first"))
    none = lambda t: F.lit(None).cast(t)
    later = windows.join(first.hint("merge"), "window").where("doc > _first").select("block", none("binary").alias("runs"), "start")
    side = found.where("window is null").select("block", "runs", "start").unionByName(later)
    done = groups.cogroup(side.groupBy("block")).applyInArrow(_finished(with_text, id_type), OUT.format(id=kind))
    text = F.coalesce(F.col("text"), F.lit(""))
    spans_type = "array<struct<start:long,stop:long>>"
    rest = source.where("doc_id is null").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), (F.array().cast(spans_type) if with_text else none(spans_type)).alias("spans"), (text.cast("binary") if with_text else none("binary")).alias("kept"), (F.sha2(text, 256) if with_text else none("string")).alias("text_sha256"))
    done = done.union(rest)
    return done if with_text else done.drop("spans", "kept", "text_sha256")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
