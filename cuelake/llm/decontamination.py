"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

Texts are lower-cased (A-Z) and cut to words of letters, digits and all that is not ASCII. A window is ``WIDTH`` consecutive words of
an item, or the whole item if it has fewer words. The automaton holds every run of item words. Training texts are streamed through it
word by word; its state and matched length say at each word which longest run of item words ends there. A length of ``WIDTH`` or more is
a window of some item; for shorter items each state knows the longest that ends in it. So each word gives at most one stretch of hit
words and one set of items.

Words that no item has end every match, so only stretches of item words that can hold a window are streamed. They are cut to pieces
of ``PIECE`` words that begin ``WIDTH`` - 1 words early (no window looks further back), and all pieces of about a megabyte of text take
their next step at once, in numpy.

Size: items are cut to parts of ``PART`` words (overlapping by ``WIDTH`` - 1, so that no window is lost) and dealt to automata of about
``SHARD_WORDS`` words, some tens of megabytes each. A benchmark of up to that size is one automaton; a larger one takes a pass over the
documents for each, and the passes' stretches are united. Documents are never shuffled.

Edge cases: null and empty texts have no words and no hits, items without words no windows; an item without id marks words but is not
counted; several texts of one item_id are one item; repeated rows of documents each get their row; an empty benchmark hits nothing, an
empty table gives no rows; columns of the documents named as results are replaced, others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_VALUES, batch_udf, chunks, durable, prefix_sums, span_hashes, spans, tune, without

WIDTH = 10
PIECE, PART, SHARD_WORDS = 128, 4096, 1 << 18
FLUSH_WORDS = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BYTES = np.arange(256)
_MEMBER = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES < 58)) | ((_BYTES >= 65) & (_BYTES < 91)) | ((_BYTES >= 97) & (_BYTES < 123))
RESULT = "n_words long, spans array<struct<first:long,last:long,start:long,stop:long>>, items array<string>"


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_sums(data, LOWER_VALUES), starts, ends)


class Automaton:
    """Suffix automaton of items (name, words); words are any hashable values.

    ``vocabulary``: sorted 64-bit hashes of its words, whose places are their numbers. ``cover[s, l]``: length of the longest window that
    ends in state s at matched length l (at most ``width``); ``owners[s, l]``: number of the set of items whose windows end there."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], width: int = WIDTH) -> None:
        self.width, self.piece = width, PIECE
        items = [(name, words) for name, words in items if len(words)]
        self.vocabulary = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, np.uint64)
        numbered = [(name, np.searchsorted(self.vocabulary, w).tolist()) for name, w in items]
        self.least = min((min(len(w), width) for _, w in numbered), default=width)
        self._build([w for _, w in numbered])
        self._mark(numbered)
        edges = sorted((s * max(len(self.vocabulary), 1) + c, t) for s, out in enumerate(self._next) for c, t in out.items())
        self.keys, self.targets = np.array([k for k, _ in edges], np.int64), np.array([t for _, t in edges], np.int32)
        self.link, self.length = np.maximum(np.array(self._link, np.int32), 0), np.array(self._length, np.int32)
        del self._next, self._link, self._length

    def _build(self, texts: list[list[int]]) -> None:
        nxt, link, length = [{}], [-1], [0]

        def split(p: int, q: int, c: int) -> int:
            """A state for the strings of q that are p's longest and c; shorter ones leave q."""
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            new = len(nxt) - 1
            link[q] = new
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = new
                p = link[p]
            return new

        for words in texts:
            last = 0
            for c in words:
                if c in nxt[last]:
                    q = nxt[last][c]
                    last = q if length[q] == length[last] + 1 else split(last, q, c)
                    continue
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                new, p = len(nxt) - 1, last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[new] = q if length[q] == length[p] + 1 else split(p, q, c)
                last = new
        self._next, self._link, self._length = nxt, link, length

    def _mark(self, items: list[tuple[str | None, list[int]]]) -> None:
        nxt, link, length, width = self._next, self._link, self._length, self.width
        order = sorted(range(len(link)), key=length.__getitem__)
        whole = [0] * len(link)  # state of the suffix of ``width`` words
        for s in order[1:]:
            whole[s] = whole[link[s]] if length[link[s]] >= width else s if length[s] >= width else 0
        full: dict[int, set] = {}
        short: dict[int, list] = {}
        for name, words in items:
            s = 0
            for i, c in enumerate(words, 1):
                s = nxt[s][c]
                if i >= width:
                    full.setdefault(whole[s], set()).add(name)
            if len(words) < width:
                short.setdefault(s, []).append((len(words), name))
        self.cover, self.owners = np.zeros((len(link), width + 1), np.int16), np.zeros((len(link), width + 1), np.int32)
        numbers: dict[frozenset, int] = {frozenset(): 0}
        number = lambda names: numbers.setdefault(frozenset(names), len(numbers))
        sets = [frozenset()]
        at = np.arange(width + 1)
        for s in order[1:]:
            up = np.minimum(at, length[link[s]])
            self.cover[s], self.owners[s] = self.cover[link[s], up], self.owners[link[s], up]
            for m, name in sorted(short.get(s, []), key=lambda x: x[0]):
                for k in range(m, width + 1):
                    self.cover[s, k] = max(self.cover[s, k], m)
                    self.owners[s, k] = number(sets[self.owners[s, k]] | {name})
                    sets += list(numbers)[len(sets) :]
            if whole[s]:
                # an item of ``width`` words and more ends here, and maybe shorter ones
                self.cover[s, width] = width
                self.owners[s, width] = number(sets[self.owners[s, width]] | full[whole[s]])
                sets += list(numbers)[len(sets) :]
        self.sets = [sorted(x for x in names if x is not None) for names in sets]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words; -1 for words that no item has."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1).astype(np.int32)

    def advance(self, state: np.ndarray, length: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and matched lengths after one more word (of the vocabulary) each: along the edge, or from the next shorter suffix."""
        state, length = state.copy(), length.copy()
        todo = np.arange(len(state))
        while len(todo):
            key = state[todo].astype(np.int64) * len(self.vocabulary) + word[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            hit, todo = todo[found], todo[~found]
            state[hit] = self.targets[at[found]]
            length[hit] += 1
            state[todo] = self.link[state[todo]]
            length[todo] = self.length[state[todo]]
        return state, length

    def matches(self, word: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words by number and the text of each: which words are hit, and distinct (text, set of items) as two columns."""
        n, back = len(word), self.width - 1
        inside = word >= 0
        change = np.flatnonzero(np.r_[True, (inside[1:] != inside[:-1]) | (text[1:] != text[:-1])]) if n else np.zeros(0, np.int64)
        stop = np.r_[change[1:], n]
        good = inside[change] & (stop - change >= self.least) if n else np.zeros(0, bool)
        first, stop = change[good], stop[good]
        pieces = np.maximum(1, -(-(stop - first) // self.piece))
        which = np.repeat(np.arange(len(first)), pieces)
        number = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, end = np.maximum(first[which] + number * self.piece - back, first[which]), np.minimum(first[which] + (number + 1) * self.piece, stop[which])
        order = np.argsort(begin - end, kind="stable")
        begin, size = begin[order], (end - begin)[order]
        state, length = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int32)
        marks, seen = np.zeros(n + 1, np.int32), []
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, "left"))
            at = begin[:live] + t
            state, length = self.advance(state[:live], length[:live], word[at])
            cut = np.minimum(length, self.width)
            cover = self.cover[state, cut]
            hit = np.flatnonzero(cover)
            if len(hit):
                np.add.at(marks, at[hit] - cover[hit] + 1, 1)
                np.add.at(marks, at[hit] + 1, -1)
                seen.append(np.stack([text[at[hit]], self.owners[state[hit], cut[hit]]], 1))
        return np.cumsum(marks)[:n] > 0, np.unique(np.concatenate(seen), axis=0) if seen else np.zeros((0, 2), np.int64)


def _scanner(auto: Automaton):
    """From batches of texts to RESULT."""

    def flushed(parts: list) -> tuple:
        text, hashes, start, stop = (np.concatenate([p[k] for p in parts]) for k in range(4))
        hit, seen = auto.matches(auto.numbers(hashes), text)
        edge = np.diff(np.r_[False, hit, False].astype(np.int8)) if len(hit) else np.zeros(1, np.int8)
        # a run of hit words ends with its text
        new = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
        inner = new[(new > 0) & hit[new] & hit[new - 1]] if len(text) else new
        first, last = np.sort(np.r_[np.flatnonzero(edge > 0), inner]), np.sort(np.r_[np.flatnonzero(edge < 0), inner]) - 1
        base = np.repeat(new, np.diff(np.r_[new, len(text)]))  # first word of each word's text
        return text, np.stack([text[first], first - base[first], last - base[first], start[first], stop[last]], 1), seen

    def batch(texts: pa.Array) -> pa.Array:
        found, held, words = [], [], 0
        offset, current = 0, -1
        for c in chunks(texts, cuts=~_MEMBER):
            if held and words > FLUSH_WORDS and c.docs[0] != current:
                found.append(flushed(held))
                held, words = [], 0
            # a long text comes in several chunks: its bytes count on
            offset = offset if c.docs[0] == current else 0
            starts, ends, piece = spans(c, _MEMBER)
            text = c.docs[piece]
            shift = np.where(text == c.docs[0], offset, 0) - c.starts[piece]
            held.append((text, word_hashes(c.data, starts, ends), starts + shift, ends + shift))
            words += len(starts)
            offset, current = (offset if len(c.docs) == 1 else 0) + int(c.ends[-1] - c.starts[-1]), int(c.docs[-1])
        if held:
            found.append(flushed(held))
        n = len(texts)
        count, stretches, sets = np.zeros(n, np.int64), np.zeros((0, 5), np.int64), [[] for _ in range(n)]
        if found:
            count = np.bincount(np.concatenate([f[0] for f in found]), minlength=n)
            stretches = np.concatenate([f[1] for f in found])
            for text, number in np.concatenate([f[2] for f in found]).tolist():
                sets[text] += auto.sets[number]
        bounds = np.r_[0, np.cumsum(np.bincount(stretches[:, 0], minlength=n))].astype(np.int32)
        fields = pa.StructArray.from_arrays([pa.array(stretches[:, k]) for k in range(1, 5)], ["first", "last", "start", "stop"])
        names = pa.array([sorted(set(s)) for s in sets], pa.list_(pa.string()))
        return pa.StructArray.from_arrays([pa.array(count, pa.int64()), pa.ListArray.from_arrays(bounds, fields), names], ["n_words", "spans", "items"])

    def scan(batches):
        for texts in batches:
            yield batch(texts)

    return batch_udf(scan, f"struct<{RESULT.replace('n_words long', 'n_words:long').replace('spans array', 'spans:array').replace('items array', 'items:array')}>")


def item_parts(items: DataFrame, text_col: str = "text", id_col: str = "item_id", width: int = WIDTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard, name, words) of the items, cut to overlapping parts of at most PART words."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    rows = items.select(F.col(id_col).cast("string").alias("name"), words.alias("w")).where("size(w) > 0").distinct()
    step = PART - width + 1
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - width), F.lit(step))
    parts = rows.select("name", "w", F.explode(starts).alias("i")).select("name", F.slice("w", F.col("i") + 1, PART).alias("words"))
    total = parts.agg(F.sum(F.size("words"))).first()[0] or 0
    return parts.withColumn("shard", F.pmod(F.xxhash64("words"), F.lit(max(1, -(-total // shard_words)))))


def _hashed(words: list[str]) -> np.ndarray:
    coded = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in coded])
    return word_hashes(np.frombuffer(b"".join(coded), np.uint8), np.r_[0, ends[:-1]], ends)


def _united(a: str, b: str):
    """Two results of the same text as one: stretches that touch become one."""
    rows = F.array_sort(F.concat(f"{a}.spans", f"{b}.spans"))
    kind = "array<struct<first:bigint,last:bigint,start:bigint,stop:bigint>>"

    def add(held, x):
        top = F.try_element_at(held, F.lit(-1))
        joined = F.struct(top.first.alias("first"), F.greatest(top.last, x.last).alias("last"), top.start.alias("start"), F.greatest(top.stop, x.stop).alias("stop"))
        return F.when(top.last >= x.first - 1, F.concat(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(held, F.array(x)))

    spans_ = F.aggregate(rows, F.array().cast(kind), add)
    return F.struct(F.col(f"{a}.n_words").alias("n_words"), spans_.alias("spans"), F.array_sort(F.array_union(f"{a}.items", f"{b}.items")).alias("items"))


def scanned(docs: DataFrame, items: DataFrame, text_col: str = "text", width: int = WIDTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with n_words, spans (maximal runs of hit words: first and last word from 0, and their bytes from start to before stop) and
    items (ids as strings, sorted)."""
    tune(docs.sparkSession)
    parts = durable(item_parts(items, width=width, shard_words=shard_words))
    shards = sorted(r[0] for r in parts.select("shard").distinct().collect()) or [0]
    rows = docs.select(F.struct("*").alias("_all"), F.col(text_col).alias("_text"))
    for k, shard in enumerate(shards):
        # an automaton of at most about ``shard_words`` words goes to the tasks
        held = [(r["name"], _hashed(r["words"])) for r in parts.where(F.col("shard") == shard).orderBy("name", "words").collect()]
        scan = _scanner(Automaton(held, width))
        if k == 0:
            rows = rows.withColumn("_found", scan("_text"))
        else:
            rows = durable(rows.withColumn("_more", scan("_text")).select("_all", "_text", _united("_found", "_more").alias("_found")))
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "spans", "items")]
    return rows.select(*[F.col("_all").getField(c).alias(c) for c in kept], "_found.n_words", "_found.spans", "_found.items")


def n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.last - x.first + 1)


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", most_words: int = WIDTH - 1, most_share: float = 0.5, width: int = WIDTH) -> DataFrame:
    """docs without their spans of more than ``most_words`` hit words; a text of which more than ``most_share`` is hit goes whole (dropped,
    an empty text). The columns are those of docs, and n_removed (words) and dropped."""
    found = without(scanned(docs, items, text_col, width), "n_removed", "dropped")
    long = F.filter("spans", lambda x: x.last - x.first + 1 > most_words)
    # the pieces before, between and after the spans, cut by bytes; spans end between characters
    piece = "cast(substring(cast(`{0}` as binary), int(if(i = 0, 0, _long[i - 1].stop)) + 1, int(if(i = size(_long), octet_length(`{0}`), _long[i].start) - if(i = 0, 0, _long[i - 1].stop))) as string)".format(text_col)
    dropped = n_hit() > most_share * F.col("n_words")
    out = found.withColumn("_long", long).withColumn("dropped", dropped)
    text = F.when(F.col(text_col).isNull(), F.lit(None)).when(F.col("dropped"), F.lit("")).otherwise(F.array_join(F.expr(f"transform(sequence(0, size(_long)), i -> {piece})"), ""))
    gone = F.when(F.col("dropped"), F.col("n_words")).otherwise(F.aggregate("_long", F.lit(0).cast("long"), lambda s, x: s + x.last - x.first + 1))
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c in out.columns], gone.alias("n_removed"), "dropped")


def op11_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = scanned(docs.select("doc_id", "text"), items)
    names = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
ORACLE = rf"""
with docs as (select doc_id, {_WORDS} as w from documents),
items as (select item_id, {_WORDS} as w from benchmark),
windows as (select item_id, least(len(w), {WIDTH}) as m, array_to_string(w[i:i + least(len(w), {WIDTH}) - 1], ' ') as g from items, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) u(i) where len(w) > 0),
runs as (select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') as g from docs, (select distinct m from windows) s, unnest(range(1, len(w) - m + 2)) u(i)),
found as (select doc_id, r.m, i, item_id from runs r join windows k on k.m = r.m and k.g = r.g),
hits as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, m, i from found) f, unnest(range(i, i + m)) u(p) group by 1),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from found where item_id is not null) t group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hits using (doc_id) left join named using (doc_id)
"""
