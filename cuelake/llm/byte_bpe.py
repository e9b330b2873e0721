"""Byte-level BPE encoding and decoding with given ranks: length-bucketed padded numpy matrices; in every round each row merges
its leftmost minimum-rank pair, by hashed pair lookup and compaction.

A text is cut by the tokenizer's pattern; each piece is encoded alone. Within an Arrow batch the distinct pieces are put into
matrices of like length, one row a piece, one column a token. A round looks up the ranks of all neighbouring pairs in an
open-addressing table, finds each row's leftmost smallest rank, writes the merged token and closes the gap; rows without a
pair leave the matrix. Encoded pieces of up to ``LONG`` characters are kept for later batches of the task, ``CACHE`` pieces at most. In the matrices of pieces over
``LONG`` bytes (a run of one kind of character can be a whole text) a row is cut into blocks of columns whose smallest ranks are kept,
so that a round looks at those and at the blocks it changes; gaps are skipped by links and closed when the row is done. A piece over
``RUN`` bytes is a row of its own, in which a round merges every place of the smallest rank.

Edge cases: a null or empty text has no tokens and decodes to nothing; text is taken as its UTF-8 bytes, special-token strings are
ordinary text; ids outside the vocabulary raise ValueError when decoding; extra columns pass through, columns named as
the results are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_udf, tune, without

LONG, BLOCK, CELLS, RUN = 64, 64, 1 << 20, 4096
CACHE = 400_000
NO_RANK = np.int32(2**31 - 1)


class Ranks:
    """A vocabulary: bytes of each id, and the merges it implies as a hash table from pairs of ids to ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern
        self.size = max(ranks.values()) + 1 if ranks else 0
        self.bytes_of: list[bytes | None] = [None] * self.size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.of_byte < 0).any():
            raise ValueError("the vocabulary must have every single byte")
        left, right, merged = [], [], []
        for token, i in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i)
        self._build(np.array(left, np.uint64), np.array(right, np.uint64), np.array(merged, np.int32))

    @classmethod
    def read(cls, path: str, pattern: str) -> Ranks:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    @cached_property
    def regex(self):
        import regex

        return regex.compile(self.pattern)

    def _build(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        """Open addressing with linear probing, filled in rounds: in each, every free slot takes one of the pairs that want it."""
        key = (left << np.uint64(32)) | right
        self.bits = max(4, int(np.ceil(np.log2(len(key) * 3 + 1))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, 2**64 - 1, np.uint64), np.full(size, NO_RANK, np.int32)
        slot, todo, probes = self._slot(key), np.arange(len(key)), 0
        while len(todo):
            probes += 1
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            self.keys[slot[todo[free]]] = key[todo[free]]
            self.values[slot[todo[free]]] = merged[todo[free]]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & (size - 1)
        self.probes = probes

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id (its rank) of each pair of ids, or NO_RANK; -1 marks padding."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        shape, key = key.shape, key.ravel()
        out = np.full(len(key), NO_RANK, np.int32)
        todo = np.flatnonzero((right >= 0).ravel())
        slot = self._slot(key[todo])
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == key[todo]
            out[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (found != np.uint64(2**64 - 1))
            todo, slot = todo[more], (slot[more] + 1) & ((1 << self.bits) - 1)
            if not len(todo):
                break
        return out.reshape(shape)

    def encode_matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids (little-endian 32-bit) of pieces that are all nearly of one length."""
        width = max(map(len, pieces))
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        tokens = self.of_byte[flat]
        count = np.array([len(p) for p in pieces])
        tokens[np.arange(width) >= count[:, None]] = -1
        done: list[bytes | None] = [None] * len(pieces)
        row = np.arange(len(pieces))
        ranks = self.pair_ranks(tokens[:, :-1], tokens[:, 1:]) if width > 1 else np.full((len(pieces), 0), NO_RANK)
        while True:
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            low = ranks[np.arange(len(row)), best] if ranks.shape[1] else np.full(len(row), NO_RANK)
            over = low == NO_RANK
            if over.any():
                packed = tokens[over].astype("<u4")
                for i, ids, n in zip(row[over], packed, count[over]):
                    done[i] = ids[:n].tobytes()
                live = ~over
                row, tokens, ranks, count, best, low = row[live], tokens[live], ranks[live], count[live], best[live], low[live]
            if not len(row):
                return done
            at = np.arange(len(row))
            tokens[at, best] = low
            shift = np.arange(tokens.shape[1] - 1) + (np.arange(tokens.shape[1] - 1) > best[:, None])
            tokens = np.take_along_axis(tokens, shift, 1)
            count = count - 1
            if ranks.shape[1] < 2:
                ranks = ranks[:, :0]
                continue
            shift = np.arange(ranks.shape[1] - 1) + (np.arange(ranks.shape[1] - 1) > best[:, None])
            ranks = np.take_along_axis(ranks, shift, 1)
            for step in (-1, 0):
                k = best + step
                ok = (k >= 0) & (k + 1 < tokens.shape[1])
                ranks[at[ok], k[ok]] = self.pair_ranks(tokens[at[ok], k[ok]], tokens[at[ok], k[ok] + 1])

    def encode_wide(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of long pieces of like length: the same rounds, with links over gaps and the smallest rank of each block."""
        count = np.array([len(p) for p in pieces])
        rows, blocks = len(pieces), -(-int(count.max()) // BLOCK)
        width = blocks * BLOCK
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
        column = np.arange(width, dtype=np.int32)
        tokens = np.where(column < count[:, None], self.of_byte[flat], np.int32(-1))
        ranks = np.full((rows, width), NO_RANK)
        ranks[:, :-1] = self.pair_ranks(tokens[:, :-1], tokens[:, 1:])
        after, before = np.tile(column + 1, (rows, 1)), np.tile(column - 1, (rows, 1))
        by_block = ranks.reshape(rows, blocks, BLOCK)
        least = by_block.min(2)
        row = np.arange(rows)
        while True:
            block = least[row].argmin(1)
            low = least[row, block]
            more = low != NO_RANK
            if not more.all():
                row, block, low = row[more], block[more], low[more]
            if not len(row):
                break
            at = block * BLOCK + by_block[row, block].argmin(1)
            gone = after[row, at]
            tokens[row, at], tokens[row, gone], ranks[row, gone] = low, -1, NO_RANK
            right = after[row, gone]
            after[row, at] = right
            left = before[row, at]
            inside = right < width
            before[row[inside], right[inside]] = at[inside]
            ranks[row, at] = np.where(inside, self.pair_ranks(low, tokens[row, np.minimum(right, width - 1)]), NO_RANK)
            has = left >= 0
            ranks[row[has], left[has]] = self.pair_ranks(tokens[row[has], left[has]], low[has])
            for changed in (at, gone, np.maximum(left, 0)):
                k = changed // BLOCK
                least[row, k] = by_block[row, k].min(1)
        return [t[t >= 0].astype("<u4").tobytes() for t in tokens]

    def encode_run(self, piece: bytes) -> bytes:
        """Token ids of one very long piece. Every place of the smallest rank is merged in one round, as they would be one after the
        other from the left; the round ends early at the first merge that makes a pair of no larger rank."""
        tokens = self.of_byte[np.frombuffer(piece, np.uint8)].astype(np.int32)
        ranks = self.pair_ranks(tokens[:-1], tokens[1:])
        while len(ranks):
            low = ranks.min()
            if low == NO_RANK:
                break
            at = np.flatnonzero(ranks == low)
            # of places that overlap in a row, every second one
            first = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) > 1], np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            while True:
                pos = at - np.arange(len(at))
                now = tokens.copy()
                now[at] = low
                now = np.delete(now, at + 1)
                new = np.delete(ranks, np.minimum(at + 1, len(ranks) - 1))
                right, left = pos[pos < len(new)], pos[pos > 0]
                new[right] = self.pair_ranks(now[right], now[right + 1])
                new[left - 1] = self.pair_ranks(now[left - 1], now[left])
                made = np.full(len(at), NO_RANK)
                made[pos < len(new)] = new[right]
                made[pos > 0] = np.minimum(made[pos > 0], new[left - 1])
                # the pair with what stands to the right before that is merged too
                inner = np.flatnonzero(at + 2 < len(tokens))
                made[inner] = np.minimum(made[inner], self.pair_ranks(np.full(len(inner), low, np.int32), tokens[at[inner] + 2]))
                bad = np.flatnonzero(made <= low)
                if not len(bad) or bad[0] == len(at) - 1:
                    break
                at = at[: bad[0] + 1]
            tokens, ranks = now, new
        return tokens.astype("<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of each piece. Pieces of 1-4, 5-8, 9-12, ... bytes share a matrix; over LONG bytes, those up to an eighth longer."""
        out: list[bytes | None] = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            token = self.ranks.get(p)
            if token is not None:
                out[i] = token.to_bytes(4, "little")
            elif len(p) > RUN:
                out[i] = self.encode_run(p)
            elif len(p) > LONG:
                groups.setdefault(-int(np.log(len(p)) / np.log(1.125)), []).append(i)
            else:
                groups.setdefault((len(p) + 3) // 4, []).append(i)
        for kind, group in groups.items():
            encode, rows = (self.encode_matrix, 8192) if kind >= 0 else (self.encode_wide, max(1, int(CELLS / 1.125 ** (1 - kind))))
            for lo in range(0, len(group), rows):
                part = group[lo : lo + rows]
                for i, ids in zip(part, encode([pieces[i] for i in part])):
                    out[i] = ids
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes of little-endian 32-bit token ids."""
        try:
            return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        except (IndexError, TypeError):
            raise ValueError("an id is not in the vocabulary") from None


class Encoder:
    """Encodes batches of texts, remembering pieces."""

    def __init__(self, ranks: Ranks) -> None:
        self.ranks, self.known = ranks, {}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        find = self.ranks.regex.findall
        known, out = self.known, []
        lo = 0
        while lo < len(texts):
            held, hi, cut = 0, lo, []
            while hi < len(texts) and held < 1 << 20:
                cut.append(find(texts[hi] or ""))
                held += len(texts[hi] or "")
                hi += 1
            fresh = set().union(*cut).difference(known)
            if len(known) + len(fresh) > CACHE:
                known.clear()
                fresh = set().union(*cut)
            fresh = list(fresh)
            known.update(zip(fresh, self.ranks.encode_pieces([p.encode() for p in fresh])))
            out += [b"".join(map(known.__getitem__, c)) for c in cut]
            for piece in fresh:
                if len(piece) > LONG:  # long pieces hardly come again and would fill the memory
                    del known[piece]
            lo = hi
        return out


_loaded: dict[tuple[str, str], Ranks] = {}


def ranks_of(path: str, pattern: str) -> Ranks:
    """The vocabulary in a file that every worker has; read once a process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Ranks.read(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds the token ids of each text as binary: little-endian unsigned 32-bit integers."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(ranks_of(path, pattern))
        for texts in batches:
            yield pa.array(encoder(texts.to_pylist()), pa.binary())

    return without(docs, out_col).withColumn(out_col, batch_udf(run, "binary")(F.col(text_col)))


def decode(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes that the token ids stand for."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks = ranks_of(path, pattern)
        for ids in batches:
            yield pa.array([ranks.decode(i or b"") for i in ids.to_pylist()], pa.binary())

    return without(docs, out_col).withColumn(out_col, batch_udf(run, "binary")(F.col(ids_col)))


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decode(encode(docs, path, pattern), path, pattern)
    return found.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
