"""Conflict-constrained best-fit packing of documents into fixed-size training sequences.

Documents are measured in words. A document longer than a bin is cut into pieces of a whole bin and a rest; whole pieces fill bins
of their own, the rest is packed. Bins carry bitmaps: one bit for each duplicate cluster in them, and for each source
a counter in unary bits. A piece fits a bin if there is room, none of the bin's pieces is of its duplicate cluster, and its source
has fewer than ``PER_SOURCE`` pieces there. Pieces come in order of falling length (then doc_id, piece); each goes into the
compatible bin with the least room left (then the oldest): the search starts at the smallest sufficient residual and goes on to the
next larger ones until a compatible bin is found, else a bin is opened. Bins of equal residual and equal bitmaps are
interchangeable, so they are held as one class and looked at once; thousands of copies cost one look each.

Scale: documents are dealt by a hash of doc_id into shards of about ``SHARD`` documents, which are packed each by itself, so
no task sees more than a shard, whatever the source or cluster sizes. Only ids, lengths, sources and clusters are shuffled.

Edge cases: null, empty and blank texts have length 0 and take part in no bin (bin_id null); a null source is a source of its
own, a null cluster conflicts with nothing; repeated rows are pieces like any others (and share a cluster, so they never
share a bin); ties are settled by doc_id and piece; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, PER_SOURCE, SHARD = 2048, 3, 8192


def pack(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[tuple[int, int]]:
    """Bin and offset of each piece; the pieces are packed in the order given. Sizes are 1..capacity."""
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    cluster_bit = {c: 1 << k for k, c in enumerate(c for c, n in seen.items() if c is not None and n > 1)}
    source_bit = {s: k * per_source for k, s in enumerate(dict.fromkeys(sources))}
    unary = (1 << per_source) - 1
    # residual -> {(source counters, cluster bits): heap of bins}; full: bit r is set if some bin has residual r
    rooms: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(capacity + 1)]
    full, bins, out = 0, 0, []
    for size, source, cluster in zip(sizes, sources, clusters):
        place, bit = source_bit[source], cluster_bit.get(cluster, 0)
        top = 1 << (place + per_source - 1)
        best = None
        above = full >> size
        residual = size
        while above:
            step = (above & -above).bit_length() - 1
            residual += step
            for kind, heap in rooms[residual].items():
                if not kind[0] & top and not kind[1] & bit and (best is None or heap[0] < best[0]):
                    best = heap[0], residual, kind
            if best:
                break
            above >>= step + 1
            residual += 1
        if best:
            number, residual, kind = best
            heap = rooms[residual][kind]
            heapq.heappop(heap)
            if not heap:
                del rooms[residual][kind]
                if not rooms[residual]:
                    full &= ~(1 << residual)
        else:
            number, residual, kind, bins = bins, capacity, (0, 0), bins + 1
        count = (kind[0] >> place) & unary
        kind = kind[0] & ~(unary << place) | ((count << 1 | 1) << place), kind[1] | bit
        out.append((number, capacity - residual))
        residual -= size
        heapq.heappush(rooms[residual].setdefault(kind, []), number)
        full |= (1 << residual) if residual else 0
        if not residual:
            rooms[0].clear()
    return out


def _packed(capacity: int, per_source: int, id_type: pa.DataType):
    none = "" if pa.types.is_string(id_type) else 0

    def shard(key, table):
        rows = table.select(["doc_id", "length", "source", "cluster"]).to_pylist()
        pieces = []
        for r in rows:
            whole, rest = divmod(r["length"], capacity)
            pieces += [(-capacity, r["doc_id"], k, r["source"], r["cluster"]) for k in range(whole)]
            if rest:
                pieces.append((-rest, r["doc_id"], whole, r["source"], r["cluster"]))
        pieces.sort(key=lambda p: (p[0], p[1] is not None, p[1] if p[1] is not None else none, p[2]))
        placed = pack([-p[0] for p in pieces], [p[3] for p in pieces], [p[4] for p in pieces], capacity, per_source)
        name = f"{key[0].as_py():06d}-"
        return pa.table([
            pa.array([p[1] for p in pieces], id_type), pa.array([p[2] for p in pieces], pa.int32()), pa.array([p[2] * capacity for p in pieces], pa.int64()),
            pa.array([-p[0] for p in pieces], pa.int32()), pa.array([f"{name}{b:06d}" for b, _ in placed], pa.string()), pa.array([o for _, o in placed], pa.int32()),
        ], names=["doc_id", "piece", "start_word", "length", "bin_id", "bin_offset"])

    return shard


def measured(docs: DataFrame, text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """doc_id, length in words, source, and duplicate cluster: a given column, or else a hash of the text's words in lower case."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(F.lower(text), r"[\s]+"), "")
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.md5(F.array_join(words, " "))
    return docs.select("doc_id", F.size(words).alias("length"), F.col(source_col).alias("source"), cluster.alias("cluster"))


def packed(lengths: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD) -> DataFrame:
    """Places (doc_id, piece, start_word, length, bin_id, bin_offset) of measured documents; documents of length 0 have one row
    with null bin_id."""
    kind = dict(lengths.dtypes)["doc_id"]
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    shards = max(1, -(-lengths.count() // shard))
    # rows that share an id (or have none) by the thousand are dealt one by one
    heavy = lengths.groupBy(F.col("doc_id").alias("_id")).count().where(F.col("count") > shard // 8).select("_id", F.lit(True).alias("_many"))
    full = lengths.where("length > 0").join(heavy, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    name = F.when(F.col("_many"), F.xxhash64("doc_id", F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id"))
    dealt = full.withColumn("_shard", F.pmod(name, F.lit(shards)).cast("int")).drop("_id", "_many")
    schema = f"doc_id {kind}, piece int, start_word long, length int, bin_id string, bin_offset int"
    placed = dealt.groupBy("_shard").applyInArrow(_packed(capacity, per_source, id_type), schema)
    empty = lengths.where("length = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start_word"), F.lit(0).alias("length"), F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("int").alias("bin_offset"))
    return placed.unionByName(empty)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    from .common import durable

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(durable(measured(docs)))
