"""Hard negatives by a packed R-tree (sort-tile-recursive) over integer vectors, searched best first within score windows.

Components become floor(256 x); scores are integer inner products. Spark deals the vectors of each label to tiles by quantiles of two
coordinates, about ``TILE`` in each; a tile is packed into leaves of about ``LEAF`` vectors by sorting and cutting its most
spread coordinates in turn, and the leaves' bounding boxes are grouped to boxes of boxes. A box gives an interval for each
coordinate and so, with an anchor, an interval of inner products.

A queue takes boxes by their highest score still of use, the lower of the box's highest and the window's end; boxes outside the
window or strictly below the k-th score so far are pruned. Across tiles the same is done in two passes: each anchor first searches the
tile whose box promises most; its k-th scores then prune the other tiles' boxes, and what remains is searched. Tiles and anchors
meet in blocks: of at most about ``BLOCK`` anchors with one tile, or with ``BOXES`` boxes of tiles.

The k nearest of the same label (positives) and, in the window that each positive's score gives, of other labels (negatives) are two
searches of the same tree.

Edge cases: rows with a null vec_id, label or vector, or with null or non-finite components take no part; vectors of each length
are a collection of their own; of rows that repeat a vec_id the first by label and vector counts; of equal vectors of a label only the
``KEEP`` smallest ids can be among the first of any list, so only they lie in the tree, while each is an anchor if its id says so;
scores beyond a long are held at its ends; ties go to the smaller vec_id; fewer rows give shorter lists; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, durable, tune

POSITIVES, NEGATIVES = 5, 10
KEEP = max(POSITIVES + 1, NEGATIVES)
LOW, HIGH = 30, 90
TILE, LEAF, FAN, QUANTILES = 4096, 128, 8, 100
BLOCK, BOXES = 256, 256
_EXACT, _MOST = 2.0**53, (1 << 63) - 1


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows of x (m, d) and y (n, d): m x n longs, held at the ends of a long."""
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), np.int64)
    if np.abs(x).max() * np.abs(y).max() * x.shape[1] < _EXACT:
        return (x @ y.T).astype(np.int64)
    whole = lambda a: np.array([[int(v) for v in row] for row in a], object)
    return np.clip(whole(x) @ whole(y).T, -_MOST, _MOST).astype(np.int64)


def intervals(low: np.ndarray, high: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each anchor with the vectors of each box (anchors x boxes)."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    both = lambda a, b: np.maximum(products(np.c_[up, down], np.c_[a, b]), -_MOST)
    return both(low, high), both(high, low)


def packed(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of x, and the first place of each leaf."""
    groups = [np.arange(len(x))]
    spread = np.argsort(-x.std(0), kind="stable")[:3] if x.size else []
    for k, c in enumerate(spread):
        cut = []
        for g in groups:
            parts = int(np.ceil((-(-len(g) // leaf)) ** (1 / (len(spread) - k)) - 1e-9))
            cut += np.array_split(g[np.argsort(x[g, c], kind="stable")], max(parts, 1))
        groups = cut
    groups = [p for g in groups for p in np.array_split(g, -(-len(g) // leaf)) if len(p)]
    return np.concatenate(groups), np.cumsum([0] + [len(g) for g in groups[:-1]])


class Tree:
    """Boxes above the leaves of a packed tile. Nodes are numbered from the leaves up; the last one is the root."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> None:
        self.x, self.ids, self.starts, self.stops = x, ids, starts, np.r_[starts[1:], len(x)]
        low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
        self.leaves, lows, highs, self.children = len(starts), [low], [high], {}
        base, count = 0, len(starts)
        while count > 1:
            heads = np.arange(0, count, FAN)
            for i, h in enumerate(heads):
                self.children[base + count + i] = range(base + h, base + min(h + FAN, count))
            low, high = np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads)
            lows.append(low)
            highs.append(high)
            base, count = base + count, len(heads)
        self.low, self.high, self.root = np.concatenate(lows), np.concatenate(highs), base

    def search(self, anchor: int, vector: np.ndarray, bounds: tuple[list, list], windows: list[dict], k: int) -> Iterator[tuple[int, int, int]]:
        """(slot, score, id) of the k best rows but the anchor's own in each window (slot, lo, hi, and the score floor under which nothing is of use)."""
        least, most = bounds
        scores: dict[int, np.ndarray] = {}
        for w in windows:
            lo, hi, kth = w["lo"], w["hi"], w["floor"]
            top: list[tuple[int, int]] = []
            queue = [(-min(most[self.root], hi), self.root)] if most[self.root] >= lo and least[self.root] <= hi else []
            while queue:
                bound, node = heapq.heappop(queue)
                if -bound < kth:
                    break
                if node >= self.leaves:
                    for c in self.children[node]:
                        if most[c] >= lo and least[c] <= hi and min(most[c], hi) >= kth:
                            heapq.heappush(queue, (-min(most[c], hi), c))
                    continue
                a, z = self.starts[node], self.stops[node]
                if node not in scores:
                    scores[node] = products(self.x[a:z], vector[None])[:, 0]
                s = scores[node]
                at = np.flatnonzero((s >= max(lo, kth)) & (s <= hi))
                if len(at):
                    if len(at) > k + 1:
                        # all that reach the k-th best score here, one more for the anchor itself
                        at = at[s[at] >= np.partition(s[at], len(at) - k - 1)[len(at) - k - 1]]
                    found = [(-x, i) for x, i in zip(s[at].tolist(), self.ids[a + at].tolist()) if i != anchor]
                    top = sorted(top + found)[:k]
                    if len(top) == k:
                        kth = max(kth, -top[-1][0])
            for minus, i in top:
                yield w["slot"], -minus, i


def _numbers(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


_TILE = "n int, label int, tile string, ids array<long>, vectors array<double>, starts array<int>, low array<double>, high array<double>"


def _tile(key, table):
    """The tile of a group of rows as one row."""
    x, ids = _numbers(table.column("embedding").combine_chunks(), table.num_rows), table.column("vec_id").to_numpy()
    x = np.floor(x * 256)
    first = np.argsort(ids, kind="stable")
    order, starts = packed(x[first])
    order = first[order]
    x = x[order]
    lists = [ids[order], x.ravel(), starts.astype(np.int32), x.min(0), x.max(0)]
    kinds = [pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64()]
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([key[2].as_py()]), *[pa.array([v], pa.list_(t)) for v, t in zip(lists, kinds)]], names=["n", "label", "tile", "ids", "vectors", "starts", "low", "high"])


def tiles(rows: DataFrame, size: int = TILE) -> DataFrame:
    """One row a tile: its vectors in packed order, ids, leaves and bounding box. rows: n, label, vec_id, embedding."""
    at = rows.select("n", "label", "vec_id", "embedding", F.lit("").alias("tile"))
    fractions = [i / QUANTILES for i in range(1, QUANTILES)]
    for k in range(2):
        x = F.coalesce(F.get("embedding", F.lit(k)), F.lit(0.0))
        parts = F.ceil(F.pow(F.count("*") / size, F.lit(1 / (2 - k)))).cast("int")
        cuts = at.groupBy("n", "label", "tile").agg(parts.alias("_parts"), F.percentile_approx(x, fractions).alias("_q"))
        slab = F.floor(F.size(F.filter("_q", lambda b: b < x)) * F.least("_parts", F.lit(QUANTILES)) / QUANTILES)
        at = at.join(cuts, ["n", "label", "tile"]).withColumn("tile", F.concat("tile", slab.cast("string"), F.lit("."))).drop("_parts", "_q")
    # what quantiles leave too large (equal coordinates, very large tables) is dealt by a hash
    sizes = at.groupBy("n", "label", "tile").agg(F.ceil(F.count("*") / (2 * size)).alias("_parts"))
    at = at.join(sizes, ["n", "label", "tile"]).withColumn("tile", F.concat("tile", F.pmod(F.xxhash64("vec_id"), F.col("_parts")).cast("string")))
    return at.select("n", "label", "tile", "vec_id", "embedding").groupBy("n", "label", "tile").applyInArrow(_tile, _TILE)


def _blocks(asked: DataFrame, by: list, parts: int) -> DataFrame:
    """Anchors of each group of ``by`` in lists, dealt to ``parts`` by a hash."""
    part = F.pmod(F.xxhash64("aid"), F.lit(parts)).alias("_part")
    return asked.groupBy(*by, part).agg(F.collect_list(F.struct("aid", "label", "vector", "windows")).alias("asked"))


def _vectors(asked: list[dict]) -> np.ndarray:
    return np.array([a["vector"] for a in asked], np.float64).reshape(len(asked), -1)


def visits(asked: DataFrame, boxes: DataFrame, own: bool, first: bool, parts: int) -> DataFrame:
    """(aid, n, label, tile, bound) of the tiles that an anchor has to search: those of its own label, or of others, whose box reaches into a
    window not strictly below its floor; with ``first`` the one that promises most of each block of boxes."""

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                low, high = (np.array([x[c] for x in row["boxes"]], np.float64).reshape(len(row["boxes"]), -1) for c in ("low", "high"))
                least, most = intervals(low, high, _vectors(row["asked"]))
                labels = np.array([x["label"] for x in row["boxes"]])
                for i, a in enumerate(row["asked"]):
                    fit = (labels == a["label"]) == own
                    use = np.full(len(labels), -_MOST - 1)
                    for w in a["windows"]:
                        bound = np.minimum(most[i], w["hi"])
                        use = np.where((most[i] >= w["lo"]) & (least[i] <= w["hi"]) & (bound >= w["floor"]), np.maximum(use, bound), use)
                    at = np.flatnonzero(fit & (use > -_MOST - 1))
                    if first:
                        at = at[np.argsort(-use[at], kind="stable")[:1]]
                    out += [(a["aid"], row["n"], row["boxes"][j]["label"], row["boxes"][j]["tile"], int(use[j])) for j in at]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["aid", "n", "label", "tile", "bound"])

    number = boxes.groupBy("n").agg(F.ceil(F.count("*") / BOXES).cast("int").alias("_of"))
    held = boxes.join(number, "n").withColumn("_block", F.pmod(F.xxhash64("label", "tile"), F.col("_of")).cast("int"))
    held = held.groupBy("n", "_block").agg(F.collect_list(F.struct("label", "tile", "low", "high")).alias("boxes"))
    wanted = _blocks(asked, ["n"], parts).join(number, "n").select("n", "asked", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("_block"))
    found = wanted.join(held, ["n", "_block"]).select("n", "asked", "boxes").mapInArrow(reached, "aid long, n int, label int, tile string, bound long")
    if not first:
        return found
    best = found.groupBy("aid").agg(F.max(F.struct("bound", "n", "label", "tile")).alias("_m"))
    return best.select("aid", "_m.n", "_m.label", "_m.tile", "_m.bound")


_FOUND = "aid long, slot int, score long, vec_id long"


def searched(asked: DataFrame, held: DataFrame, visited: DataFrame, k: int, parts: int) -> DataFrame:
    """(aid, slot, score, vec_id): the k best of each visited tile for each window of an anchor."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, starts = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "starts"))
                x = b.column("vectors")[i].values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                tree, anchors = Tree(x, ids, starts), b.column("asked")[i].as_py()
                vectors = _vectors(anchors)
                least, most = intervals(tree.low, tree.high, vectors)
                out = [(a["aid"], *r) for j, a in enumerate(anchors) for r in tree.search(a["aid"], vectors[j], (least[j].tolist(), most[j].tolist()), a["windows"], k)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["aid", "slot", "score", "vec_id"])

    rows = visited.select("aid", "n", "label", "tile").join(asked.select("aid", "vector", "windows"), "aid")
    wanted = _blocks(rows, ["n", "tile", F.col("label").alias("_l")], parts).withColumnRenamed("_l", "label")
    return wanted.join(held, ["n", "label", "tile"]).select("ids", "vectors", "starts", "asked").mapInArrow(best, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("aid", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(asked: DataFrame, held: DataFrame, boxes: DataFrame, k: int, own: bool, parts: int) -> DataFrame:
    """(aid, slot, rank, score, vec_id): the first k of each window of the anchors asked (aid, n, label, vector, windows)."""
    first = durable(visits(asked, boxes, own, True, parts))
    some = durable(searched(asked, held, first, k, parts))
    kth = _ranked(some, k).where(F.col("rank") == k).groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("_kth"))
    floor = lambda w: F.coalesce(F.col("_kth")[w.slot], w.floor)
    raised = F.transform("windows", lambda w: F.struct(w.slot.alias("slot"), w.lo.alias("lo"), w.hi.alias("hi"), floor(w).alias("floor")))
    again = durable(asked.join(kth, "aid", "left").withColumn("windows", raised).drop("_kth"))
    rest = visits(again, boxes, own, False, parts).join(first.select("aid", "n", "label", "tile"), ["aid", "n", "label", "tile"], "left_anti")
    out = durable(_ranked(some.union(searched(again, held, rest, k, parts)), k))
    discard(first, some, again)
    return out


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, size: int = TILE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row for which the Column is_anchor holds, the
    first ``positives`` others of its label, and for each of them the first ``negatives`` of other labels that score between ``low``
    and ``high`` hundredths of it. vectors: vec_id, label, embedding."""
    tune(vectors.sparkSession)
    sound = "vec_id is not null and label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    rows = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("_m")).select("vec_id", "_m.label", "_m.embedding", F.size("_m.embedding").alias("n"))
    rows = durable(rows)
    same = Window.partitionBy("n", "label", F.xxhash64("embedding"), F.xxhash64(F.lit(1), F.col("embedding"))).orderBy("vec_id")
    kept = rows.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= max(positives + 1, negatives)).drop("_r")
    held = durable(tiles(kept, size))
    boxes = held.select("n", "label", "tile", "low", "high")
    anchors = durable(rows.where(is_anchor).select(F.col("vec_id").alias("aid"), "n", "label", F.transform("embedding", lambda x: F.floor(x * 256).cast("double")).alias("vector")))
    parts = max(1, -(-anchors.count() // BLOCK))
    window = lambda slot, lo, hi: F.struct(slot.cast("int").alias("slot"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.lit(-_MOST).alias("floor"))
    everything = F.array(window(F.lit(0), F.lit(-_MOST), F.lit(_MOST)))
    near = nearest(anchors.withColumn("windows", everything), held, boxes, positives, True, parts)
    score = F.col("score").cast("decimal(38,0)")
    limits = window(F.col("rank"), F.ceil(score * low / 100), F.floor(score * high / 100))
    asked = durable(near.groupBy("aid").agg(F.array_sort(F.collect_list(limits)).alias("windows")).join(anchors, "aid").withColumn("windows", F.filter("windows", lambda w: w.lo <= w.hi)).where("size(windows) > 0"))
    far = nearest(asked, held, boxes, negatives, False, parts)
    pairs = near.select("aid", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(pairs, ["aid", "slot"]).select(F.col("aid").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


ORACLE = f"""
with rows as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score from rows a join rows b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 100 = 0),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES})
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank, vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id) where not same and {LOW} * positive_score <= 100 * score and 100 * score <= {HIGH} * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= {NEGATIVES}
"""
