"""Approximate nearest neighbours by largest inner product over shifted space-filling curves.

Inner products become distances by one more component (sqrt(M^2 - |x|^2), M the largest length; 0 for queries). For each of
``CURVES`` curves the vectors are projected to ``DIMS`` random directions, made even by the normal distribution function, shifted
and numbered along a Hilbert curve. Spark range-partitions and sorts the keys of every curve; running counts give each vector its
place on the curve, and ``CELL_ROWS`` to ``CELL_MOST`` places in a row are a cell (so many that a window has about ``CELLS``), however
many vectors share a key. A query takes the curves on
whose directions it lies farthest out, where neighbours stand out most, and on each the window of so many places on either side
of its own key; in the window's cells, which meet their queries in parts of about ``VISITS``, it is compared with all vectors in double precision, and the best of all windows are
merged and ranked.

The number of curves that a query takes and the width of its windows are fitted: of ``SAMPLE`` queries the true neighbours are looked up
in all rows, and of all numbers of curves the one is taken whose windows hold the share ``TARGET`` of them with the fewest
comparisons. So windows hold a bounded number of neighbours where the vectors have local structure, and widen where they have none.

Equal vectors are one entry with their smallest ids (k + 1; no result can hold more of them), so a vector shared by a third of all
rows costs one comparison. Entries and queries know each other by a hash of the vector (128 bits); nothing is joined on vectors.

Edge cases: vectors that are null, empty, zero, hold null or non-finite components take no part, neither do rows with a null vec_id;
vectors of each length are a collection of their own, with its own curves and cells; repeated rows count once; a query never
finds its own id; with fewer candidates all of them are returned (up to ``CELL_ROWS`` vectors are one cell); ties go to the
smaller vec_id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, tune

CURVES, DIMS, BITS = 16, 4, 10
CELL_ROWS, CELL_MOST, CELLS = 1024, 1 << 16, 16
VISITS = 2048
SAMPLE, TARGET = 100, 0.95


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of integer points (rows of x, each coordinate below 2^bits) along the Hilbert curve."""
    a = [x[:, i].astype(np.int64) for i in range(x.shape[1])]
    n = len(a)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(n):
            up = (a[i] & bit) != 0
            swap = np.where(up, 0, (a[0] ^ a[i]) & low)
            a[0] = np.where(up, a[0] ^ low, a[0] ^ swap)
            a[i] = a[i] ^ swap
    for i in range(1, n):
        a[i] ^= a[i - 1]
    turn = np.zeros_like(a[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((a[n - 1] & (1 << level)) != 0, (1 << level) - 1, 0)
    key = np.zeros_like(a[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((a[i] ^ turn) >> level) & 1)
    return key


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to a few thousandths."""
    return 1 / (1 + np.exp(-1.702 * x))


def curve_keys(x: np.ndarray, seed: int, curves: int = CURVES) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unit vectors on every curve, and how far out they lie on its directions (both rows x curves)."""
    rng = np.random.default_rng(seed)
    dims = min(DIMS, x.shape[1])
    key, out = np.empty((len(x), curves), np.int64), np.empty((len(x), curves))
    for c in range(curves):
        way, shift = np.linalg.qr(rng.normal(size=(x.shape[1], dims)))[0], rng.uniform(0, 0.25, dims)
        at = x @ way * np.sqrt(x.shape[1])
        key[:, c] = hilbert(np.minimum((_normal(at) * 0.75 + shift) * (1 << BITS), (1 << BITS) - 1).astype(np.int64))
        out[:, c] = (at * at).sum(1)
    return key, out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def with_keys(rows: DataFrame, queries: bool, seed: int) -> DataFrame:
    """(n, rep, curve, key, turn) of rows with n, rep, embedding and longest (largest length among vectors of that size). turn: place
    of the curve among those of a query, the one on which it lies farthest out first."""

    def keyed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for b, longest in batches:
            sizes, most = b.value_lengths().to_numpy(zero_copy_only=False), longest.to_numpy(zero_copy_only=False)
            key, turn = np.zeros((len(b), CURVES), np.int64), np.zeros((len(b), CURVES), np.int32)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                x = _matrix(b.take(pa.array(at)))
                square, m = (x * x).sum(1), most[at]
                more = np.zeros(len(x)) if queries else np.sqrt(np.maximum(m**2 - square, 0))
                key[at], out = curve_keys(np.column_stack([x, more]) / (np.sqrt(square) if queries else m)[:, None], seed)
                turn[at] = np.argsort(np.argsort(-out, 1, kind="stable"), 1)
            pairs = pa.StructArray.from_arrays([pa.array(key.ravel()), pa.array(turn.ravel())], ["key", "turn"])
            yield pa.ListArray.from_arrays(np.arange(len(key) + 1, dtype=np.int32) * CURVES, pairs)

    keyed.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    keys = F.arrow_udf(keyed, "array<struct<key:long,turn:int>>")("embedding", "longest")
    return rows.select("n", "rep", F.posexplode(keys).alias("curve", "k")).select("n", "rep", "curve", "k.key", "k.turn")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the number of their partition and how many entries of their curve come before them in it."""
    part, last, held = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        n, curve, asked = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "curve", "asked"))
        new = np.r_[last != (n[0], curve[0]), (n[1:] != n[:-1]) | (curve[1:] != curve[:-1])]
        count = np.cumsum(~asked)
        before = count - ~asked
        start = np.maximum.accumulate(np.where(new, np.arange(len(n)), -1))
        local = before - np.where(start >= 0, before[np.maximum(start, 0)], -held)
        last, held = (n[-1], curve[-1]), int(local[-1]) + int(not asked[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(local.astype(np.int64))], names=[*b.schema.names, "part", "local"])


def placed(points: DataFrame) -> DataFrame:
    """points (n, rep, curve, key, turn, asked) with their place on the curve: how many entries stand before them."""
    order = ["n", "curve", "key", "asked", "rep"]
    kept = points.select("n", "rep", "curve", "key", "turn", "asked")
    schema = f"{kept._jdf.schema().toDDL()}, part int, local long"
    ordered = durable(kept.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_counted, schema))
    earlier = Window.partitionBy("n", "curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("n", "curve", "part").agg(F.sum((~F.col("asked")).cast("long")).alias("held"))
    offsets = parts.select("n", "curve", "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
    return ordered.join(offsets, ["n", "curve", "part"]).select("n", "rep", "curve", "turn", "asked", (F.col("offset") + F.col("local")).alias("place"))


def nearest(x: np.ndarray, low: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and rows of the k best of x for each row of q (queries x min(k, rows)); ties go to the smaller ``low``."""
    by = np.argsort(low, kind="stable")
    x, k = x[by], min(k, len(x))
    score, rows = np.empty((len(q), k)), np.empty((len(q), k), np.int64)
    for lo in range(0, len(q), 256):
        s = q[lo : lo + 256] @ x.T
        limit = np.partition(s, -k, axis=1)[:, -k] if k < s.shape[1] else s.min(1)
        for i, scores in enumerate(s, lo):
            at = np.flatnonzero(scores >= limit[i - lo] - 1e-9)
            exact = (x[at] * q[i]).sum(1)
            top = np.lexsort((at, -exact))[:k]
            score[i], rows[i] = exact[top], by[at[top]]
    return score, rows


_BEST = "n int, query string, score double, rep string, low long"


def _table(n: int, query: pa.Array, score: np.ndarray, rows: np.ndarray, rep: pa.Array, low: np.ndarray) -> pa.Table:
    flat = pa.array(rows.ravel())
    return pa.table([pa.array(np.full(rows.size, n, np.int32)), query.take(pa.array(np.repeat(np.arange(len(rows)), rows.shape[1]))), pa.array(score.ravel()), rep.take(flat), pa.array(low[rows.ravel()])], names=["n", "query", "score", "rep", "low"])


def _compared(k: int):
    def cell(key, left, right):
        """The k best entries of a cell for each query that visits it."""
        if not left.num_rows or not right.num_rows:
            return _table(0, pa.array([], pa.string()), np.zeros((0, 0)), np.zeros((0, 0), np.int64), pa.array([], pa.string()), np.zeros(0, np.int64))
        low = left.column("low").to_numpy()
        score, rows = nearest(_matrix(left.column("embedding").combine_chunks()), low, _matrix(right.column("vector").combine_chunks()), k)
        return _table(key[0].as_py(), right.column("query").combine_chunks(), score, rows, left.column("rep").combine_chunks(), low)

    return cell


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best distinct entries of each query. An entry has the same score in all windows; partial ranks come before the shuffle."""
    order = Window.partitionBy("n", "query").orderBy(F.desc("score"), "low", "rep")
    return found.withColumn("_r", F.dense_rank().over(order)).where(F.col("_r") <= k).drop("_r").distinct()


def fitted(entries: DataFrame, queries: DataFrame, places: DataFrame, sizes: DataFrame, k: int, target: float, sample: int) -> DataFrame:
    """(n, held, turns, width, rows) of each length n: its entries, the number of curves a query takes, the places on either side of its
    key, and the places of a cell."""
    chosen = queries.withColumn("_r", F.row_number().over(Window.partitionBy("n").orderBy(F.xxhash64("rep"), "rep"))).where(F.col("_r") <= sample).select("n", F.col("rep").alias("query"), "embedding")
    asked: dict[int, list] = {}
    for r in chosen.collect():  # at most ``sample`` vectors of each length
        asked.setdefault(r["n"], []).append((r["query"], np.array(r["embedding"], np.float64)))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("n").to_numpy()
            for n in np.unique(size):
                part = b.take(pa.array(np.flatnonzero(size == n)))
                if int(n) in asked:
                    low = part.column("low").to_numpy()
                    score, rows = nearest(_matrix(part.column("embedding")), low, np.array([v for _, v in asked[int(n)]]), k + 1)
                    yield from _table(int(n), pa.array([q for q, _ in asked[int(n)]]), score, rows, part.column("rep"), low).to_batches()

    truth = _best(entries.select("n", "rep", "low", "embedding").mapInArrow(looked_up, _BEST), k + 1).where("rep <> query").select("n", "query", "rep")
    of_entry = places.where("not asked").select("n", "rep", "curve", F.col("place").alias("_there"))
    of_query = places.where("asked").select("n", F.col("rep").alias("query"), "curve", "turn", F.col("place").alias("_here"))
    far = truth.join(of_entry, ["n", "rep"]).join(of_query, ["n", "query", "curve"]).groupBy("n", "query", "rep").agg(F.array_sort(F.collect_list(F.struct("turn", F.abs(F.col("_here") - F.col("_there")).alias("d")))).alias("way"))
    # with the first t + 1 curves, the nearest that any of them brings query and neighbour
    nearest_by = far.select("n", F.posexplode(F.expr("transform(way, (w, i) -> array_min(transform(slice(way, 1, i + 1), x -> x.d)))")).alias("t", "d"))
    widths = nearest_by.groupBy("n", (F.col("t") + 1).alias("turns")).agg(F.percentile_approx("d", target, 1000).alias("width"))
    cost = F.col("turns") * F.least(2 * F.col("width") + CELL_ROWS, F.col("held"))
    best = widths.join(sizes.select("n", "held"), "n").groupBy("n").agg(F.min(F.struct(cost.alias("cost"), "turns", "width")).alias("_b")).select("n", "_b.turns", "_b.width")
    # a length without neighbours to learn from is searched whole
    found = sizes.select("n", "held").join(best, "n", "left").select("n", "held", F.coalesce("turns", F.lit(1)).alias("turns"), F.coalesce("width", "held").alias("width"))
    return found.withColumn("rows", F.greatest(F.lit(CELL_ROWS), F.least(F.lit(CELL_MOST), F.ceil(2 * F.col("width") / CELLS))))


def neighbours(vectors: DataFrame, is_query, k: int = 20, target: float = TARGET, sample: int = SAMPLE, seed: int = 17) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for every row for which the Column is_query holds."""
    tune(vectors.sparkSession)
    sound = "vec_id is not null and embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"
    zero = F.transform("embedding", lambda x: x + F.lit(0).cast("float"))  # one zero, not two
    rep = F.concat(F.hex(F.xxhash64("embedding")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), F.col("embedding"))))
    rows = vectors.select("vec_id", "embedding").where(sound).withColumn("embedding", zero).withColumn("rep", rep).withColumn("n", F.size("embedding"))
    smallest = rows.select("n", "rep", "vec_id", "embedding").withColumn("_r", F.dense_rank().over(Window.partitionBy("n", "rep").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    entries = durable(smallest.groupBy("n", "rep").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("embedding").alias("embedding")).withColumn("low", F.col("ids")[0]))
    square = F.expr("aggregate(embedding, 0d, (a, x) -> a + double(x) * double(x))")
    sizes = durable(entries.groupBy("n").agg((F.sqrt(F.max(square)) * (1 + 1e-12)).alias("longest"), F.count("*").alias("held")))  # a row for each length
    asked = durable(rows.where(is_query).select("vec_id", "n", "rep").distinct())
    queries = durable(entries.join(asked.select("n", "rep").distinct(), ["n", "rep"]).join(sizes.select("n", "longest"), "n").select("n", "rep", "embedding", "longest"))
    mine = with_keys(queries, True, seed).withColumn("asked", F.lit(True))
    points = with_keys(entries.join(sizes.select("n", "longest"), "n"), False, seed).withColumn("asked", F.lit(False)).unionByName(mine)
    places = durable(placed(points))
    fit = durable(fitted(entries, queries, places, sizes, k, target, sample))
    cell = lambda c: F.floor(c / F.col("rows"))
    first, last = F.greatest(F.col("place") - F.col("width"), F.lit(0)), F.least(F.col("place") + F.col("width"), F.col("held") - 1)
    visits = durable(places.where("asked").join(fit, "n").where("turn < turns").select(F.col("n").alias("at_n"), F.col("curve").alias("at_curve"), F.col("rep").alias("query"), F.explode(F.sequence(cell(F.least(first, F.col("held") - 1)), cell(last))).alias("at_cell")))
    # a cell meets its queries in parts of about ``VISITS``; cells that none visits meet nothing
    parts = visits.groupBy("at_n", "at_curve", "at_cell").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("_of"))
    visited = parts.select(F.col("at_n").alias("n"), F.col("at_curve").alias("curve"), F.col("at_cell").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("part"))
    cells = places.where("not asked").join(fit, "n").select("n", "curve", cell(F.col("place")).alias("cell"), "rep").join(visited, ["n", "curve", "cell"]).join(entries.select("n", "rep", "low", "embedding"), ["n", "rep"])
    dealt = visits.join(parts, ["at_n", "at_curve", "at_cell"]).withColumn("at_part", F.pmod(F.xxhash64("query"), F.col("_of")).cast("int")).drop("_of")
    dealt = dealt.join(queries.select(F.col("n").alias("at_n"), F.col("rep").alias("query"), F.col("embedding").alias("vector")), ["at_n", "query"])
    found = cells.groupBy("n", "curve", "cell", "part").cogroup(dealt.groupBy("at_n", "at_curve", "at_cell", "at_part")).applyInArrow(_compared(k + 1), _BEST)
    best = _best(found, k + 1)
    full = best.join(entries.select("n", "rep", "ids"), ["n", "rep"]).select("n", "query", F.explode("ids").alias("vec_id"), "score")
    lists = full.groupBy("n", "query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("list"))
    answer = asked.select(F.col("vec_id").alias("query_id"), "n", F.col("rep").alias("query")).join(lists, ["n", "query"])
    own = answer.select("query_id", F.posexplode(F.expr(f"slice(filter(list, x -> x.vec_id <> query_id), 1, {k})")).alias("pos", "x"))
    return own.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))


def op10_hilbert_ann(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
