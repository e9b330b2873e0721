"""Joins on time: rows in intervals, and rows within a band, as equi-joins on time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each level's buckets are so many times as wide as those of the level below.
FACTOR = 16
_LONGEST = (1 << 63) - 1


def widths(width_ms: int) -> list[int]:
    """Bucket widths of all levels; seventeen of the last hold any span of longs."""
    out = [width_ms]
    while out[-1] <= _LONGEST // FACTOR:
        out.append(out[-1] * FACTOR)
    return out


def bucket(t: Column, width: Column | int) -> Column:
    """Number of the bucket of whole milliseconds, exact for every long."""
    width = F.lit(width).cast("long") if isinstance(width, int) else width
    return F.call_function("div", t, width) - F.when((t < 0) & (t % width != 0), 1).otherwise(0)


def interval_join(spans: DataFrame, points: DataFrame, on: str = "media_id", width_ms: int = 4000, closed: bool = True, how: str = "inner", start: str = "start_ms", end: str = "end_ms", t: str = "t_ms") -> DataFrame:
    """Points with start <= t <= end (``closed``) or start <= t < end of each span, of any length.

    Buckets have levels, each FACTOR times as wide as the one below. A span stands on the level where it touches at most FACTOR + 1
    buckets, so a damaged end costs a few rows and loses no match; a point stands in its own bucket of the lowest level and of those
    levels that longer spans of its medium need (most media have none). Every match comes once; a left join keeps spans without points
    once for each bucket. Whether there are longer spans is looked up when the join is built."""
    wide = widths(width_ms)
    length = F.coalesce(F.try_subtract(F.greatest(F.col(end), F.col(start)).cast("long"), F.col(start).cast("long")), F.lit(_LONGEST))
    level = F.lit(len(wide) - 1)
    for k in reversed(range(len(wide) - 1)):
        level = F.when(length <= FACTOR * wide[k], k).otherwise(level)
    width_of = lambda c: F.element_at(F.array(*[F.lit(w).cast("long") for w in wide]), c + 1)
    placed = spans.withColumn("_l", level)
    first, last = F.col(start).cast("long"), F.greatest(F.col(end), F.col(start)).cast("long")
    a = placed.withColumn("_b", F.explode(F.sequence(bucket(first, width_of(F.col("_l"))), bucket(last, width_of(F.col("_l")))))).alias("a")
    near = points.withColumn("_l", F.lit(0)).withColumn("_b", bucket(F.col(t).cast("long"), width_ms))
    longer = placed.where("_l > 0").select(F.col(on).alias("_on"), "_l").distinct()
    if not longer.isEmpty():
        high = points.join(longer, F.col(on) == F.col("_on")).drop("_on")
        near = near.unionByName(high.withColumn("_b", bucket(F.col(t).cast("long"), width_of(F.col("_l")))))
    b = near.alias("b")
    inside = (F.col(f"b.{t}") >= F.col(f"a.{start}")) & ((F.col(f"b.{t}") <= F.col(f"a.{end}")) if closed else (F.col(f"b.{t}") < F.col(f"a.{end}")))
    keys = (F.col(f"a.{on}") == F.col(f"b.{on}")) & (F.col("a._l") == F.col("b._l")) & (F.col("a._b") == F.col("b._b"))
    rest = [F.col(f"b.{c}") for c in points.columns if c != on]
    return a.join(b, keys & inside, how).select(*[F.col(f"a.{c}") for c in spans.columns], *rest)


def band(t: Column, reach_ms: int) -> Column:
    """Buckets as wide as the reach that hold everything nearer than the reach."""
    at = F.floor(t / reach_ms)
    return F.array(at - 1, at, at + 1)
