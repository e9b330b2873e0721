"""Column expressions on cue texts and times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One word character run, as Python's \w+ and in every engine alike.
WORD = r"[\p{L}\p{N}_]+"
BLANK = r"[\p{Z}\s]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: Column | str) -> Column:
    """Whitespace tokens."""
    return F.array_remove(F.split(col(c), BLANK), "")


def tokens(c: Column | str) -> Column:
    """Lower-case word tokens."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(f"({WORD})"), F.lit(1))


def is_blank(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), BLANK, "") == ""


def clock(ms: Column | str, sep: str = ",") -> Column:
    """HH:MM:SS,mmm of whole milliseconds."""
    m = col(ms).cast("long")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    hours = F.floor(m / 3600000).cast("long")
    return F.concat(F.when(hours < 100, pad(hours, 2)).otherwise(hours.cast("string")), F.lit(":"), pad(F.floor(m / 60000).cast("long") % 60, 2), F.lit(":"), pad(F.floor(m / 1000).cast("long") % 60, 2), F.lit(sep), pad(m % 1000, 3))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once a row; within a lambda it would be made again for each element."""
    return F.transform(F.array(value), use)[0]


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def seconds(c: Column | str) -> Column:
    return col(c) / F.lit(1000.0)


def listed(*pairs: tuple[Column, str | Column]) -> Column:
    """Array of the texts whose condition holds."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in pairs]))
