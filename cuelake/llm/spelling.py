"""Spelling variants: words one edit apart, found by walking a trie held as a table, level by level.

A node is a prefix of some word, an edge a step from a node by the next letters of a word (with a mark at the word's end). States are
(word, position, node, edits). Without an edit a word stands on its own path, so the states before the edit, of all positions, are made
in one pass. The first join takes the edit and a level of ``LEVELS[0]`` letters: a replaced letter goes over any edge whose first letter is
free, a deleted one stays at its node. What is left is joined with the edges of the next level, of ``LEVELS[1]`` letters, and so on; the rest
of long words is one edge. A state whose edge ends a word is a neighbour. Inserted letters are the deleted ones of the other word, and
each replacement is found from the word with the larger letter, so every pair comes out once.

Edges are distinct by node and letters, so a prefix that very many words share adds no more than an alphabet of ends to each state,
and no pairs of words are listed but neighbours. Names over ``LONG`` letters (of nodes, words and the rest of words) are a
beginning and 128 bits of hashes, so a run of a hundred thousand letters is no heavier a row than others.

A word's form is its most frequent neighbour, if that is at least twice as frequent; forms lead to roots by doubling pointers, in
rounds bounded by the logarithm of the logarithm of the largest count.

Edge cases: null and empty texts and texts without letters give no words; a null doc_id counts as the empty text in the rule that
deletes letters; repeated rows count each; ties go to the word first in code-point order; words without a neighbour have n_near 0
and are their own roots; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, durable

LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
LEVELS, LONG = (4, 8), 48
DELETE_EVERY = 97
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of at least ``least`` letters that occur ``count`` times or more. Of runs whose hash with the document's id
    DELETE_EVERY divides, one letter is deleted."""
    runs = F.regexp_extract_all(F.translate(text_col, _UPPER, _LOWER), F.lit(f"[a-zÀ-ÿ]{{{least},}}"), F.lit(0))
    rows = docs.select(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("_id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("_id", "run").cast("binary"))
    place = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    words = rows.select(F.when(h % DELETE_EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def _name(s: Column) -> Column:
    return F.when(F.char_length(s) <= LONG, s).otherwise(F.concat(F.substring(s, 1, 8), F.lit("#"), F.hex(F.xxhash64(s)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), s))))


def _ways(start: Column) -> list[Column]:
    """The letters from a position (from 0) to the word's end, by level; null beyond the end."""
    marked, out = F.concat("word", F.lit("$")), []
    for width in LEVELS:
        out.append(F.nullif(F.substring(marked, start + 1, F.lit(width)), F.lit("")))
        start = start + width
    return [*out, F.nullif(_name(F.substring(marked, start + 1, F.char_length(marked))), F.lit(""))]


def _edges(words: DataFrame, level: int) -> DataFrame:
    """(node, way, child) of a level after the first, for the positions where that level can begin."""
    depth, last = sum(LEVELS[:level]), level == len(LEVELS)
    at = words.where(F.char_length("word") >= depth).select("word", F.explode(F.sequence(F.lit(depth), F.char_length("word"))).alias("p"))
    marked = F.concat("word", F.lit("$"))
    width = F.char_length(marked) if last else F.lit(LEVELS[level])
    way = F.substring(marked, F.col("p") + 1, width)
    return at.select(_name(F.substring("word", F.lit(1), F.col("p"))).alias("node"), (_name(way) if last else way).alias("way"), _name(F.substring("word", F.lit(1), F.col("p") + width)).alias("child")).distinct()


def neighbours(words: DataFrame) -> DataFrame:
    """(a, b) of names of words that differ by one inserted, deleted or replaced letter, each pair once. words: word, name."""
    p, letter = F.col("p"), lambda k: F.substring("word", k, F.lit(1))
    at = words.select("word", "name", F.explode(F.sequence(F.lit(0), F.char_length("word") - 1)).alias("p"))
    node = _name(F.substring("word", F.lit(1), p))
    # of equal letters in a row only the first is deleted, as all give the same word
    kinds = F.explode(F.when((p == 0) | (letter(p + 1) != letter(p)), F.array(letter(p + 1), F.lit(""))).otherwise(F.array(letter(p + 1))))
    ways = [w.alias(f"w{k}") for k, w in enumerate(_ways(p + 1))]
    states = at.select("name", node.alias("node"), *ways, kinds.alias("letter"))
    free = at.select(node.alias("node"), ways[0], letter(p + 1).alias("_c"), _name(F.substring("word", F.lit(1), p + 1 + LEVELS[0])).alias("child"))
    own = words.select("word", F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("p"))
    kept = own.select(node.alias("node"), F.substring(F.concat("word", F.lit("$")), p + 1, F.lit(LEVELS[0])).alias("w0"), F.lit("").alias("_c"), _name(F.substring("word", F.lit(1), p + LEVELS[0])).alias("child"))
    # a letter that is replaced, or none where it is deleted
    first = free.unionByName(kept).distinct()
    met = states.join(first, ["node", "w0"]).where(((F.col("letter") == "") & (F.col("_c") == "")) | ((F.col("_c") != "") & (F.col("_c") < F.col("letter"))))
    rest = [f"w{k}" for k in range(1, len(LEVELS) + 1)]
    live = durable(met.select("name", F.col("child").alias("node"), *rest))
    ends, tables = [live.where("w1 is null").select("name", F.col("node").alias("near"))], [live]
    for level in range(1, len(LEVELS) + 1):
        begun = tables[-1].where(f"w{level} is not null")
        step = begun.join(_edges(words, level).withColumnRenamed("way", f"w{level}"), ["node", f"w{level}"])
        now = durable(step.select("name", F.col("child").alias("node"), *rest[level:]))
        tables.append(now)
        over = now if level == len(LEVELS) else now.where(f"w{level + 1} is null")
        ends.append(over.select("name", F.col("node").alias("near")))
    out = ends[0]
    for e in ends[1:]:
        out = out.union(e)
    pairs = durable(out.select(F.col("name").alias("a"), F.col("near").alias("b")))
    discard(*tables)
    return pairs


def groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs."""
    words = durable(vocabulary(docs, text_col, id_col).withColumn("name", _name(F.col("word"))))
    pairs = neighbours(words)
    both = pairs.union(pairs.select("b", "a"))
    known = both.join(words.select(F.col("name").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n")), "b")
    # the most frequent neighbour, of equal ones the first in code-point order
    best = known.groupBy("a").agg(F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("_m"), F.count("*").alias("n_near"))
    near = words.join(best.withColumnRenamed("a", "name"), "name", "left")
    enough = -F.col("_m.minus") >= ratio * F.col("n")
    out = durable(near.select("word", "n", F.when(enough, F.col("_m.near")).alias("form"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, -F.col("_m.minus")).alias("form_n")))
    discard(pairs)
    most = out.agg(F.max("n")).first()[0] or 1
    # each form is twice as frequent, so a way has at most log2(most) steps, and doubling takes the logarithm of that
    way = durable(out.where("form is not null").select("word", F.col("form").alias("root")))
    for _ in range(max(1, int(most).bit_length()).bit_length()):
        further = way.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        way, done = durable(way.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))), way
        discard(done)
    return out.join(way, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
