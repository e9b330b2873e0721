"""License scans by diagonal voting, in DataFrame functions alone.

Every word 3-gram of a text is hashed and joined with the 3-grams of the license phrases (a fixed table of some two hundred rows,
broadcast). A match at word p with place t of a phrase votes for the diagonal p - t, where the phrase would start. Votes of a
diagonal are the set of places t, held as bits of a long. Diagonals of one phrase at most ``GAP`` apart merge into one span
(words were added or left out there); a span counts if its votes cover ``COVER`` of the phrase and it is at most twice as
long. Matches compare the words themselves after the hash, so a full diagonal is an exact occurrence.

Base phrases count only as exact occurrences; the other phrases add labels. Edge cases: null and empty texts have no words, no
places (0, null, null), no labels ('') and score 0; repeated rows come out as often as they went in; a null doc_id is kept;
texts under three words match nothing; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, GAP, COVER = 3, 2, 0.8
#: Label, whether it is a base phrase, and the phrase's words.
PHRASES = [
    ("mit", True, "under the mit license"),
    ("apache-2", True, "apache license version 2"),
    ("cc-by-nc", True, "cc by nc"),
    ("mit", False, "the mit license"),
    ("gpl-3", False, "gnu general public license version 3"),
    ("gpl-2", False, "gnu general public license version 2"),
    ("lgpl", False, "gnu lesser general public license"),
    ("agpl-3", False, "gnu affero general public license version 3"),
    ("mpl-2", False, "mozilla public license version 2"),
    ("bsd", False, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", False, "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", False, "creative commons attribution noncommercial"),
    ("cc-by", False, "creative commons attribution 4 0 international"),
    ("isc", False, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", False, "this is free and unencumbered software released into the public domain"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: lower() changes more than A-Z, but only outside ASCII, where it leaves word characters word characters; the only ones that it
#: turns into ASCII are the Kelvin sign (k) and the dotted capital I (i with a combining dot), and no phrase has a k.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ROWS = ", ".join(f"({i}, '{label}', {str(base).lower()}, '{phrase}')" for i, (label, base, phrase) in enumerate(PHRASES))


def templates(spark) -> DataFrame:
    """The 3-grams of the phrases with hash, phrase number, label, place as a bit, place, and number of places."""
    phrases = spark.sql(f"select * from values {_ROWS} as p(phrase, label, base, text)").withColumn("w", F.split("text", " "))
    shifted = phrases.select("phrase", "label", "base", F.size("w").alias("size"), F.col("w").alias("w0"), F.expr("slice(w, 2, size(w))").alias("w1"), F.expr("slice(w, 3, size(w))").alias("w2"))
    rows = shifted.select("phrase", "label", "base", "size", F.posexplode(F.arrays_zip("w0", "w1", "w2")).alias("place", "g")).where("g.w2 is not null")
    return rows.select(F.xxhash64("g.w0", "g.w1", "g.w2").alias("th"), F.col("g.w0").alias("t0"), F.col("g.w1").alias("t1"), F.col("g.w2").alias("t2"), "phrase", "label", "base", "size", "place", F.expr("shiftleft(1L, place)").alias("bit"))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans
    (phrase label, first word, word after the last, share of the phrase)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select("doc_id", F.xxhash64(text).alias("key"), F.array_remove(F.split(F.lower(text), BETWEEN), "").alias("w"))
    # The first element of each array stands for the text itself; it matches nothing and keeps the text in the result.
    # posexplode_outer, as posexplode would add a filter that makes the array once more.
    alone = "array(named_struct('w0', cast(null as string), 'w1', cast(null as string), 'w2', cast(null as string)))"
    shifted = words.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), F.col("w").alias("w0"), F.expr("slice(w, 2, size(w))").alias("w1"), F.expr("slice(w, 3, size(w))").alias("w2"))
    zipped = shifted.select("doc_id", "key", "n_words", F.expr(f"concat({alone}, arrays_zip(w0, w1, w2))").alias("z"))
    grams = zipped.select("doc_id", "key", "n_words", F.posexplode_outer("z").alias("pos", "g")).select("doc_id", "key", "n_words", (F.col("pos") - 1).alias("pos"), "g.w0", "g.w1", "g.w2", F.xxhash64("g.w0", "g.w1", "g.w2").alias("h"))
    t = F.broadcast(templates(docs.sparkSession))
    # The join key is the hash alone (one long); the words are compared afterwards.
    votes = grams.join(t, F.col("h") == F.col("th"), "left").where("pos = -1 or (phrase is not null and w0 = t0 and w1 = t1 and w2 = t2)")
    diagonals = votes.groupBy("doc_id", "key", F.coalesce(F.col("phrase"), F.lit(-1)).alias("phrase"), F.coalesce(F.col("pos") - F.col("place"), F.lit(0)).alias("diagonal")).agg(
        F.first("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("size").alias("size"),
        F.bit_or("bit").alias("bits"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("_rows"),
    )
    return _summary(diagonals)


def _summary(diagonals: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id", "key", "phrase").orderBy("diagonal")
    exact = "bit_count(bits) = size - 2"
    islands = diagonals.withColumn("_new", F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= GAP, 0).otherwise(1)).withColumn("island", F.sum("_new").over(order))
    spans = islands.groupBy("doc_id", "key", "phrase", "island").agg(
        F.first("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("size").alias("size"), F.bit_or("bits").alias("bits"), F.min("lo").alias("lo"), (F.max("hi") + K).alias("hi"),
        F.count(F.expr(f"case when {exact} then 1 end")).alias("places"), F.min(F.expr(f"case when {exact} then diagonal end")).alias("first"), F.max(F.expr(f"case when {exact} then diagonal end")).alias("last"),
        F.sum("_rows").alias("_rows"),
    )
    share = F.expr("bit_count(bits) / (size - 2)")
    spans = spans.withColumn("share", share).withColumn("holds", F.expr(f"case when base then places > 0 else share >= {COVER} and hi - lo <= 2 * size end"))
    joined = lambda test: F.array_join(F.array_sort(F.collect_set(F.expr(f"case when {test} then label end"))), ",")
    found = spans.groupBy("doc_id", "key").agg(
        F.first("n_words").alias("n_words"), F.coalesce(F.sum(F.expr("case when base then places end")), F.lit(0)).alias("n_base"),
        F.min(F.expr("case when base then first end")).cast("long").alias("first_word"), F.max(F.expr("case when base then last end")).cast("long").alias("last_word"),
        joined("base and holds").alias("base_labels"), joined("holds").alias("labels"), F.coalesce(F.max(F.expr("case when holds then least(share, 1d) end")), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.expr("case when holds then struct(label, lo as start, hi as stop, share) end"))).alias("spans"),
        F.max(F.expr("case when phrase = -1 then _rows end")).cast("int").alias("_copies"),
    )
    return found.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).drop("_copy", "_copies", "key")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


ORACLE = rf"""
with phrases as (select * from (values {_ROWS}) p(phrase, label, base, text)),
parts as (select phrase, label, base, string_split(text, ' ') as w from phrases),
grams as (select phrase, label, base, len(w) as size, i as place, w[i + 1] as t0, w[i + 2] as t1, w[i + 3] as t2 from parts, unnest(range(len(w) - 2)) u(i)),
docs as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from documents),
words as (select rid, unnest(w) as w0, unnest(range(len(w))) as pos from docs),
near as (select rid, pos, w0, lead(w0) over o as w1, lead(w0, 2) over o as w2 from words window o as (partition by rid order by pos)),
votes as (select rid, phrase, label, base, size, pos - place as diagonal, place, pos from near join grams on w0 = t0 and w1 = t1 and w2 = t2),
diagonals as (select rid, phrase, label, base, size, diagonal, bit_or(1::bigint << place) as bits, min(pos) as lo, max(pos) as hi from votes group by all),
marked as (select *, case when diagonal - lag(diagonal) over o <= {GAP} then 0 else 1 end as fresh from diagonals window o as (partition by rid, phrase order by diagonal)),
islands as (select *, sum(fresh) over (partition by rid, phrase order by diagonal) as island from marked),
spans as (select rid, phrase, label, base, size, island, bit_or(bits) as bits, min(lo) as lo, max(hi) + {K} as hi,
  count(*) filter (bit_count(bits) = size - 2) as places, min(diagonal) filter (bit_count(bits) = size - 2) as first, max(diagonal) filter (bit_count(bits) = size - 2) as last
  from islands group by rid, phrase, label, base, size, island),
judged as (select *, bit_count(bits) / (size - 2) as share, case when base then places > 0 else bit_count(bits) / (size - 2) >= {COVER} and hi - lo <= 2 * size end as holds from spans),
found as (select rid, sum(places) filter (base) as n_base, min(first) filter (base) as first_word, max(last) filter (base) as last_word,
  string_agg(distinct label, ',' order by label) filter (base and holds) as base_labels, string_agg(distinct label, ',' order by label) filter (holds) as labels,
  max(least(share, 1.0)) filter (holds) as score from judged group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from docs left join found using (rid)
"""
