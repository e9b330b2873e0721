"""Translation scores of text pairs: media_id, src_lang, tgt_lang, ref (source and reference), hyp, back.

All scores are expressions on the row that holds both texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake import dims
from cuelake.dims import FILE_KEYS
from cuelake.functions.text import let, listed, tokens, words

from .rules import BENGALI, DEVANAGARI

NUMBER, DATE, ELEMENT = r"\d+", r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", r"\d+|[A-Z][a-z]+"
#: Weights of the parts of the overall score.
WEIGHTS = {"bleu": 0.20, "meteor": 0.15, "semantic": 0.25, "cultural": 0.15, "terminology": 0.10, "fluency": 0.10, "adequacy": 0.05}


def all_of(c: str | Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit(pattern), F.lit(0))


def pair_languages(cues: DataFrame, src: str, tgt: str, keys: tuple[str, ...] = FILE_KEYS) -> DataFrame:
    """Files of a medium in both languages (a regular one with the regular one, SDH with SDH), with the whole text of either side."""
    rest = [k for k in keys if k != "language"]
    rows = cues.where(F.col("language").isin(src, tgt)).groupBy(*rest, "language").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("_t"))
    text = rows.select(*rest, "language", F.array_join(F.transform("_t", lambda x: x.text), " ").alias("text"))
    a, b = text.where(F.col("language") == src), text.where(F.col("language") == tgt)
    return a.select(*rest, F.lit(src).alias("src_lang"), F.col("text").alias("ref")).join(b.select(*rest, F.lit(tgt).alias("tgt_lang"), F.col("text").alias("hyp")), rest)


#: Tokens of a stretch of rows whose n-grams are counted together, and bytes of an Arrow batch.
STRETCH, BATCH_BYTES = 1 << 20, 4 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _counted(sides: list[tuple[np.ndarray, np.ndarray]], max_n: int) -> list[np.ndarray]:
    """For hyp and ref (token hashes and number of tokens a row) of some rows: both numbers, the clipped precisions, and the share of distinct
    tokens that both have. Grams are hashes of the row and its tokens; equal ones stand together once all are sorted, which gives the count of
    each on either side."""
    lengths = [n for _, n in sides]
    rows = [np.repeat(np.arange(len(n)), n) for n in lengths]
    values = [v.view(np.uint64) for v, _ in sides]
    grams, out, f1 = [r.astype(np.uint64) for r in rows], [*lengths], None
    for n in range(1, max_n + 1):
        grams = [_mixed(g[: len(v) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + v[n - 1 :]) if len(v) >= n else g[:0] for g, v in zip(grams, values)]
        whole = [r[: len(g)] == r[n - 1 :] if len(g) else np.zeros(0, bool) for g, r in zip(grams, rows)]
        every = np.concatenate([g[w] for g, w in zip(grams, whole)])
        row = np.concatenate([r[: len(g)][w] for g, r, w in zip(grams, rows, whole)])
        order = np.argsort(every)
        every, of_hyp = every[order], order < int(whole[0].sum())
        begin = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
        row, total = row[order[begin]], np.diff(np.append(begin, len(every)))
        hyp = np.add.reduceat(of_hyp, begin, dtype=np.int64) if len(begin) else begin
        per_row = lambda w: np.bincount(row, w, len(lengths[0]))  # noqa: B023, E731
        out.append(per_row(np.minimum(hyp, total - hyp)) / np.maximum(lengths[0] - n + 1, 1))
        if n == 1:
            f1 = 2.0 * per_row((hyp > 0) & (hyp < total)) / np.maximum(per_row(hyp > 0) + per_row(hyp < total), 1)
    return [*out, f1]


def ngram_precisions(max_n: int = 4, by_language: bool = False, hyp: str = "hyp", ref: str = "ref") -> Column:
    """A struct of hyp_len, ref_len, the clipped precisions p1..pN and the F1 of distinct tokens of a row's texts (null: no tokens), made on the
    row that holds both, so texts are never shuffled: Spark makes the tokens' hashes, and an Arrow UDF counts n-grams for many rows at a
    time. ``by_language``: whitespace tokens for Bengali and Hindi. Sets the size of Arrow batches for the session."""
    SparkSession.active().conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    token = lambda c: F.when(F.col("tgt_lang").isin("bn", "hi"), words(c)).otherwise(tokens(c)) if by_language else tokens(c)
    hashed = lambda c: F.coalesce(F.transform(token(c), lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))
    names = ["hyp_len", "ref_len", *[f"p{n}" for n in range(1, max_n + 1)], "f1"]

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            at = [c.offsets.to_numpy() for c in columns]
            values = [c.values.to_numpy(zero_copy_only=False) for c in columns]
            done = (at[0] - at[0][0] + at[1] - at[1][0]) // STRETCH
            cuts = [0, *(np.flatnonzero(np.diff(done[:-1])) + 1).tolist(), len(at[0]) - 1]
            parts = [_counted([(v[o[lo] : o[hi]], np.diff(o[lo : hi + 1]).astype(np.int64)) for v, o in zip(values, at)], max_n) for lo, hi in zip(cuts, cuts[1:]) if lo < hi]
            kinds = [pa.int64()] * 2 + [pa.float64()] * (max_n + 1)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([p[k] for p in parts]) if parts else [], t) for k, t in enumerate(kinds)], names)

    schema = ", ".join(f"{n} {'long' if n.endswith('_len') else 'double'}" for n in names)
    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, schema)(hashed(hyp), hashed(ref))


def _brevity(g: Column) -> Column:
    return F.when(g.hyp_len > g.ref_len, 1.0).when(g.hyp_len > 0, F.exp(1 - g.ref_len / g.hyp_len)).otherwise(0.0)


def _bleu(g: Column, max_n: int = 4) -> Column:
    p = [g[f"p{k}"] for k in range(1, max_n + 1)]
    mean = F.exp(sum((F.ln(x) for x in p), F.lit(0.0)) / max_n)
    zero = F.least(*p) == 0 if max_n > 1 else p[0] == 0
    return F.when(zero, 0.0).otherwise(_brevity(g) * mean)


def bleu(pairs: DataFrame, max_n: int = 4, by_language: bool = False) -> DataFrame:
    """Adds hyp_len, ref_len and bleu: geometric mean of the clipped precisions times the brevity penalty; 0 if one of them is 0."""
    g = F.col("_g")
    rows = pairs.withColumn("_g", ngram_precisions(max_n, by_language))
    return rows.withColumns({"hyp_len": g.hyp_len, "ref_len": g.ref_len, "bleu": _bleu(g, max_n)}).drop("_g")


def bleu_components(pairs: DataFrame, max_n: int = 4) -> DataFrame:
    """Adds each order's precision with the brevity penalty."""
    g = F.col("_g")
    rows = pairs.withColumn("_g", ngram_precisions(max_n, by_language=True))
    return rows.withColumns({f"bleu_{k}": _brevity(g) * g[f"p{k}"] for k in range(1, max_n + 1)}).drop("_g")


def token_f1(hyp: str = "hyp", ref: str = "ref") -> Column:
    # without branches, so that either token array is made once
    h, r = F.array_distinct(tokens(hyp)), F.array_distinct(tokens(ref))
    return F.coalesce(2.0 * F.size(F.array_intersect(h, r)) / F.nullif(F.size(h) + F.size(r), F.lit(0)), F.lit(0.0))


def token_jaccard(a: str = "ref", b: str = "back") -> Column:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(both / F.nullif(F.size(x) + F.size(y) - both, F.lit(0)), F.lit(0.0))


def _kept(elements: Column, target: Column) -> Column:
    """Share of elements that the target has; 0 without elements. An element that stands many times is looked for once."""
    found = lambda e, t: F.filter(F.array_distinct(e), lambda x: t.contains(x))
    share = lambda e, f: F.size(F.filter(e, lambda x: F.array_contains(f, x))) / F.greatest(F.size(e), F.lit(1))
    return let(elements, lambda e: let(target, lambda t: let(found(e, t), lambda f: share(e, f))))


def semantic_estimate(source: str = "ref", target: str = "hyp") -> Column:
    n, m = F.char_length(source), F.char_length(target)
    lengths = F.least(n, m) / F.greatest(n, m, F.lit(1))
    kept = _kept(F.transform(all_of(source, ELEMENT), F.lower), F.lower(target))
    return F.least(F.lit(1.0), lengths * 0.4 + kept * 0.6)


def _any(c: str, terms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda x: F.col(c).contains(x))


def cultural_accuracy(source: str = "ref", target: str = "hyp", profile: str = "generic") -> Column:
    """``generic``: proportion of lengths and preserved numbers, for every language. ``language``: script, terms and register for
    Bengali and Hindi, 1 for English."""
    ratio = F.char_length(target) / F.greatest(F.char_length(source), F.lit(1))
    numbers = F.concat(all_of(source, NUMBER), all_of(source, DATE))
    generic = F.least(F.lit(1.0), F.lit(0.5) + F.when(ratio.between(0.5, 2.0), 0.2).otherwise(0.0) + _kept(numbers, F.col(target)) * 0.3)
    if profile == "generic":
        return generic
    give = lambda c, v: F.when(c, v).otherwise(0.0)
    bengali = give(F.col(target).rlike(BENGALI), 0.3) + give(_any(target, dims.CULTURAL_TERMS["bn"]), 0.25) + F.when(_any(target, dims.FORMAL_TERMS["bn"]), 0.2).when(_any(target, dims.INFORMAL_TERMS["bn"]), 0.15).otherwise(0.0) + 0.25
    hindi = give(F.col(target).rlike(DEVANAGARI), 0.3) + give(_any(target, dims.CULTURAL_TERMS["hi"]), 0.25) + give(_any(target, dims.FORMAL_TERMS["hi"]), 0.2) + 0.25
    tgt = F.col("tgt_lang")
    return F.when(tgt == "bn", bengali).when(tgt == "hi", hindi).when(tgt == "en", 1.0).otherwise(generic)


def terms(source: str = "ref") -> Column:
    """Capitalised words of the source (for Bengali and Hindi words of six characters and more)."""
    capitalised = all_of(source, r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*")
    return F.when(F.col("src_lang").isin("bn", "hi"), all_of(source, r"[\p{L}\p{N}_]{6,}")).otherwise(capitalised)


def fluency(target: str = "hyp") -> Column:
    sentences = F.filter(F.split(target, r"[.!?]+"), lambda x: F.trim(x) != "")
    lengths = F.array_distinct(F.transform(sentences, lambda x: F.size(words(x))))
    tgt = F.col("tgt_lang")
    return F.when(tgt == "en", F.when(F.size(lengths) > 1, 0.9).otherwise(0.8)).when(tgt == "bn", F.when(F.col(target).rlike(BENGALI), 1.0).otherwise(0.8)).when(tgt == "hi", F.when(F.col(target).rlike(DEVANAGARI), 1.0).otherwise(0.8)).otherwise(0.7)


def adequacy(source: str = "ref", target: str = "hyp") -> Column:
    """Mean over numbers, dates and entities of the share found in the target; entities are never extracted, so 2/3 at most."""
    part = lambda p: F.least(F.lit(1.0), F.size(all_of(target, p)) / F.greatest(F.size(all_of(source, p)), F.lit(1)))
    return (part(NUMBER) + part(DATE)) / 3


def tfa(pairs: DataFrame) -> DataFrame:
    """Adds terminology (1: no term list decides otherwise), the extracted terms' number, the share found in the target, fluency, and
    adequacy."""
    return pairs.withColumns({"terminology": F.lit(1.0), "n_terms": F.size(terms()), "terms_verbatim": _kept(terms(), F.col("hyp")), "fluency": fluency(), "adequacy": adequacy()})


def scored(pairs: DataFrame) -> DataFrame:
    """Adds all parts of the score of every pair, on the row that holds its texts; bleu and meteor come from one count of tokens."""
    g = F.col("_g")
    parts = tfa(pairs.withColumn("_g", ngram_precisions()))
    return parts.withColumns({"meteor": g.f1, "semantic": semantic_estimate(), "cultural": cultural_accuracy(), "bleu": _bleu(g)}).drop("_g")


def with_benchmarks(scores: DataFrame, dim: DataFrame) -> DataFrame:
    """Least scores of the pair of languages; null if there are none."""
    return scores.join(dim, ["src_lang", "tgt_lang"], "left")


def translation_score(parts: DataFrame, bench: DataFrame, all_benchmarks: bool = False) -> DataFrame:
    """Adds overall (0 to 100) and verdict. A tenth of each shortfall against the least scores is taken off: for bleu, meteor and
    fluency, with ``all_benchmarks`` also for semantic and cultural."""
    b = with_benchmarks(parts, bench)
    names = ("bleu", "meteor", "fluency") + (("semantic", "cultural") if all_benchmarks else ())
    short = sum((F.coalesce(F.greatest(F.lit(0.0), F.col(f"min_{n}") - F.col(n)), F.lit(0.0)) * 0.1 for n in names), F.lit(0.0))
    raw = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    overall = F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw - short) * 100)
    verdict = F.when(overall >= 90, "EXCELLENT").when(overall >= 80, "GOOD").when(overall >= 70, "FAIR").otherwise("POOR")
    return b.withColumn("overall", overall).withColumn("verdict", verdict)


def translation_recs(scores: DataFrame) -> DataFrame:
    """Adds recommendations (the first five), errors (the first three), severity, and the standing of each part."""
    ratio = F.char_length("hyp") / F.greatest(F.char_length("ref"), F.lit(1))
    tgt = F.col("tgt_lang")
    advice = listed(
        (F.col("bleu") < 0.3, "lexical accuracy"), (F.col("semantic") < 0.7, "meaning"), (F.col("cultural") < 0.8, "cultural context"), (F.col("fluency") < 0.8, "fluency"), (F.col("terminology") < 0.9, "terminology"),
        (F.col("adequacy") < 0.9, "completeness"), (tgt == "bn", "Bengali script"), (tgt == "hi", "Devanagari script"), (tgt == "en", "English flow"),
    )
    no_script = ((tgt == "bn") & ~F.col("hyp").rlike(BENGALI)) | ((tgt == "hi") & ~F.col("hyp").rlike(DEVANAGARI))
    errors = listed((ratio < 0.5, "omission"), (ratio > 2.5, "addition"), (no_script, "script missing"))
    severity = F.when((ratio < 0.5) | no_script, "high").when(ratio > 2.5, "medium").otherwise("low")
    standing = lambda c, good, poor: F.when(F.col(c) > good, "Good").when(F.col(c) > poor, "Poor").otherwise("Bad")
    return scores.withColumns({
        "recommendations": F.slice(advice, 1, 5), "errors": F.slice(errors, 1, 3), "severity": severity, "bleu_status": standing("bleu", 0.3, 0.2), "meteor_status": standing("meteor", 0.3, 0.2),
        "semantic_status": standing("semantic", 0.7, 0.5), **{f"{c}_status": standing(c, 0.8, 0.6) for c in ("cultural", "terminology", "fluency", "adequacy")},
    })
