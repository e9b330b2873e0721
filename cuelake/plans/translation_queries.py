"""Queries on translation scores, each with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake import dims
from cuelake.operators import translation as T

from . import fixtures as X

R = lambda c: X.rounded(c).alias(c)
TOK = lambda c: rf"regexp_extract_all(lower({c}), '{X.WORD}')"
GRAMS = f"""
toks as (select media_id, src_lang, tgt_lang, {TOK('hyp')} as h, {TOK('ref')} as r from pairs),
grams as ({" union all ".join(f"select media_id, src_lang, tgt_lang, {n} as n, array_to_string({c}[i:i + {n - 1}], ' ') as g, {a} as a from toks, unnest(range(1, len({c}) - {n - 2})) u(i)" for n in range(1, 5) for c, a in (("h", 1), ("r", 0)))}),
counts as (select media_id, src_lang, tgt_lang, n, g, sum(a) as a, sum(1 - a) as b from grams group by all),
prec as (select media_id, src_lang, tgt_lang, coalesce(sum(a) filter (n = 1), 0)::bigint as hyp_len, coalesce(sum(b) filter (n = 1), 0)::bigint as ref_len, {", ".join(f"case when coalesce(sum(a) filter (n = {k}), 0) > 0 then coalesce(sum(least(a, b)) filter (n = {k}), 0) / sum(a) filter (n = {k}) else 0 end as p{k}" for k in range(1, 5))} from counts group by all),
bp as (select *, case when hyp_len > ref_len then 1.0 when hyp_len > 0 then exp(1 - ref_len / hyp_len) else 0.0 end as bp from prec),
bleu as (select media_id, src_lang, tgt_lang, hyp_len, ref_len, case when least(p1, p2, p3, p4) = 0 then 0 else bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) end as bleu from bp)"""
F1 = f"case when len(list_intersect(list_distinct({TOK('hyp')}), list_distinct({TOK('ref')}))) > 0 then 2.0::double * len(list_intersect(list_distinct({TOK('hyp')}), list_distinct({TOK('ref')}))) / (len(list_distinct({TOK('hyp')})) + len(list_distinct({TOK('ref')}))) else 0 end"
KEPT = lambda items, target: f"len(list_filter({items}, lambda x: contains({target}, x))) / greatest(len({items}), 1)"
SEMANTIC = f"least(1.0, least(length(ref), length(hyp)) / greatest(length(ref), length(hyp), 1) * 0.4::double + {KEPT('list_transform(regexp_extract_all(ref, ' + chr(39) + T.ELEMENT + chr(39) + '), lambda y: lower(y))', 'lower(hyp)')} * 0.6::double)"
NUMBERS = f"list_concat(regexp_extract_all(ref, '{T.NUMBER}'), regexp_extract_all(ref, '{T.DATE}'))"
CULTURAL = f"least(1.0, 0.5::double + case when length(hyp) / greatest(length(ref), 1) between 0.5 and 2.0 then 0.2 else 0 end + {KEPT(NUMBERS, 'hyp')} * 0.3::double)"
TERMS = r"regexp_extract_all(ref, '[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*')"
LENGTHS = r"len(list_distinct(list_transform(list_filter(regexp_split_to_array(hyp, '[.!?]+'), lambda s: trim(s) <> ''), lambda s: len(list_filter(regexp_split_to_array(s, '[\p{Z}\s]+'), lambda w: w <> '')))))"
FLUENCY = f"case when tgt_lang = 'en' then case when {LENGTHS} > 1 then 0.9 else 0.8 end else 0.7 end::double"
_PART = lambda p: f"least(1.0, len(regexp_extract_all(hyp, '{p}')) / greatest(len(regexp_extract_all(ref, '{p}')), 1))"
ADEQUACY = f"(({_PART(T.NUMBER)} + {_PART(T.DATE)}) / 3)::double"
_BENCH = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::double" for v in r) + ")" for r in dims.BENCHMARKS)
BENCH = f"\nbench as (select * from (values {_BENCH}) t(src_lang, tgt_lang, min_bleu, min_meteor, min_semantic, min_cultural, min_fluency))"
#: Pairs in the languages of the least scores, so that those count.
MAPPED = X.PAIRS.replace("'en' as src_lang, case when doc_id % 2 = 0 then lang else 'it' end as tgt_lang", "case when doc_id % 2 = 0 then 'hi' else 'bn' end as src_lang, 'en' as tgt_lang")
PARTS = f"""
parts as (select p.*, bleu, {F1} as meteor, {SEMANTIC} as semantic, {CULTURAL} as cultural, 1.0::double as terminology, {FLUENCY} as fluency, {ADEQUACY} as adequacy from pairs p join bleu using (media_id, src_lang, tgt_lang)),
short as (select *, greatest(0, coalesce(min_bleu - bleu, 0)) * 0.1 + greatest(0, coalesce(min_meteor - meteor, 0)) * 0.1 + greatest(0, coalesce(min_fluency - fluency, 0)) * 0.1 as short from parts left join bench using (src_lang, tgt_lang)),
scores as (select *, least(100.0, greatest(0.0, 0.2 * bleu + 0.15 * meteor + 0.25 * semantic + 0.15 * cultural + 0.1 * terminology + 0.1 * fluency + 0.05 * adequacy - short) * 100)::double as overall from short)"""


def _mapped(spark, d):
    return X.pairs(spark, d, mapped=True)


def _scores(spark, d):
    return T.translation_score(T.scored(_mapped(spark, d)), dims.benchmarks(spark))


def bleu(spark, d):
    return T.bleu(X.pairs(spark, d)).select(*dims.PAIR_KEYS, "hyp_len", "ref_len", R("bleu"))


def bleu_components(spark, d):
    return T.bleu_components(X.pairs(spark, d)).select(*dims.PAIR_KEYS, *[R(f"bleu_{k}") for k in range(1, 5)])


def language_pairing(spark, d):
    c = X.cues(spark, d).where("language = 'eng'")
    twin = c.withColumn("language", F.lit("hin")).unionByName(c)
    return T.pair_languages(twin, "eng", "hin").select("media_id", "sdh", F.char_length("ref").alias("ref_chars"), F.md5(F.col("hyp").cast("binary")).alias("hyp_md5"))


def benchmark_lookup(spark, d):
    p = X.pairs(spark, d).select("media_id", "src_lang", F.col("tgt_lang").alias("was"), F.when(F.col("media_id") % 3 == 0, "bn").when(F.col("media_id") % 3 == 1, "hi").otherwise("de").alias("tgt_lang"))
    return T.with_benchmarks(p, dims.benchmarks(spark))


def tfa(spark, d):
    return T.tfa(X.pairs(spark, d)).select(*dims.PAIR_KEYS, "terminology", "n_terms", R("terms_verbatim"), R("fluency"), R("adequacy"))


def translation_score(spark, d):
    return _scores(spark, d).select(*dims.PAIR_KEYS, R("overall"), "verdict")


def translation_recommendations(spark, d):
    r = T.translation_recs(_scores(spark, d))
    return r.select(*dims.PAIR_KEYS, F.array_join("recommendations", "; ").alias("recommendations"), F.array_join("errors", "; ").alias("errors"), "severity", "bleu_status", "semantic_status", "adequacy_status")


_ST = lambda c, g, p: f"case when {c} > {g} then 'Good' when {c} > {p} then 'Poor' else 'Bad' end as {c}_status"
QUERIES = {
    "bleu": (bleu, f"with {X.PAIRS}, {GRAMS} select media_id, src_lang, tgt_lang, hyp_len, ref_len, round(bleu, 6)::double as bleu from bleu"),
    "bleu_components": (bleu_components, f"with {X.PAIRS}, {GRAMS} select media_id, src_lang, tgt_lang, {', '.join(f'round(bp * p{k}, 6)::double as bleu_{k}' for k in range(1, 5))} from bp"),
    "token_f1": (lambda s, d: X.pairs(s, d).select(*dims.PAIR_KEYS, X.rounded(T.token_f1()).alias("f1")), f"with {X.PAIRS} select media_id, src_lang, tgt_lang, round({F1}, 6)::double as f1 from pairs"),
    "token_jaccard": (lambda s, d: X.pairs(s, d).select(*dims.PAIR_KEYS, X.rounded(T.token_jaccard()).alias("jaccard")), f"""with {X.PAIRS}, t as (select media_id, src_lang, tgt_lang, list_distinct({TOK('ref')}) as a, list_distinct({TOK('back')}) as b from pairs)
        select media_id, src_lang, tgt_lang, round(case when len(a) + len(b) > 0 then len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) else 0 end, 6)::double as jaccard from t"""),
    "semantic_estimate": (lambda s, d: X.pairs(s, d).select(*dims.PAIR_KEYS, X.rounded(T.semantic_estimate()).alias("semantic")), f"with {X.PAIRS} select media_id, src_lang, tgt_lang, round({SEMANTIC}, 6)::double as semantic from pairs"),
    "cultural_accuracy": (lambda s, d: X.pairs(s, d).select(*dims.PAIR_KEYS, X.rounded(T.cultural_accuracy()).alias("cultural")), f"with {X.PAIRS} select media_id, src_lang, tgt_lang, round({CULTURAL}, 6)::double as cultural from pairs"),
    "terminology_fluency_adequacy": (tfa, f"with {X.PAIRS} select media_id, src_lang, tgt_lang, 1.0::double as terminology, len({TERMS})::int as n_terms, round({KEPT(TERMS, 'hyp')}, 6)::double as terms_verbatim, round({FLUENCY}, 6) as fluency, round({ADEQUACY}, 6) as adequacy from pairs"),
    "translation_score": (translation_score, f"with {MAPPED}, {GRAMS}, {BENCH}, {PARTS} select media_id, src_lang, tgt_lang, round(overall, 6) as overall, case when overall >= 90 then 'EXCELLENT' when overall >= 80 then 'GOOD' when overall >= 70 then 'FAIR' else 'POOR' end as verdict from scores"),
    "translation_recommendations": (translation_recommendations, f"""with {MAPPED}, {GRAMS}, {BENCH}, {PARTS} select media_id, src_lang, tgt_lang, array_to_string(list_filter([case when bleu < 0.3 then 'lexical accuracy' end, case when semantic < 0.7 then 'meaning' end, case when cultural < 0.8 then 'cultural context' end,
        case when fluency < 0.8 then 'fluency' end, case when adequacy < 0.9 then 'completeness' end, 'English flow'], lambda x: x is not null)[1:5], '; ') as recommendations,
        coalesce(array_to_string(list_filter([case when length(hyp) / greatest(length(ref), 1) < 0.5 then 'omission' end, case when length(hyp) / greatest(length(ref), 1) > 2.5 then 'addition' end], lambda x: x is not null), '; '), '') as errors,
        case when length(hyp) / greatest(length(ref), 1) < 0.5 then 'high' when length(hyp) / greatest(length(ref), 1) > 2.5 then 'medium' else 'low' end as severity, {_ST('bleu', 0.3, 0.2)}, {_ST('semantic', 0.7, 0.5)}, {_ST('adequacy', 0.8, 0.6)} from scores"""),
    "language_pairing": (language_pairing, f"with {X.CUES}, t as (select media_id, sdh, string_agg(text, ' ' order by seq) as text from cues where language = 'eng' group by all) select media_id, sdh, length(text)::int as ref_chars, md5(text) as hyp_md5 from t"),
    "benchmark_lookup": (benchmark_lookup, f"with {X.PAIRS}, {BENCH}, p as (select media_id, src_lang, tgt_lang as was, case media_id % 3 when 0 then 'bn' when 1 then 'hi' else 'de' end as tgt_lang from pairs) select * from p left join bench using (src_lang, tgt_lang)"),
}
