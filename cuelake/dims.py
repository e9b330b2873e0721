"""Small fixed tables: languages, profiles, minima of translation scores, and rules. All are bounded, so joins broadcast them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A subtitle file: of each language a medium has a regular and an SDH file. A pair of texts, and a unit of work on a file.
FILE_KEYS = ("media_id", "language", "sdh")
PAIR_KEYS = ("media_id", "src_lang", "tgt_lang")
UNIT_KEYS = (*FILE_KEYS, "chunk_no")
#: Language code, name, and whether the language has a profile of its own.
LANGUAGES = [
    ("eng", "English", True), ("hin", "Hindi", True), ("ben", "Bengali", True), ("tel", "Telugu", False), ("mar", "Marathi", False), ("tam", "Tamil", False), ("guj", "Gujarati", False),
    ("kan", "Kannada", False), ("mal", "Malayalam", False), ("pun", "Punjabi", False), ("ori", "Odia", False), ("asm", "Assamese", False), ("urd", "Urdu", False), ("san", "Sanskrit", False),
    ("kok", "Konkani", False), ("nep", "Nepali", False), ("sit", "Sinhala", False), ("mai", "Maithili", False), ("bho", "Bhojpuri", False), ("raj", "Rajasthani", False), ("mag", "Magahi", False),
]
#: Least scores of a language pair: bleu, meteor, semantic, cultural, fluency.
BENCHMARKS = [
    ("en", "bn", 0.25, 0.30, 0.75, 0.80, 0.85), ("en", "hi", 0.28, 0.32, 0.78, 0.82, 0.87), ("bn", "en", 0.30, 0.35, 0.80, 0.75, 0.90),
    ("hi", "en", 0.32, 0.36, 0.82, 0.78, 0.92), ("bn", "hi", 0.22, 0.28, 0.70, 0.85, 0.80), ("hi", "bn", 0.22, 0.28, 0.70, 0.85, 0.80),
]
#: Terms that speak for a language's culture and register, by target language.
CULTURAL_TERMS = {
    "bn": ["নমস্কার", "আদাব", "সালাম", "প্রণাম", "ভাই", "দিদি", "দাদা", "বোন"],
    "hi": ["नमस्ते", "नमस्कार", "आदाब", "सलाम", "भाई", "बहन", "जी", "साहब"],
}
FORMAL_TERMS = {"bn": ["আপনি", "আপনার", "করবেন", "হবেন"], "hi": ["आप", "आपका", "जी हाँ", "जी नहीं", "श्रीमान", "श्रीमती"]}
INFORMAL_TERMS = {"bn": ["তুমি", "তোমার", "করবি", "হবি"]}
#: Terms of authentic Bengali (context, structure) and Hindi (context) subtitles.
BENGALI_CONTEXT = ["নমস্কার", "আদাব", "ধন্যবাদ", "আপনি", "তুমি", "ভাই", "বোন"]
BENGALI_STRUCTURE = ["এর", "টি", "টা", "কে", "রে", "তে", "দিয়ে", "থেকে"]
HINDI_CONTEXT = ["नमस्ते", "धन्यवाद", "आप", "तुम", "भाई", "बहन", "जी", "साहब"]


def frame(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    value = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v}D" if isinstance(v, float) else str(v)
    return spark.sql("select * from values " + ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows) + f" as t({names})")


def languages(spark: SparkSession) -> DataFrame:
    return frame(spark, LANGUAGES, "language, name, core")


def benchmarks(spark: SparkSession) -> DataFrame:
    return frame(spark, BENCHMARKS, "src_lang, tgt_lang, min_bleu, min_meteor, min_semantic, min_cultural, min_fluency")
