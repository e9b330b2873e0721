"""A corpus pipeline of five stages over ``documents``: language identification, toxicity, near-duplicates, repeated passages,
packing. Each stage works on all rows that its predecessor kept; all but the last return the columns of documents.

Rows are carried whole: a stage's own columns never replace columns of the input, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import language_id, minhash, packing, suffix_dedup, toxicity
from cuelake.llm.common import discard, durable


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id and text, and the whole row as one struct."""
    return docs.select("doc_id", "text", F.struct("*").alias("_all"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not recognised: without letters, or scored below the calibrated limit."""
    model = language_id.fit(language_id.training_rows(docs.select("doc_id", "text", "lang")))
    return language_id.predict(_carried(docs), model).where(~F.col("rejected")).select("_all.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted to be toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.select("doc_id", "text"), toxicity.training_labels(labels))
    return toxicity.score(_carried(docs), model).where("predicted = 0").select("_all.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-duplicates."""
    found = minhash.classes(docs.select("doc_id", "text"))
    return docs.join(found.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes and more that a document with a smaller doc_id has; n_chars follows the text."""
    # one doc_id may stand for several texts: a row takes what is left of its own
    found = suffix_dedup.deduplicated(docs.where("doc_id is not null and text is not null").select("doc_id", "text"), with_text=True)
    kept = found.select("doc_id", F.col("text_sha256").alias("_sha"), F.col("kept").cast("string").alias("_kept")).dropDuplicates(["doc_id", "_sha"])
    named = docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("_sha"), F.struct("*").alias("_all"))
    own = lambda c: F.col("_all").getField(c)
    left = F.coalesce("_kept", own("text"))
    new = {"text": left, "n_chars": F.char_length(left).cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    joined = named.join(kept, ["doc_id", "_sha"], "left")
    return joined.select(*[new.get(c, own(c)).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in bins."""
    return packing.packed(durable(packing.measured(docs)))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("best_fit_packing", pack_sequences),
]

#: The classifiers are trained, which SQL cannot express; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs, before = durable(stage(spark, docs, sf_dir)), docs
        if k:  # not the input itself
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
