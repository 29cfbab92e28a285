"""The corpus pipeline: language ID, near-duplicate removal, substring deduplication, packing.

Each stage takes what its predecessor kept and returns the columns of documents, the last one packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm import language, near_duplicates, packing, substrings
from citemill.llm.common import stored, unused

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of letters that the predicted language must have.
LEAST_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts of which no language has half; a missing label becomes the predicted one."""
    found = language.predict(docs, language.train(docs), keep=["text", "lang", "source", "n_chars"])
    kept = found.where((F.col("lang_pred") != language.UND) & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest id."""
    return near_duplicates.dedup_documents(docs).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that stand in an earlier document, and leaves line breaks and all else as they are; texts that lose all go."""
    none = unused(docs, "no_text")
    done = substrings.dedup_substrings(docs.withColumn(none, F.col("text").isNull()), keep=["lang", "source", none], layout=True)
    left = done.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(~F.col(none), F.col("kept"))
    return left.withColumn("text", text).withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.op8_minimum_bin_slack(spark, sf_dir, docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: Trained models, signatures and tokenizers are beyond SQL; a test compares each stage with brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
