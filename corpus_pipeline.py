"""Documents to token ids: language, repeated lines, near duplicates, benchmark passages, encoding.

Each stage takes and gives documents (doc_id, text, lang, source, n_chars), the last one gives token ids. Further columns,
whatever their names, are left behind; any column may be null. Every stage works
on all that the one before has kept, and what it gives is written before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockledger.llm import bpe, decontaminate, jaccard, langid, lines
from blockledger.llm.staging import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null or have no letter; a missing lang is filled in where the text is like a language.

    The likeness itself rejects nothing: how low it is for clean text depends on the script and on the length.
    """
    rows = docs.select(*COLUMNS)
    profiles = langid.train(rows.where(langid.fold("doc_id", 5) != 0))
    known = langid.predict(rows, profiles)
    known = known.where(F.col("lang_pred") != langid.UNKNOWN)
    return known.withColumn("lang", F.coalesce("lang", F.when(F.col("score") > 0, F.col("lang_pred")))).select(*COLUMNS)


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of two lines or more, and single repeated lines of 20 words or more.

    A document of which nothing is left goes; null texts and texts that were blank before stay. Of rows with the same
    doc_id the order is by a hash of their texts; repeated rows are cut alike. No documents give none.
    """
    cut = lines.drop_repeated_lines(docs.select(*COLUMNS))
    cut = cut.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedupe_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: those that share 0.8 of their shingles of five words.

    It is that of the smallest doc_id, null last. Texts without words are in no group and all stay. No documents give none.
    """
    return jaccard.drop_near_duplicates(docs.select(*COLUMNS), width=5, share=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null and empty texts, and all against an empty benchmark, stay."""
    found = decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of them and of what they decode to.

    Null and empty texts have no ids; repeated rows are encoded each. No documents give no rows.
    """
    encoded = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return bpe.digests(encoded, "ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedupe_lines),
    ("jaccard_join", dedupe_documents),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Rank-order profiles and merges cannot be written in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
