"""Training-data pipeline: five stages over ``documents``, each one operator on all that the last kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next stage's documents.  All but the last return the columns
of ``documents``.  There is no oracle SQL: XXH64 fingerprints, the trained classifier and
SentencePiece have no SQL form, so ``tests/llm/test_pipeline.py`` holds the whole run
against a brute-force version.

Defined results: null, empty and letterless texts are rejected by the first stage; repeated
rows and texts are one group, of which one row stays; ids may be null; extra columns are
carried to the last stage; very long texts are used whole; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.llm import decontaminate, language_id, secret_scan, sentencepiece_lattice, simhash
from stockroom.llm.common import read
from stockroom.plans.session import ensure_checkpoint_dir


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected and letterless ones go."""
    return language_id.known_languages(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: four-word shingles, at most four differing bits."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted again."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as SentencePiece ids, with the check that they decode to the text."""
    import public_tokenizers

    return sentencepiece_lattice.encode_and_check(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("sentencepiece", sentencepiece_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate results lie in the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
