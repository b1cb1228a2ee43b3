"""From raw documents to encoded text: known languages, one of each near-duplicate group, no benchmark passages,
no secrets, then token ids checked by decoding them.

Each stage takes all rows that the one before it kept and returns them with the columns of ``documents``, but for
the last, which returns a row of token counts and digests for each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stintlab.llm import bpe, decontaminate, jaccard, langid, secrets
from stintlab.llm.common import cut, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or unlike every learned language."""
    return langid.keep_identified(docs)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of similar ones."""
    return jaccard.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of a benchmark item."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; no document goes."""
    return secrets.redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    return bpe.round_trip(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_ngrams),
    ("decontamination", remove_benchmark),
    ("secret_scan", redact),
    ("bpe_round_trip", encode),
]

#: Hyperdimensional profiles, sampled paths and vocabulary merges have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
