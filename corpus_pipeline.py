"""From documents to token ids: language, exact copies, near copies, benchmark passages, encoding.

Every stage reads what its predecessor wrote. All but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfcast.llm.bpe import encode_digests
from shelfcast.llm.decontaminate import drop_leaks
from shelfcast.llm.exact_dedup import drop_copies
from shelfcast.llm.langid import fit_languages, keep_languages
from shelfcast.llm.ngram_join import drop_similar
from shelfcast.session import materialise

VOCABULARY = "word_bpe_49k.json"
WORDS_KEPT = 30_000  # the workers of earlier stages are still there: less memory for words than the operator takes alone

#: Learnt and probabilistic stages have no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the model, fitted on the labelled ones among them, rejects."""
    return keep_languages(docs, fit_languages(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item, word for word or with other values."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and the digests of ids and of the decoded text."""
    return encode_digests(docs, public_tokenizers.path(VOCABULARY), with_ids=True, words_kept=WORDS_KEPT)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("decontaminate", decontaminate),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
