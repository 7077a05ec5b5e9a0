"""A pipeline over documents: language, near duplicates, personal data, mix, tokens. Counted as part of tessera.llm.

Each stage takes any rows: null and empty texts, repeated rows, other columns and tables without rows have the results that its docstring names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, language, mixing, pii, tokenizer
from tessera.llm._spark import shared_folder

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Documents whose language has less than this probability are rejected, as are those without one.
LEAST_SCORE = 0.5
#: SQL cannot express the trained classifier of the first stage, so there is none for the whole.
ORACLE_SQL: str | None = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows. Null texts, and texts without a letter, go; repeated rows stay or go together; without labelled rows all go."""
    found = language.identify_languages(docs)
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group with similar word shingles. Texts without words, null ones and rows without an id stay; rows that share an id stay or go together."""
    return jaccard.deduplicated(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms; their lengths don't change. All rows stay; a null text stays null."""
    return pii.pseudonymise(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it. Texts without words aren't taken; documents without a source are a source; repeated rows are taken alike."""
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; a null text has the digests of no bytes."""
    return tokenizer.coded_digests(docs, BYTE_BPE, public_tokenizers.PATTERN)


STAGES = [("language_id", known_language), ("jaccard_join", near_duplicates), ("pii", personal_data), ("fair_mix", mix_sources), ("byte_bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each one's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
