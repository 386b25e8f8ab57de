"""A corpus from raw documents to tokens, one operator a stage.

Every stage reads the written result of the one before. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from washline.llm import bpe, decontaminate, language, lines, simhash
from washline.llm.common import table, written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
ORACLE_SQL = None  # compression, fingerprints and merges are beyond SQL


def _lengths(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a changed text, where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters or with a narrow margin go."""
    marked = language.identify(docs, language.learn(docs))
    return marked.where(~F.col("rejected")).select(*docs.columns)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; copies are one page."""
    return _lengths(lines.remove_boilerplate(docs, distinct=True).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8. Texts that
    the stage before left without words are nobody's duplicates."""
    full = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    worded = docs.where(full)
    return simhash.keep_one(worded, simhash.similar(worded)).unionByName(docs.where(~full))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding: number, and digests of ids and decoded bytes."""
    return bpe.token_digests(docs, bpe.read_ranks(public_tokenizers.path(VOCABULARY)))


STAGES = [
    ("language_id", languages), ("line_dedup", boilerplate), ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminated), ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
