"""The corpus pipeline: language ID, exact and near deduplication, mixing, packing.

Each stage works on all that the one before it kept and, but for the last, returns the columns of documents. Between
stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import common, exact_dedup, jaccard, langid, mixing, packing

#: Least posterior probability of the predicted language.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language: no text, no letter, no language with half the probability, or one
    whose n-grams explain the text no better than chance would."""
    got = common.free_name(docs.columns, "_lang")
    rows = docs.withColumn(got, langid.predicted(spark, langid.train(docs), F.col("text")))
    good = (F.col(f"{got}.lang") != langid.UNKNOWN) & (F.col(f"{got}.score") >= LEAST_SCORE) & (F.col(f"{got}.fit") > 0)
    return rows.where(good).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts linked by shingle similarity the row with the smallest doc_id stays."""
    return jaccard.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents until the sources have their target shares."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("mix_sources", mix_sources),
    ("pack_best_fit", pack_sequences),
]

#: Similarity components, rounding and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
