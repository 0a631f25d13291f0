"""A training-data pipeline over documents: each stage calls one operator of quillframe.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet, and what
is read again is the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm import mixing, pii, sentencepiece, simhash, toxicity
from quillframe.llm.common import table, written


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under their language's threshold; rows of any id, also null, are judged."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return simhash.one_each(docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind."""
    return pii.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources' words meet their target weights."""
    return mixing.mix(docs, weights=(3, 1, 2), total=1.5, cap=2)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy's ids; decoding is checked against the text."""
    return sentencepiece.query(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash_dedup", simhash_dedup),
    ("pii", pii_redaction),
    ("mixing", source_mixing),
    ("sentencepiece", sentencepiece_encoding),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
