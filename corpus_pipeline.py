"""From raw documents to packed sequences: quality, near-duplicates, secrets, mixing, packing.

Each stage is a function of (spark, docs, sf_dir), where docs is what its predecessor kept, and all
but the last return the columns of docs. The tables under sf_dir are read for labels only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cairnlog.llm import mixing, packing, quality, secret_scan, simhash
from cairnlog.llm.common import table, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network scores 0.3 or more; it is fitted on labelled documents of docs."""
    return quality.kept(docs, quality.fitted(docs, table(spark, sf_dir, "labels")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of every near-duplicate group."""
    return simhash.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the secrets that the forest confirms replaced."""
    return secret_scan.redacted(docs, secret_scan.forest(spark))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the temperature mix reads it: all at least once, none over the repetition limit."""
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", distinct_documents),
    ("secret scans", without_secrets),
    ("mixing sources", mixed_sources),
    ("best-fit packing", packed_sequences),
]

#: A trained network, fingerprints and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
