"""The corpus pipeline: from raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orogen.llm import line_quality, mixing, ngram_join, packing, suffix_dedup
from orogen.llm.common import documents, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go."""
    return line_quality.good_documents(docs, documents(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links join stays, that of the smallest doc_id."""
    return ngram_join.first_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur anywhere else, too, are taken out of the texts."""
    return suffix_dedup.without_repeats(docs, suffix_dedup.WORDS, suffix_dedup.WORD_Q, "word")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their targets."""
    return mixing.take_words(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, their ids included, with their places in sequences of 2048."""
    return packing.pack_documents(docs, keep_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mix", mix), ("pack", pack)]

#: The classifier, MinHash, fingerprints and the tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage written before the next one reads it."""
    docs = documents(spark, sf_dir)
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
