"""From raw documents to token ids: classify, dedup lines, dedup documents, mix, encode.

Every stage gets all rows that its predecessor kept, written as Parquet and read again. All but the
last return the columns of `documents`; the last returns a row with the ids of each document taken.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import line_chunks, mixing, near_duplicates, quality_qda, sentencepiece_codec
from graphloom.llm.common import stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on the labelled ones among docs."""
    return quality_qda.keep(docs, quality_qda.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go from the texts; all documents stay."""
    return line_chunks.rewrite(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_duplicates.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and SentencePiece ids of each row."""
    return sentencepiece_codec.encode(docs, public_tokenizers.path(sentencepiece_codec.MODEL))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("tokens", tokens)]

#: Near duplicates, discriminants and segmentations aren't expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
