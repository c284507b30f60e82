"""A training-data pipeline over ``documents``: language ID, exact dedup, n-gram Jaccard join, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stages
before it kept. All but the last return the columns of documents.

In every stage other columns may be null and may have any name, repeated rows
are rows of their own unless the stage is about them, and an empty table gives an
empty table. What becomes of a null or empty text, and of a null doc_id, is said
by each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilwright.llm import decontamination, exact_dedup, jaccard_join, language_id, sentencepiece_codec
from veilwright.llm.common import materialise, table
from veilwright.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts too), or far from every learned language, go. A null doc_id or lang is no reason to."""
    return language_id.drop_rejected(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, then that with the smallest doc_id; a null doc_id comes last. Null and empty texts are one text."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose 5-word shingles are 80 % alike the one with the smallest doc_id stays, a null one last. Documents without words stay."""
    return jaccard_join.keep_one(docs, shingle=5, percent=80)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; those without words stay."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what stays, each proved by decoding; a null text has none and counts as ''."""
    out = sentencepiece_codec.encode_and_decode(docs, vocabulary("piece_bpe_32k.model"))
    return out.select("doc_id", "lang", "source", "n_pieces", "ids", "exact")


STAGES = [
    ("7 language ID", language),
    ("2 exact dedup", exact),
    ("5 n-gram Jaccard join", near),
    ("1 benchmark decontamination", clean_of_benchmarks),
    ("10 SentencePiece", encoded),
]

#: Neither the language models nor the piece transducer can be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{k}")
    return docs
