"""The documents table made ready for training: five stages over all that the stage before kept.

Every stage but the last gives the columns of documents, whatever else they are called, for the rows that it keeps.

Defined results: rows with a null doc_id go through all stages; of those with one text, the second keeps one. Null
texts pass quality rules, equal no other text, have no near copies, are sampled with their source and have null ids;
empty texts are texts like any other, without ids. Ties go to the smallest doc_id. Rows that agree in doc_id and text
are copies. A null source is a source. An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sorrel.llm import exact_dedup, mixing, ngram_join, quality, sentencepiece_codec
from sorrel.llm.queries import MIX, SENTENCEPIECE_MODEL, ingested_before
from sorrel.llm.storage import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat themselves too much go."""
    return quality.keep(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, one ingested before if there is any; a row with a null text stays."""
    return exact_dedup.keep(docs, ingested_before())


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, that of the smallest doc_id stays; rows without words or doc_id stay."""
    return ngram_join.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources get their weights; a null source is one, too."""
    planned = mixing.plan(docs, mixing.tempered(MIX["alpha"]), MIX["budget_ratio"], MIX["max_epochs"])
    return mixing.sample(docs, planned, MIX["seed"])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, null for a null text."""
    return sentencepiece_codec.encode(docs, SENTENCEPIECE_MODEL)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", tokens),
]

#: SQL can't express SentencePiece; tests/llm hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every other stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs, f"stage{number}")
    return docs
