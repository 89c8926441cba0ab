"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.llm import exact_dedup, language_id, mixing, ngram_join, quality, secret_scan, sentencepiece_codec, sql, substring_dedup, warc_fixity, wrappers

#: Production parameters that several places share.
MIX = {"alpha": 0.7, "budget_ratio": 1.0, "max_epochs": 4.0, "seed": 20240229}
SENTENCEPIECE_MODEL = os.environ.get("SORREL_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ingested_before() -> Column:
    """Sources with even numbers count as history, against which the others are deduplicated."""
    return F.try_to_number(F.regexp_extract("source", r"^src(\d{1,9})$", 1), F.lit("999999999")) % 2 == 0


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    planned = mixing.plan(docs, mixing.tempered(MIX["alpha"]), MIX["budget_ratio"], MIX["max_epochs"])
    return mixing.sample(docs.select("doc_id", "source"), planned, MIX["seed"], "repetition")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    ours, theirs = warc_fixity.page_records(pages), warc_fixity.page_records(warc_fixity.damaged(pages))
    return warc_fixity.audit(warc_fixity.trees(ours), warc_fixity.trees(theirs))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), SENTENCEPIECE_MODEL)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"), ingested_before())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": sql.quality_rules(quality.Limits()), "op2_ngram_join": sql.ngram_join(), "op3_source_mixing": sql.source_mixing(**MIX), "op4_substring_dedup": sql.substring_dedup(), "op6_warc_fixity": sql.warc_fixity(), "op10_exact_dedup": sql.exact_dedup()}
