"""One query per operator of this folder, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figurant.llm import bpe, embeddings, jaccard, langid, licenses, lines, mixing, quality, substrings, warc
from figurant.llm.oracle import ORACLE_SQL
from figurant.llm.stages import table


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark, table(spark, sf_dir, "pages"), min_bytes=0)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.withColumn("char_distance", F.round("char_distance", 4)).withColumn("word_distance", F.round("word_distance", 4))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.linked(table(spark, sf_dir, "embeddings"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, with a text model fit on a bounded sample of the labelled documents."""
    model = langid.fit(table(spark, sf_dir, "documents"))
    out = langid.identify(langid.page_evidence(table(spark, sf_dir, "pages")), model)
    return out.select("page_id", "host", "declared", "text_language", "language", F.round("posterior", 6).alias("posterior"), "accepted")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {"op1_licenses": op1_licenses, "op2_quality": op2_quality, "op3_lines": op3_lines, "op4_substrings": op4_substrings, "op5_jaccard": op5_jaccard, "op6_embeddings": op6_embeddings, "op7_language": op7_language, "op8_mixing": op8_mixing, "op9_bpe": op9_bpe, "op10_warc": op10_warc}

__all__ = ["ORACLE_SQL", "QUERIES"]
