"""The queries of the operators of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meridian.llm import decontaminate, embedding_dedup, lm_score, mixing, ngram_join, pii, quality, token_counts, token_file, warc
from meridian.llm.common import read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(read(spark, sf_dir, "pages"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard(read(spark, sf_dir, "documents"), n=3, percent=90)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(read(spark, sf_dir, "documents"))


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_file.write_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_file.read_tokens(manifest)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(read(spark, sf_dir, "documents")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "log_weight", "target_share", "key")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(read(spark, sf_dir, "embeddings"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("h")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_token_counts, op2_warc_derivatives, op3_ngram_jaccard, op4_lm_score, op5_token_file, op6_pii, op7_mixing, op8_quality, op9_embedding_dedup, op10_decontaminate)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {}
