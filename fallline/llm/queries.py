"""The queries over the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; only queries look it up, operators take a path."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


@query
def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .best_fit import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


ORACLES["op3_quality_rules"] = oracles.QUALITY_RULES


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


ORACLES["op4_secret_scan"] = oracles.secret_scan()


@query
def op6_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .word_table import encode_decode_digests

    return encode_decode_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op8_log_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .log_frequency import score

    return score(table(spark, sf_dir, "documents"))


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bottom_k import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


ORACLES["op5_near_duplicates"] = oracles.NEAR_DUPLICATES


@query
def op2_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .site_quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .norm_buckets import top_k

    return top_k(table(spark, sf_dir, "embeddings"), every=20, k=20)


ORACLES["op7_norm_buckets"] = oracles.NORM_BUCKETS
