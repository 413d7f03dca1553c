"""The queries of this subpackage, one for each operator, over whole tables; and their SQL, where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, fingerprint, jaccard_join, line_dedup, media, mixing, quality, secrets, suffix_dedup
from .common import table

TOKENIZER = "word_bpe_49k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"))


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(table(spark, sf_dir, "documents"))


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(media.read(media.store(table(spark, sf_dir, "documents")), tensors=False))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality": op3_quality,
    "op4_secrets": op4_secrets,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_mixing": op6_mixing,
    "op7_merkle": op7_merkle,
    "op8_perspectives": op8_perspectives,
    "op9_media": op9_media,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op5_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op7_merkle": fingerprint.ORACLE_SQL,
    "op6_mixing": mixing.ORACLE_SQL,
    "op8_perspectives": chat.ORACLE_SQL,
    "op10_jaccard_join": jaccard_join.ORACLE_SQL,
}
