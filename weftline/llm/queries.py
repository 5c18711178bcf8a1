"""The registered queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import byte_bpe, collocations, common, fim, fingerprints, language, line_rules, media, near_dedup, packing, quality, substring_dedup, token_counts, token_files


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "token-files")
    token_files.write(common.documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, folder)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(common.documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(common.documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(common.documents(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(common.documents(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(common.documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.rules(common.documents(spark, sf_dir))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(common.documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(common.documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_quality, op3_near_dedup, op4_token_counts, op5_fingerprints, op6_substring_dedup, op7_byte_bpe, op8_media, op9_language, op10_packing, op11_line_rules, op12_fim, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op11_line_rules": line_rules.SQL, "op12_fim": fim.SQL, "op13_collocations": collocations.SQL}
