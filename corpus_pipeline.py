"""A corpus from raw documents to packed sequences: five operators, each on all that its predecessor kept.

A stage's result is written before the next stage begins; what the stage put into the shared folder on its way is
dropped then, so the folder holds one stage's tables at a time.

Rows whose doc_id is null are not documents and leave at the near-duplicate stage. An empty table runs through.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common, language, near_dedup, packing, quality, substring_dedup, tokens


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def stage(function: Stage) -> Stage:
    """The function, which first drops what the stage before it left; tables that docs itself still reads stay."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left:
            read = "\n".join(docs.inputFiles())
            for path in [p for p in _left if p.rpartition("/")[2] not in read]:
                common.drop_path(spark, path)
                _left.remove(path)
        with common.noting(_left):
            return function(spark, docs, sf_dir)

    return run


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or a clear language go."""
    return language.keep(docs, language.learn(docs))


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that both views together take for bad go."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return near_dedup.keep_first(docs)


@stage
def substring_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stay in another document go; n_chars follows the text."""
    left = substring_dedup.remove(docs)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), kept=tokens.FEW_PIECES)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("substring_duplicates", substring_duplicates),
    ("packing", pack),
]

#: No stage can be expressed in SQL; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written as Parquet and read again by the next."""
    docs = common.documents(spark, sf_dir)
    for name, step in STAGES:
        docs = common.materialize(step(spark, docs, sf_dir), name)
    return docs
