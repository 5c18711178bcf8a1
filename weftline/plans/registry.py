"""The registry of named queries: a plan for Spark and, where SQL can express it, the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str) -> None:
    """Register every table as a temporary view; a plan is bound to its tables when it is made."""
    for name in TABLES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query in SQL; oracle is its text in the other dialect where that differs."""

    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables(spark, sf_dir)
        return spark.sql(text)

    plan.__name__ = name
    QUERIES[name] = plan
    ORACLES[name] = oracle or text


def query(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan made with the DataFrame API."""

    def add(plan: Plan) -> Plan:
        QUERIES[name] = plan
        if oracle:
            ORACLES[name] = oracle
        return plan

    return add
