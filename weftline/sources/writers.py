"""Sinks: upserts and replacements of Parquet tables, CSV and NDJSON exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """target with the rows of updates; an update without a value keeps the stored one."""
    values = [c for c in target.columns if c not in keys]
    joined = target.alias("t").join(updates.alias("u"), keys, "full_outer")
    return joined.select(*keys, *(F.coalesce(F.col(f"u.{c}"), F.col(f"t.{c}")).alias(c) for c in values))


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(rows.dropDuplicates(keys).join(target, keys, "left_anti").select(target.columns))


def replace(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target without the rows that share keys with rows, and rows."""
    return target.join(rows.select(keys).distinct(), keys, "left_anti").select(target.columns).unionByName(rows.select(target.columns))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def export_ndjson(df: DataFrame, path: str) -> None:
    df.write.json(path)
