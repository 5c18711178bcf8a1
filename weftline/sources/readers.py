"""Sources: JSON lines, paged exports, nested event trees, sitemaps, HTML pages and bytes of unknown encoding."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from weftline.plans.registry import load, query

IMPORT_SCHEMA = "thread_id long, resource_id long, title string, node_id int, category_id int, post_count int, view_count int, last_post_date long, version string, content string"


def json_lines(spark: SparkSession, path: str, schema: str = IMPORT_SCHEMA) -> DataFrame:
    """One record a line; blank and broken lines are left out, as a filter on what the parser could not read."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null").drop("_bad")


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options = schema, options

    def partitions(self) -> list[Page]:
        return [Page(n) for n in range(1, int(self.options["pages"]) + 1)]

    def read(self, page: Page) -> Iterator[tuple]:
        with open(self.options["path"].format(page=page.number), encoding="utf-8") as f:
            for item in json.load(f)[self.options.get("items", "items")]:
                yield tuple(item.get(c) for c in self.schema.fieldNames())


class PagedSource(DataSource):
    """format("paged"): the pages of an export, one task each; path has {page}, items names the list in a page."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id long, title string, body string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, self.options)


def flatten_events(rows: DataFrame, column: str) -> DataFrame:
    """label, action and nb_events of the leaves of trees of JSON rows, however deep; a row without an action of its own has its parent's."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for tree in frame["tree"].dropna():
                left = [(row, None) for row in reversed(json.loads(tree))]
                while left:
                    row, above = left.pop()
                    action, below = row.get("action") or above, row.get("subtable")
                    if below is None:
                        out.append((row.get("label"), action, row.get("nb_events")))
                    else:
                        left += [(child, action or row.get("label")) for child in reversed(json.loads(below) if isinstance(below, str) else below)]
            yield pd.DataFrame(out, columns=["label", "action", "nb_events"]).astype({"nb_events": "Int64"})

    return rows.select(F.col(column).alias("tree")).mapInPandas(run, "label string, action string, nb_events long")


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """loc and lastmod of every url of a sitemap."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)


_bom = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
_charset = re.compile(rb"charset=[\"']?([A-Za-z0-9_-]+)")


def decode(body: bytes | None, content_type: str | None = None) -> str | None:
    """By byte order mark, declared charset (header, then page), UTF-8, and Latin-1 at last."""
    if body is None:
        return None
    guesses = [name for mark, name in _bom if body.startswith(mark)]
    for where in ((content_type or "").encode(), body[:2048]):
        if m := _charset.search(where):
            guesses.append(m[1].decode())
    for name in [*guesses, "utf-8"]:
        try:
            return body.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode("latin-1")


def page_record(html: Column) -> list[Column]:
    """What a crawler keeps of a page."""
    count = lambda p: F.regexp_count(html, F.lit(p)).cast("long")
    return [
        F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract(html, '<html lang="([^"]*)"', 1).alias("lang"),
        count("<h1[ >]").alias("h1_count"),
        count("<img ").alias("images"),
        count("<a ").alias("links"),
        html.contains('name="viewport"').alias("has_viewport"),
    ]


@query("s10_page_record", """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '<h1[ >]')) AS h1_count, len(regexp_extract_all(html, '<img ')) AS images, len(regexp_extract_all(html, '<a ')) AS links, contains(html, 'name="viewport"') AS has_viewport FROM pages""")
def s10(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", *page_record(F.col("html")))


@query("s12_table_scan", "SELECT doc_id, n_chars FROM documents")
def s12(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "n_chars")


@query("s14_decode", "SELECT doc_id, sha256(text) AS h FROM documents")
def s14(spark, sf_dir):
    def run(body: pd.Series) -> pd.Series:
        return body.map(decode)

    text = F.pandas_udf(run, "string")(F.encode("text", "UTF-8"))
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("h"))
