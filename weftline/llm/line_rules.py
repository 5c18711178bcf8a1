"""Quality rules: base rules on each text, and cross-document line frequency within a host.

Lines are normalised (words joined by one space, lower case, each run of digits a 0) and hashed with their host to
64 bits. A line's frequency is the number of the host's documents that hold it, once or more. Lines in more than
LEAST documents and more than a SHARE of their host's documents are template text: menus, notices, footers. They are
taken out, and a document that keeps less than LEFT of its words is depleted and rejected.

Frequencies are counted over all documents; a document sends each of its lines once, and counts are added up before
the shuffle, so a line in every document costs each task one row. The lines above the limits are few: those of one
host are at most the lines of a mean document divided by SHARE. Up to SENT of them, which are counted first, reach
the rows as one sorted array of 8 bytes each; more of them are joined by a shuffle.

Null text: no words, so it fails. Null source: a host of its own. Rows without a doc_id, and rows that repeat one, are
documents each. Texts of any length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

#: Limits of a line: documents of its host that hold it.
LEAST, SHARE = 20, 0.1
#: A share of a document's words that must be left.
LEFT = 0.5
#: Base rules: words at least, window of repeated words, and the percentage they may make of all.
WORDS, WINDOW, REPEATED = 20, 8, 30
#: Keys of lines that are broadcast at most (8 bytes each).
SENT = 1 << 20

_words = re.compile("[^ \t-\r]+").findall
_digits = re.compile("[0-9]+")


def line_key(host: str | None, words: list[str]) -> int:
    """A hash of 64 bits, signed, of a host and a normalised line."""
    line = _digits.sub("0", " ".join(words).lower())
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), xxhash.xxh64_intdigest("-" if host is None else f"+{host}"))
    return h - (1 << 64) if h >> 63 else h


def doubled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair; equal pairs, and only those, have equal numbers."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def n_repeat_words(words: list[str]) -> int:
    """Words in windows of WINDOW words that stand twice or more in the text; windows are compared exactly."""
    if len(words) <= WINDOW:
        return 0
    number: dict[str, int] = {}
    x = np.array([number.setdefault(w, len(number)) for w in words])
    if len(number) == len(words):
        return 0
    size = 1
    while size < WINDOW:  # windows of 2, 4, 8 words from two of half the size
        x = doubled(x[:-size], x[size:])
        size *= 2
    twice = np.bincount(x)[x] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def base(text: str) -> tuple[list[list[str]], list[int]]:
    """The words of every line, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the text."""
    lines = text.split("\n")
    by_line = list(map(_words, lines))
    words = [w for ws in by_line for w in ws]
    solid = [line for line, ws in zip(lines, by_line) if ws]
    return by_line, [len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(solid) - len(set(solid)), n_repeat_words(words)]


def hosts(docs: DataFrame) -> DataFrame:
    """host, doc_id and text: the columns the rules read."""
    common.small_batches(docs.sparkSession)
    return docs.select(F.col("source").cast("string").alias("host"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def line_rows(docs: DataFrame) -> DataFrame:
    """host and key of every line with a word, once for each document that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, keys = [], []
            for host, text in zip(b.column("host").to_pylist(), b.column("text").to_pylist()):
                own = {line_key(host, ws) for ws in map(_words, text.split("\n")) if ws}
                names += [host] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys, pa.int64())], ["host", "key"])

    return docs.select("host", "text").mapInArrow(run, "host string, key long")


def frequent_lines(docs: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """key and n (documents) of the lines above the limits, as a scratch table."""
    counts = line_rows(docs).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") > least)
    sizes = docs.groupBy(F.col("host").alias("own_host")).agg(F.count("*").alias("docs"))
    over = counts.join(sizes, F.col("host").eqNullSafe(F.col("own_host"))).where(F.col("n") > share * F.col("docs"))
    return common.materialize(over.select("key", "n"), "lines")


def rules(docs: DataFrame, least: int = LEAST, share: float = SHARE, left: float = LEFT, sent: int = SENT) -> DataFrame:
    """doc_id, counts of the base rules, base_failed, kept, n_removed_lines and words_left of every document."""
    docs = hosts(docs)
    over = frequent_lines(docs, least, share)
    few = over.count() <= sent
    if few:
        keys = np.sort(np.array(over.select("key").toArrow().column("key"), np.int64))
        common_keys = docs.sparkSession.sparkContext.broadcast(keys)
    else:
        docs = with_frequent(docs, over)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = common_keys.value if few else None
        for b in batches:
            rows = []
            own = [None] * len(b) if few else b.column("own_keys").to_pylist()
            for host, text, mine in zip(b.column("host").to_pylist(), b.column("text").to_pylist(), own):
                by_line, counts = base(text)
                n_words, repeated = counts[0], counts[4]
                failed = n_words < WORDS or 100 * repeated > REPEATED * n_words
                solid = [ws for ws in by_line if ws]
                ids = np.fromiter((line_key(host, ws) for ws in solid), np.int64, len(solid))
                known = every if few else np.array(sorted(mine or ()), np.int64)
                gone = known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] == ids if len(known) else np.zeros(len(ids), bool)
                lost = sum(len(ws) for ws, g in zip(solid, gone.tolist()) if g)
                rows.append([*counts, failed, not failed and n_words - lost >= left * n_words, int(gone.sum()), n_words - lost])
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], NAMES)

    return docs.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_removed_lines long, words_left long")


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "words_left"]


def with_frequent(docs: DataFrame, over: DataFrame) -> DataFrame:
    """docs with own_keys: the frequent lines of each text, found by a join of line keys; no limit on their number.

    A host's text stands for all rows that repeat it, so a row needs no number of its own.
    """
    of_text = F.xxhash64(F.coalesce(F.concat(F.lit("+"), "host"), F.lit("-")), F.lit("\n"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for one, host, text in zip(b.column("of_text").to_pylist(), b.column("host").to_pylist(), b.column("text").to_pylist()):
                own = {line_key(host, ws) for ws in map(_words, text.split("\n")) if ws}
                ids += [one] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64())], ["of_text", "key"])

    rows = docs.select(of_text.alias("of_text"), "host", "text").mapInArrow(run, "of_text long, key long")
    found = rows.join(over.select("key"), "key").groupBy("of_text").agg(F.collect_set("key").alias("own_keys"))
    return docs.withColumn("of_text", of_text).join(found, "of_text", "left").select("host", "doc_id", "text", "own_keys")


#: The same by the lines themselves, for the query's check.
SQL = r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, source, unnest(lines) AS line FROM d),
s AS (SELECT doc_id, source, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
k AS (SELECT doc_id, source, line, len(lw) AS n, regexp_replace(lower(array_to_string(lw, ' ')), '[0-9]+', '0', 'g') AS key FROM s),
hosts AS (SELECT source, COUNT(*) AS docs FROM documents GROUP BY source),
f AS (SELECT k.source, key FROM k JOIN hosts ON hosts.source IS NOT DISTINCT FROM k.source GROUP BY k.source, key HAVING COUNT(DISTINCT doc_id) > greatest(20, 0.1 * MAX(docs))),
g AS (SELECT k.doc_id, COUNT(f.key) AS n_removed_lines, SUM(CASE WHEN f.key IS NULL THEN 0 ELSE n END) AS lost, COUNT(*) - COUNT(DISTINCT line) AS n_dup_lines FROM k LEFT JOIN f ON f.key = k.key AND f.source IS NOT DISTINCT FROM k.source GROUP BY k.doc_id),
v AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) > 8),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM v),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, win) AS c FROM x) y WHERE c > 1),
q AS (SELECT doc_id, COUNT(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS spot FROM r) z GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(q.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(q.n, 0) > 30 * len(w) AS base_failed,
  CAST(coalesce(n_removed_lines, 0) AS BIGINT) AS n_removed_lines, CAST(len(w) - coalesce(lost, 0) AS BIGINT) AS words_left FROM d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND words_left >= 0.5 * n_words AS kept, n_removed_lines, words_left FROM b"""
